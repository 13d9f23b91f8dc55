"""Queries over customers, orders, line items and events: rules, bands, checks, joins, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions import text as tx
from ..operators import joins as jn
from ..operators import quality as ql
from ..operators import ranking as rk
from ..operators import sampling as sm
from ..operators.contracts import allowed_only, lookup, renamed_prefix, require_columns, with_constants
from ..operators.rules import RuleMatrix, all_of, apply_rule_matrix, at_least
from ..presets import clinical as c
from . import sql
from .common import ACCOUNTS_SQL, accounts, rounded, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


BANDS = ((-1, 4, 9, 14, 19, 27), ("minimal", "mild", "moderate", "marked", "severe"))
LABELS = ("low", "moderate", "high", "urgent")
RISK = RuleMatrix(
    version="risk-1",
    inputs=("n_orders", "n_open", "n_urgent", "total"),
    urgent=(all_of(at_least("n_urgent", "urgent_many"), at_least("total", "total_high")),),
    high=(at_least("n_orders", "orders_high"), at_least("n_open", "open_high"), at_least("total", "total_high")),
    moderate=(at_least("n_orders", "orders_moderate"), at_least("n_open", "open_moderate"), at_least("n_urgent", "urgent_some")),
    thresholds={
        "orders_high": 13,
        "orders_moderate": 9,
        "open_high": 6,
        "open_moderate": 4,
        "urgent_some": 2,
        "urgent_many": 4,
        "total_high": 2500000,
        "high_evidence_weight": 0.85,
        "moderate_evidence_weight": 0.35,
        "high_priority_cutoff": 2.0,
        "moderate_priority_cutoff": 0.7,
    },
    labels=LABELS,
)
_RISK_SQL = f"""WITH {ACCOUNTS_SQL},
ev AS (SELECT *, (n_urgent >= 4 AND total >= 2500000) AS urgent,
    (n_orders >= 13)::INT + (n_open >= 6)::INT + (total >= 2500000)::INT AS high,
    (n_orders >= 9)::INT + (n_open >= 4)::INT + (n_urgent >= 2)::INT AS moderate FROM acc),
scored AS (SELECT *, (0.85 * high + 0.35 * moderate)::DOUBLE AS score FROM ev),
risk AS (SELECT *, CASE WHEN urgent THEN 3 WHEN score >= 2.0 THEN 2 WHEN score >= 0.7 THEN 1 ELSE 0 END AS code FROM scored)"""
_BAND_CASE = "CASE WHEN {0} <= -1 THEN NULL WHEN {0} <= 4 THEN 'minimal' WHEN {0} <= 9 THEN 'mild' WHEN {0} <= 14 THEN 'moderate' WHEN {0} <= 19 THEN 'marked' WHEN {0} <= 27 THEN 'severe' END"
_RISK_LABEL = "CASE code WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' ELSE 'urgent' END"


@query(
    f"""{_RISK_SQL} SELECT row_number() OVER (ORDER BY code DESC, score DESC, total DESC, patient_id)::BIGINT AS position, patient_id,
  {_RISK_LABEL} AS priority_label, round(score, 6) AS priority_score, {_BAND_CASE.format('n_orders')} AS band, total
  FROM risk QUALIFY position <= 50"""
)
def risk_rank(spark, folder):
    """Flagship: order totals per customer, bands, rule matrix, inspection order, top 50."""
    scored = apply_rule_matrix(accounts(spark, folder), RISK)
    banded = scored.withColumn("band", sc.cut_right("n_orders", *BANDS))
    top = rk.first_rows(rk.ranked(banded, "priority_label", LABELS, "priority_score", "total", "patient_id"), 50)
    order = rk.rank_key(
        F.col("priority_label"), LABELS, F.col("priority_score"), F.col("total"), F.col("patient_id")
    )
    # The limit leaves 50 rows, so one window over them is all that is needed.
    placed = top.withColumn("position", F.row_number().over(W.orderBy(order)).cast("long"))
    return rounded(
        placed.select("position", "patient_id", "priority_label", "priority_score", "band", "total"), ["priority_score"]
    )


@query(f"{_RISK_SQL} SELECT row_number() OVER (ORDER BY code DESC, score DESC, total DESC, patient_id)::BIGINT AS position, patient_id, code AS priority_code FROM risk")
def rank_positions(spark, folder):
    """Positions over the whole table, without a one-partition window."""
    scored = apply_rule_matrix(accounts(spark, folder), RISK)
    order = rk.rank_key(
        F.col("priority_label"), LABELS, F.col("priority_score"), F.col("total"), F.col("patient_id")
    )
    return rk.with_positions(scored.select("patient_id", "priority_code", order.alias("_o")), F.col("_o")).drop("_o")


@query(
    f"{_RISK_SQL} SELECT n_name AS nation, {_RISK_LABEL} AS priority_label, count(*)::BIGINT AS n, sum(urgent::INT)::BIGINT AS urgent_rules, round(sum(score), 4) AS score_sum FROM risk JOIN nation ON n_nationkey = nk GROUP BY ALL"
)
def rule_matrix_distribution(spark, folder):
    scored = apply_rule_matrix(accounts(spark, folder), RISK)
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nation"))
    out = (
        scored.groupBy("nk", "priority_label")
        .agg(F.count("*").alias("n"), F.sum("urgent_rule_triggered").alias("urgent_rules"), F.sum("priority_score").alias("score_sum"))
        .join(nations, "nk")
        .drop("nk")
    )
    return rounded(out, ["score_sum"], 4)


@query(
    f"WITH {ACCOUNTS_SQL} SELECT {_BAND_CASE.format('n_orders')} AS band, CASE WHEN bal < 0 THEN 0 WHEN bal < 2500 THEN 1 WHEN bal < 5000 THEN 2 ELSE 3 END AS level, count(*)::BIGINT AS n FROM acc GROUP BY ALL"
)
def band_counts(spark, folder):
    acc = accounts(spark, folder)
    return acc.groupBy(
        sc.cut_right("n_orders", *BANDS).alias("band"), sc.digitize_left("bal", [0, 2500, 5000]).alias("level")
    ).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice AS p, (o_orderstatus = 'O')::INT AS f, (o_orderpriority = '1-URGENT')::INT AS u FROM orders),
t AS (SELECT min(p) AS lo, max(p) AS hi, avg(p) AS mu, stddev_pop(p) AS sd FROM s)
SELECT o_orderkey, round((p - lo) / (hi - lo), 6) AS scaled, round((p - mu) / sd, 6) AS z,
  round(least(1.0, greatest(0.0, 0.3 * (1 - (p - lo) / (hi - lo)) + 0.45 * f + 0.25 * u)), 6) AS vulnerability FROM s CROSS JOIN t"""
)
def minmax_index(spark, folder):
    """Min-max and z scaling over all orders, and a weighted composite index."""
    orders = table(spark, folder, "orders")
    scaled = sc.min_max(orders, "o_totalprice")
    flags = [(F.col("o_orderstatus") == "O").cast("int"), (F.col("o_orderpriority") == "1-URGENT").cast("int")]
    out = orders.select(
        "o_orderkey",
        scaled.alias("scaled"),
        sc.z_score(orders, "o_totalprice").alias("z"),
        sc.weighted_index([(F.lit(1.0) - scaled, 0.3), (flags[0], 0.45), (flags[1], 0.25)]).alias("vulnerability"),
    )
    return rounded(out, ["scaled", "z", "vulnerability"])


@query(
    """SELECT l_orderkey, l_linenumber, (l_linenumber + (51 - l_quantity::INT) + (l_discount * 100)::INT + (10 - (l_tax * 100)::INT)) AS scored_total,
  (l_linenumber + l_quantity::INT + (l_discount * 100)::INT + (l_tax * 100)::INT) AS raw_total,
  greatest((l_returnflag = 'R')::INT, (l_linestatus = 'F')::INT) AS any_flag FROM lineitem"""
)
def item_totals(spark, folder):
    """Reverse-scored items, row totals, row maximum over flags."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").cast("int").alias("q"),
        F.rint(F.col("l_discount") * 100).cast("int").alias("d"),
        F.rint(F.col("l_tax") * 100).cast("int").alias("t"),
        (F.col("l_returnflag") == "R").cast("int").alias("r"),
        (F.col("l_linestatus") == "F").cast("int").alias("f"),
    )
    reversed_q = sc.reverse_scored(["q"], [1], 1, 50)[0]
    reversed_t = sc.reverse_scored(["d", "t"], [2], 0, 10)[1]
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        sc.row_total(["l_linenumber", reversed_q, "d", reversed_t]).alias("scored_total"),
        sc.row_total(["l_linenumber", "q", "d", "t"]).alias("raw_total"),
        sc.row_max(["r", "f"]).alias("any_flag"),
    )


@query(
    """WITH e AS (SELECT event_id, value, value / 100.0 - 2 AS x, least(0.999999, greatest(0.000001, value / 500.0)) AS p, event_id % 4 AS k FROM events),
a AS (SELECT *, greatest(value, 0.000000001) AS q0, greatest((event_id % 13)::DOUBLE, 0.000000001) AS q1, greatest((event_id % 7)::DOUBLE * 3, 0.000000001) AS q2 FROM e)
SELECT event_id, round(1.0 / (1.0 + exp(-least(35.0, greatest(-35.0, x)))), 6) AS s, round(ln(p / (1 - p)), 6) AS lg,
  round_even(value * 10.0, 0) / 10.0 AS half_even, CASE k WHEN 0 THEN 'none' WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' ELSE 'top' END AS label,
  (CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END) AS best,
  round((q1 / (q0 + q1 + q2)) + (q2 / (q0 + q1 + q2)), 6) AS upper_band, round(least(10.0, greatest(0.0, value)), 6) AS clipped FROM a"""
)
def scalar_math(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id",
        "value",
        (F.col("event_id") % 4).cast("int").alias("k"),
        (F.col("event_id") % 13).cast("double").alias("b"),
        ((F.col("event_id") % 7) * 3).cast("double").alias("cc"),
    )
    p = sc.aligned_probabilities({2: F.col("cc"), 0: F.col("value"), 1: F.col("b")}, 3)
    staged = e.select("*", *[x.alias(f"p{i}") for i, x in enumerate(p)])
    out = staged.select(
        "event_id",
        sc.sigmoid(F.col("value") / 100.0 - 2).alias("s"),
        sc.logit(F.col("value") / 500.0).alias("lg"),
        sc.round_half_even("value", 1).alias("half_even"),
        sc.severity_label("k", ("none", "mild", "moderate", "high"), "top").alias("label"),
        sc.argmax(["p0", "p1", "p2"]).alias("best"),
        sc.high_band(["p1", "p2"], staged.columns).alias("upper_band"),
        sc.clip("value", 0.0, 10.0).alias("clipped"),
    )
    return rounded(out, ["s", "lg", "upper_band", "clipped"])


_CHECK_DETAILS = {
    "quantity_range": "1..50 expected",
    "discount_range": "0..0.05 expected",
    "tax_at_most_one": "tax is a share",
    "flag_implies_status": "returned lines are closed",
    "order_total_matches": "order price equals the sum of its lines",
    "order_key_unique": "one row per order",
}


def _line_checks(spark, folder) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumns(
        {
            "r": (F.col("l_returnflag") == "R").cast("int"),
            "f": (F.col("l_linestatus") == "F").cast("int"),
        }
    )
    d = _CHECK_DETAILS
    checks = ql.quality_checks(
        lines,
        {
            "quantity_range": (ql.all_in_range(["l_quantity"], 1, 50), d["quantity_range"]),
            "discount_range": (ql.in_range("l_discount", 0, 0.05), d["discount_range"]),
            "tax_at_most_one": (ql.at_most("l_tax", F.lit(1.0)), d["tax_at_most_one"]),
            "flag_implies_status": (ql.at_most("r", "f"), d["flag_implies_status"]),
        },
    )
    return checks


@query(
    f"""SELECT 'quantity_range' AS "check", bool_and(l_quantity BETWEEN 1 AND 50) AS passed, '1..50 expected' AS details FROM lineitem
UNION ALL SELECT 'discount_range', bool_and(l_discount BETWEEN 0 AND 0.05), '0..0.05 expected' FROM lineitem
UNION ALL SELECT 'tax_at_most_one', bool_and(l_tax <= 1), 'tax is a share' FROM lineitem
UNION ALL SELECT 'flag_implies_status', bool_and((l_returnflag = 'R')::INT <= (l_linestatus = 'F')::INT), 'returned lines are closed' FROM lineitem
UNION ALL SELECT 'order_total_matches', coalesce(bool_and(coalesce(o_totalprice::DECIMAL(18,2) = s, false)), true), 'order price equals the sum of its lines'
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
UNION ALL SELECT 'order_key_unique', count(*) = count(DISTINCT o_orderkey), 'one row per order' FROM orders"""
)
def quality_checks(spark, folder):
    name = "order_key_unique"
    unique = ql.quality_checks(
        table(spark, folder, "orders"), {}, {name: ("o_orderkey", _CHECK_DETAILS[name])}
    )
    priced = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("lines")
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price")
    )
    name = "order_total_matches"
    totals = ql.quality_checks(
        orders.join(priced, "o_orderkey", "left"),
        {name: (ql.total_matches(["lines"], "price"), _CHECK_DETAILS[name])},
    )
    return sm.union_all([_line_checks(spark, folder), totals, unique])


@query(
    """SELECT (bool_and(l_quantity BETWEEN 1 AND 50) = false)::BIGINT + (bool_and(l_discount BETWEEN 0 AND 0.05) = false)::BIGINT
  + (bool_and(l_tax <= 1) = false)::BIGINT + (bool_and((l_returnflag = 'R')::INT <= (l_linestatus = 'F')::INT) = false)::BIGINT AS n_failed FROM lineitem"""
)
def failed_check_count(spark, folder):
    return ql.failed_checks(_line_checks(spark, folder))


@query("SELECT count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem")
def quality_gate(spark, folder):
    """Rows pass on only because the listed checks hold; a failed check would stop the query."""
    lines = table(spark, folder, "lineitem")
    checks = ql.quality_checks(lines, {"quantity_range": (ql.in_range("l_quantity", 1, 50), "1..50")})
    passed = ql.quality_gate(lines, checks)
    return passed.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    """WITH i AS (SELECT l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c FROM lineitem)
SELECT 'lines' AS scale, round(3.0 / 2 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)), 6) AS alpha FROM i
UNION ALL SELECT 'pair', round(2.0 / 1 * (1 - (var_samp(a) + var_samp(b)) / var_samp(a + b)), 6) FROM i UNION ALL SELECT 'single', NULL"""
)
def scale_alpha(spark, folder):
    items = table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c")
    )
    return rounded(ql.cronbach_alpha(items, {"lines": ["a", "b", "c"], "pair": ["a", "b"], "single": ["a"]}), ["alpha"])


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(round_even(corr({a}, {b}) * 10000, 0) / 10000, 4) AS r FROM lineitem" for a in _CORR for b in _CORR
    )
)
def correlation_matrix(spark, folder):
    return rounded(ql.correlations(table(spark, folder, "lineitem"), _CORR), ["r"], 4)


@query("SELECT count(DISTINCT user_id)::BIGINT AS n_user_id, count(DISTINCT event_type)::BIGINT AS n_event_type, count(DISTINCT props)::BIGINT AS n_props FROM events")
def distinct_counts(spark, folder):
    return ql.distinct_counts(table(spark, folder, "events"), ["user_id", "event_type", "props"])


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def class_distribution(spark, folder):
    orders = ql.require_class_counts(table(spark, folder, "orders"), "o_orderpriority", 5)
    return ql.class_distribution(orders, "o_orderpriority")


_U = lambda salt, key, seed: sql.draw(seed, f"'{salt}'", f"{key}::VARCHAR")
_MISS = ["o_totalprice", "o_orderstatus"]


_MISSING_SQL = ", ".join(f"CASE WHEN {_U(m, 'o_orderkey', 17)} >= 0.15 THEN {m} END AS {m}" for m in _MISS)


@query(f"SELECT o_orderkey, o_custkey, {_MISSING_SQL}, o_orderpriority FROM orders")
def missing_values(spark, folder):
    orders = table(spark, folder, "orders").drop("o_orderdate")
    return ql.with_missing_values(
        orders, "o_orderkey", 0.15, 17, ["o_custkey"], text_columns=["o_orderstatus"]
    )


# --- joins and set operations ----------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice, items FROM orders JOIN (SELECT l_orderkey, count(*)::BIGINT AS items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def one_to_one_join(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    items = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"))
    return jn.join_one_to_one(orders, items, "o_orderkey", "inner", check=("left",))


@query("SELECT p_partkey, p_brand, p_retailprice, n_lines FROM part LEFT JOIN (SELECT l_partkey, count(*)::BIGINT AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def left_join_checked(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice")
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    counts = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_lines"))
    return jn.join_one_to_one(parts, counts, "p_partkey", "left")


@query(
    """SELECT a.o_custkey AS k, a.n AS n_a, b.n AS n_b, a.top AS top, b.low AS low FROM
  (SELECT o_custkey, count(*)::BIGINT AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a JOIN
  (SELECT o_custkey, count(*)::BIGINT AS n, min(o_totalprice) AS low FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b USING (o_custkey)"""
)
def suffix_join(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "k")
    a = orders.where("o_orderstatus = 'O'").groupBy("k").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    b = orders.where("o_orderstatus = 'F'").groupBy("k").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"))
    left, right = jn.with_suffixes(a, b, "k", ("_a", "_b"))
    return jn.join_one_to_one(left, right, "k", check=())


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join(spark, folder):
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return jn.anti_join(customers, urgent.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def orphan_guard(spark, folder):
    """Every order has a customer; an order without one would stop the query."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, folder, "customer").select("c_custkey")
    checked = jn.refuse_orphans(orders, customers, "c_custkey", "orders")
    return checked.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    """SELECT c_custkey AS key, 'customer' AS kind, c_acctbal AS amount, NULL::VARCHAR AS status FROM customer
UNION ALL SELECT s_suppkey, 'supplier', s_acctbal, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'ok' END FROM supplier"""
)
def union_parts(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("amount")
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("key"),
        F.lit("supplier").alias("kind"),
        F.col("s_acctbal").alias("amount"),
        F.when(F.col("s_acctbal") < 0, "debt").otherwise("ok").alias("status"),
    )
    return sm.union_all([customers, suppliers])


@query("SELECT DISTINCT o_custkey FROM orders UNION SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal < 0")
def distinct_keys(spark, folder):
    a = table(spark, folder, "orders").select("o_custkey", "o_orderstatus")
    b = table(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sm.union_all([a, b]).select("o_custkey").dropDuplicates(["o_custkey"])


@query("SELECT l_returnflag AS label FROM lineitem UNION SELECT l_linestatus FROM lineitem")
def label_domain(spark, folder):
    return sm.label_domain(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


# --- projections, labels, formats --------------------------------------------------------------


@query(
    """SELECT o_orderkey, CASE lower(trim(o_orderstatus)) WHEN 'o' THEN 'Open' WHEN 'f' THEN 'Finished' ELSE o_orderstatus END AS status_title,
  substr(o_orderpriority, 1, 1)::INT - 1 AS code, ['A', 'B', 'C', 'D', 'E'][substr(o_orderpriority, 1, 1)::INT] AS letter,
  'run-1' AS run_id, 7 AS seed FROM orders WHERE o_orderstatus IN ('O', 'P')"""
)
def label_maps(spark, folder):
    """Dictionary labels with pass-through, label <-> code, membership filter, constants, rename."""
    orders = require_columns(table(spark, folder, "orders"), ["o_orderkey", "o_orderstatus"], "orders")
    chosen = orders.where(F.col("o_orderstatus").isin("O", "P"))
    labels = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    shown = chosen.select(
        "o_orderkey",
        tx.mapped_lower("o_orderstatus", {"o": "Open", "f": "Finished"}).alias("x_status_title"),
        sc.label_code("o_orderpriority", labels).alias("x_code"),
        sc.code_label(sc.label_code("o_orderpriority", labels), "ABCDE").alias("x_letter"),
    )
    return with_constants(renamed_prefix(shown, "x_", ""), {"run_id": "run-1", "seed": 7})


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), -1.0) AS k, coalesce(try_cast(event_type AS DOUBLE), 0.0) AS parsed, 0.5::DOUBLE AS absent FROM events")
def number_coercion(spark, folder):
    e = allowed_only(table(spark, folder, "events"), ["event_id", "event_type", "props"])
    return e.select(
        "event_id",
        sc.number_or(F.get_json_object("props", "$.k"), -1.0).alias("k"),
        sc.number_or("event_type").alias("parsed"),
        sc.number_or_missing(e, "no_such_column", 0.5).alias("absent"),
    )


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 77")
def key_lookup(spark, folder):
    return lookup(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 77)


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_discount AS p, (l_returnflag = 'R')::INT AS r, (l_linestatus = 'F')::INT AS f,
    CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_tax END AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, printf('%.1f%%', round_even(p * 100.0 * 10.0, 0) / 10.0) AS pct,
  CASE WHEN t IS NULL THEN 'n/a' ELSE printf('%.1f%%', round_even(t * 100.0 * 10.0, 0) / 10.0) END AS tax_pct,
  CASE WHEN r + f = 0 THEN 'none' ELSE concat_ws('; ', CASE WHEN r = 1 THEN 'returned' END, CASE WHEN f = 1 THEN 'finished' END) END AS flags,
  CASE WHEN r = 1 AND f = 0 THEN 'present' WHEN f = 1 THEN 'negated' WHEN l_linenumber = 1 THEN 'remote' ELSE 'not mentioned' END AS status,
  'L-' || lpad(l_orderkey::VARCHAR, 8, '0') AS line_id FROM f"""
)
def formatted_lines(spark, folder):
    """Percent texts, active-flag summary, four-state status, padded ids."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_discount",
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_tax")).alias("t"),
        (F.col("l_returnflag") == "R").cast("int").alias("r"),
        (F.col("l_linestatus") == "F").cast("int").alias("f"),
    )
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        tx.percent("l_discount", "n/a").alias("pct"),
        tx.percent("t", "n/a").alias("tax_pct"),
        tx.active_labels({"returned": F.col("r"), "finished": F.col("f")}, "none").alias("flags"),
        tx.marker_status("r", "f", F.col("l_linenumber") == 1, ("present", "negated", "remote", "not mentioned")).alias("status"),
        tx.padded_id("L", "l_orderkey", 8).alias("line_id"),
    )


_FEATURES = [
    "numeric__phq9_total",
    "categorical__gender_category_feminino",
    "numeric__marker_ideacao_suicida_present",
    "numeric__marker_risco_violencia_severity_code",
    "categorical__marker_agravamento_recente_temporality_atual",
    "n_orders",
]


@query(
    """WITH f AS (SELECT o_orderkey, o_orderkey % 6 AS i FROM orders)
SELECT CASE i WHEN 0 THEN 'PHQ-9 total' WHEN 1 THEN 'Gender category feminino' WHEN 2 THEN 'Ideação suicida — presença'
  WHEN 3 THEN 'Risco de violência — código de severidade' WHEN 4 THEN 'Agravamento recente — temporality atual' ELSE 'N orders' END AS title,
  count(*)::BIGINT AS n FROM f GROUP BY ALL"""
)
def feature_titles(spark, folder):
    names = table(spark, folder, "orders").select(
        sc.code_label((F.col("o_orderkey") % 6).cast("int"), _FEATURES).alias("name")
    )
    title = tx.feature_title(
        "name", c.FEATURE_PREFIXES, c.FEATURE_TITLES, c.MARKER_TITLES, c.QUALIFIER_TITLES, c.TITLE_JOINER
    )
    return names.groupBy(title.alias("title")).agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT p_brand, p_type, count(*) AS n, avg(p_retailprice) AS s FROM part GROUP BY ALL)
SELECT p_type, p_brand, round(s, 6) AS s FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY round(s, 6) DESC, p_brand) AS r FROM p) WHERE r = 1"""
)
def best_per_group(spark, folder):
    """Best row per group: highest score, then name."""
    parts = table(spark, folder, "part").groupBy("p_type", "p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("s"))
    return rk.best_per_group(parts, "p_type", "s", "p_brand")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY abs(p_retailprice - 1400) DESC, p_partkey LIMIT 20")
def top_features(spark, folder):
    """Top 20 by size of a value."""
    parts = table(spark, folder, "part").withColumn("gap", F.col("p_retailprice") - 1400)
    return rk.top_by(parts, "gap", 20, "p_partkey", absolute=True).select("p_partkey", "p_retailprice")


# --- samples, splits, folds ----------------------------------------------------------------------


@query(
    f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_U('sample', 'doc_id', 3)}, doc_id) <= 20"
)
def stratified_sample(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sm.stratified_sample(docs, "doc_id", "lang", 20, 3)


@query(
    f"""SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_U('split', 'o_orderkey', 4)}, o_orderkey)
  <= round_even(0.2 * count(*) OVER (PARTITION BY o_orderpriority), 0))::INT AS is_test FROM orders"""
)
def train_test_split(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return sm.train_test_split(orders, "o_orderkey", "o_orderpriority", 0.2, 4)


@query(
    f"""SELECT o_orderkey, o_orderpriority, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_U('fold', 'o_orderkey', 6)}, o_orderkey) - 1) % 5)::INT AS fold FROM orders"""
)
def stratified_folds(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return sm.stratified_folds(orders, "o_orderkey", "o_orderpriority", 5, 6)


@query(f"SELECT p_partkey, round({_U('any', 'p_partkey', 8)}, 12) AS u FROM part")
def uniform_draws(spark, folder):
    from ..functions.hashing import uniform

    return table(spark, folder, "part").select("p_partkey", F.round(uniform(8, "p_partkey", "any"), 12).alias("u"))
