"""Queries over ordinal predictions derived from line items: metrics, calibration, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import class_eval as ce
from ..operators.extraction_eval import quadratic_kappa
from ..operators.ranking import select_model
from . import sql
from .common import dealt, rounded, table

QUERIES: dict = {}
ORACLES: dict = {}
K = 4
PROBS = [f"p{k}" for k in range(K)]
RECALLS = {"recall_alta": 2, "recall_urgente": 3}
PRECISIONS = {"auprc_alta": 2, "auprc_urgente": 3}
REPETITIONS = 20


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def predictions(spark, folder) -> DataFrame:
    """One prediction per line item: class of the quantity, four probabilities, argmax."""
    source = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"
    )
    lines = dealt(source).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.expr("int(least(3, floor((l_quantity - 1) / 12.5D)))").alias("y"),
        F.expr("l_quantity + l_linenumber * 3 + int(rint(l_discount * 100))").alias("s"),
    )
    raw = lines.selectExpr("id", "y", *[f"1D + abs(60 - s + {20 * k}) % 61 + (CASE WHEN y = {k} THEN 12 ELSE 0 END) AS q{k}" for k in range(K)])
    shared = raw.selectExpr("id", "y", *[f"q{k} / (q0 + q1 + q2 + q3) AS p{k}" for k in range(K)])
    return shared.selectExpr(
        "id", "y", "int(array_position(array(p0, p1, p2, p3), greatest(p0, p1, p2, p3)) - 1) AS yhat", *PROBS
    )


_Q = ", ".join(f"1.0::DOUBLE + abs(60 - s + {20 * k}) % 61 + (CASE WHEN y = {k} THEN 12 ELSE 0 END) AS q{k}" for k in range(K))
_P = f"""WITH RECURSIVE lin AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, least(3, floor((l_quantity - 1) / 12.5))::INT AS y,
    l_quantity + l_linenumber * 3 + round_even(l_discount * 100, 0)::INT AS s FROM lineitem),
raw AS (SELECT id, y, {_Q} FROM lin),
pr AS (SELECT id, y, {', '.join(f'q{k} / (q0 + q1 + q2 + q3) AS p{k}' for k in range(K))} FROM raw),
pred AS (SELECT *, (list_position([p0, p1, p2, p3], greatest(p0, p1, p2, p3)) - 1)::INT AS yhat FROM pr)"""


@query(f"{_P} SELECT y, yhat, count(pred.id)::BIGINT AS n FROM (SELECT unnest(range(4))::INT AS y) a CROSS JOIN (SELECT unnest(range(4))::INT AS yhat) b LEFT JOIN pred USING (y, yhat) GROUP BY ALL")
def confusion_dense(spark, folder):
    return ce.dense_confusion(ce.label_counts(predictions(spark, folder), "y", "yhat"), K)


@query(
    f"""{_P} SELECT ['Baixa', 'Moderada', 'Alta', 'Urgente'][y + 1] AS reference, {', '.join(f"count(*) FILTER (WHERE yhat = {k})::BIGINT AS {n}" for k, n in enumerate(('Baixa', 'Moderada', 'Alta', 'Urgente')))} FROM pred GROUP BY y"""
)
def confusion_titles(spark, folder):
    dense = ce.dense_confusion(ce.label_counts(predictions(spark, folder), "y", "yhat"), K)
    return ce.confusion_matrix(dense, ("Baixa", "Moderada", "Alta", "Urgente"))


_PC = """pc AS (SELECT k AS class_code, count(*) FILTER (WHERE y = k AND yhat = k)::DOUBLE AS tp, count(*) FILTER (WHERE yhat = k)::DOUBLE AS fo,
  count(*) FILTER (WHERE y = k) AS support FROM pred CROSS JOIN (SELECT unnest(range(4))::INT AS k) GROUP BY k),
cls AS (SELECT class_code, coalesce(tp / nullif(fo, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
  coalesce(2 * tp / nullif(fo + support, 0), 0) AS f1, support FROM pc)"""


@query(f"{_P}, {_PC} SELECT class_code, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM cls")
def per_class(spark, folder):
    out = ce.per_class(ce.label_counts(predictions(spark, folder), "y", "yhat"), K)
    return rounded(out, ["precision", "recall", "f1"])


_KAPPA = """kap AS (SELECT 1 - sum(power(y - yhat, 2))::DOUBLE / (sum(y * y) + sum(yhat * yhat) - 2.0 * sum(y) * sum(yhat) / count(*)) AS v FROM pred)"""


@query(f"{_P}, {_KAPPA} SELECT round(v, 6) AS kappa FROM kap")
def kappa_weighted(spark, folder):
    counts = ce.label_counts(predictions(spark, folder), "y", "yhat")
    return rounded(quadratic_kappa(counts, [], "y", "yhat", "n"), ["kappa"])


_LABEL_ROWS = """SELECT 'f1_macro' AS metric, avg(f1) AS value FROM cls UNION ALL SELECT 'recall_alta', max(recall) FILTER (WHERE class_code = 2) FROM cls
UNION ALL SELECT 'recall_urgente', max(recall) FILTER (WHERE class_code = 3) FROM cls
UNION ALL SELECT 'ordinal_mae', avg(abs(y - yhat)) FROM pred UNION ALL SELECT 'weighted_kappa', v FROM kap"""


@query(f"{_P}, {_PC}, {_KAPPA} SELECT metric, round(value, 6) AS value FROM ({_LABEL_ROWS})")
def ordinal_metrics(spark, folder):
    out = ce.label_metrics(ce.label_counts(predictions(spark, folder), "y", "yhat"), K, RECALLS)
    return rounded(out, ["value"])


_LONG = " UNION ALL ".join(f"SELECT {k} AS class_code, p{k} AS score, (y = {k})::INT AS pos FROM pred" for k in range(K))
_RANK = f"""lg AS ({_LONG}),
sc AS (SELECT class_code, score, sum(pos) AS pos, sum(1 - pos) AS neg FROM lg GROUP BY class_code, score),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM sc WINDOW w AS (PARTITION BY class_code ORDER BY score DESC)),
rk AS (SELECT class_code, 1 - sum(pos * (fp - 0.5 * neg))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE AS auc,
  sum(pos * tp::DOUBLE / (tp + fp)) / sum(pos) AS average_precision FROM cu GROUP BY class_code)"""


@query(f"{_P}, {_RANK} SELECT class_code, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision FROM rk")
def auc_and_precision(spark, folder):
    scores = ce.score_table(predictions(spark, folder), "y", PROBS)
    return rounded(ce.ranking_metrics(scores), ["auc", "average_precision"])


@query(f"{_P}, {_RANK} SELECT round(avg(auc), 6) AS auc_roc_ovr_macro FROM rk")
def auc_ovr_macro(spark, folder):
    ranking = ce.ranking_metrics(ce.score_table(predictions(spark, folder), "y", PROBS))
    return rounded(ce.macro_auc(ranking, K), ["auc_roc_ovr_macro"])


_PROB = f"""pb AS (SELECT avg({' + '.join(f'power((y = {k})::INT - p{k}, 2)' for k in range(K))}) AS multiclass_brier, avg(-ln([p0, p1, p2, p3][y + 1])) AS multiclass_log_loss,
  avg(power((y >= 2)::INT - (p2 + p3), 2)) AS brier_highurgent, avg(-ln(CASE WHEN y >= 2 THEN p2 + p3 ELSE 1 - (p2 + p3) END)) AS log_loss_highurgent FROM pred)"""
_PROB_NAMES = ["multiclass_brier", "multiclass_log_loss", "brier_highurgent", "log_loss_highurgent"]


@query(f"{_P}, {_PROB} SELECT {sql.rounded(_PROB_NAMES)} FROM pb")
def brier_and_loss(spark, folder):
    return rounded(ce.probability_scores(predictions(spark, folder), "y", PROBS, 2), _PROB_NAMES)


def _calibration_sql(by: str = "", weight: str = "1", source: str = "pred") -> str:
    """CTE ``cal`` of Newton steps (it 0..12) of the logistic fit, per group."""
    g, k = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    start = f"SELECT DISTINCT {g}0 AS it, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {source}"
    return f"""cd AS (SELECT {g}t, ln(p / (1 - p)) AS x, sum({weight})::DOUBLE AS n FROM (
  SELECT *, (y >= 2)::INT AS t, least(greatest(p2 + p3, 1e-6), 1 - 1e-6) AS p FROM {source}) GROUP BY ALL),
cal AS ({start} UNION ALL
  SELECT {g}it + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT {g}it, a, b, sum(n * (t - m)) AS g0, sum(n * (t - m) * x) AS g1, sum(n * m * (1 - m)) AS h00,
      sum(n * m * (1 - m) * x) AS h01, sum(n * m * (1 - m) * x * x) AS h11
    FROM (SELECT {g}it, a, b, t, x, n, 1 / (1 + exp(-(a + b * x))) AS m FROM cal JOIN cd {k} WHERE it < 12) GROUP BY ALL))"""


_CALIBRATION = _calibration_sql()
_REPORT_ROWS = (
    _LABEL_ROWS
    + " UNION ALL SELECT 'auc_roc_ovr_macro', avg(auc) FROM rk UNION ALL SELECT 'auprc_alta', max(average_precision) FILTER (WHERE class_code = 2) FROM rk"
    + " UNION ALL SELECT 'auprc_urgente', max(average_precision) FILTER (WHERE class_code = 3) FROM rk"
    + "".join(f" UNION ALL SELECT '{n}', {n} FROM pb" for n in _PROB_NAMES)
    + " UNION ALL SELECT 'calibration_intercept', a FROM cal WHERE it = 12 UNION ALL SELECT 'calibration_slope', b FROM cal WHERE it = 12"
)


@query(
    f"{_P}, {_PC}, {_KAPPA}, {_RANK}, {_PROB}, {_CALIBRATION} SELECT metric, round(value, 5) AS value FROM ({_REPORT_ROWS})"
)
def classification_report(spark, folder):
    out = ce.classification_report(
        predictions(spark, folder), "y", "yhat", K, RECALLS, PROBS, PRECISIONS, calibration=True
    )
    return rounded(out, ["value"], 5)


_BIN = "(" + " + ".join(f"(p > {i * (1.0 / 10)!r})::INT" for i in range(1, 10)) + ")"
_TARGETS = " UNION ALL ".join(
    [f"SELECT 'class_{k}' AS target, (y = {k})::INT AS seen, p{k} AS p FROM pred" for k in range(K)]
    + ["SELECT 'high_or_urgent', (y >= 2)::INT, p2 + p3 FROM pred"]
)


@query(
    f"""{_P} SELECT target, {_BIN}::INT AS bin, count(*)::BIGINT AS n, round(avg(p), 6) AS mean_predicted, round(avg(seen), 6) AS observed_fraction FROM ({_TARGETS}) GROUP BY ALL"""
)
def calibration_curve(spark, folder):
    out = ce.calibration_curve(predictions(spark, folder), "y", PROBS, 2)
    return rounded(out, ["mean_predicted", "observed_fraction"])


@query(f"{_P}, {_CALIBRATION} SELECT round(a, 4) AS calibration_intercept, round(b, 4) AS calibration_slope FROM cal WHERE it = 12")
def calibration_fit(spark, folder):
    """Intercept and slope of the upper band; the check takes its Newton steps in SQL."""
    return rounded(
        ce.calibration_fit(predictions(spark, folder), "y", PROBS, 2),
        ["calibration_intercept", "calibration_slope"],
        4,
    )


@query(f"{_P}, n AS (SELECT y, count(*) AS c FROM pred GROUP BY y) SELECT y, count(*)::BIGINT AS n, round((SELECT sum(c) FROM n) / ((SELECT count(*) FROM n) * max(c))::DOUBLE, 6) AS class_weight FROM pred JOIN n USING (y) GROUP BY y")
def class_weights(spark, folder):
    weighted = ce.class_weights(predictions(spark, folder), "y")
    return weighted.groupBy("y").agg(F.count("*").alias("n"), F.round(F.max("class_weight"), 6).alias("class_weight"))


_SEED = 6006
_U = sql.poisson_digits(_SEED, "id")
_WEIGHTED = f"""wt AS (SELECT * FROM (SELECT *, {sql.poisson_case('u')} AS w FROM (
  SELECT pred.*, repetition, {_U} AS u FROM pred CROSS JOIN (SELECT unnest(range({REPETITIONS}))::INT AS repetition))) WHERE w > 0)"""
_REP_ROWS = f"""
rc AS (SELECT repetition, k, sum(w) FILTER (WHERE y = k AND yhat = k)::DOUBLE AS tp, sum(w) FILTER (WHERE yhat = k)::DOUBLE AS fo, sum(w) FILTER (WHERE y = k)::DOUBLE AS su
  FROM wt CROSS JOIN (SELECT unnest(range(4)) AS k) GROUP BY ALL),
rm AS (SELECT repetition, avg(coalesce(2 * coalesce(tp, 0) / (coalesce(fo, 0) + coalesce(su, 0)), 0)) AS f1_macro,
  max(coalesce(tp, 0) / su) FILTER (WHERE k = 2) AS recall_alta, max(coalesce(tp, 0) / su) FILTER (WHERE k = 3) AS recall_urgente FROM rc GROUP BY repetition),
ro AS (SELECT repetition, sum(w * abs(y - yhat))::DOUBLE / sum(w) AS ordinal_mae,
  1 - sum(w * power(y - yhat, 2))::DOUBLE / (sum(w * y * y) + sum(w * yhat * yhat) - 2.0 * sum(w * y) * sum(w * yhat) / sum(w)) AS weighted_kappa FROM wt GROUP BY repetition),
rl AS (UNPIVOT (SELECT * FROM rm JOIN ro USING (repetition)) ON f1_macro, recall_alta, recall_urgente, ordinal_mae, weighted_kappa INTO NAME metric VALUE value)"""


@query(
    f"{_P}, {_WEIGHTED}, {_REP_ROWS} SELECT metric, round(quantile_cont(value, 0.025), 6) AS ci_2_5, round(quantile_cont(value, 0.975), 6) AS ci_97_5 FROM rl GROUP BY metric"
)
def metric_intervals(spark, folder):
    """Bootstrap intervals of the label metrics over hashed Poisson weights."""
    out = ce.bootstrap_intervals(
        predictions(spark, folder), "id", "y", "yhat", K, RECALLS, REPETITIONS, _SEED, method="poisson"
    )
    return rounded(out, ["ci_2_5", "ci_97_5"])


_DRAWS = 5


def _drawn_sql(repetitions: int, seed: int) -> str:
    """CTEs ending in ``wt``: exact draws inside classes, blocks of 1,024 numbers first."""
    bits = "substr(h, 1 + 13 * (repetition % 2)::INT, 13)"
    return f"""nb AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {sql.draw(seed, "'order'", 'id')}, id) AS no, count(*) OVER (PARTITION BY y) AS size FROM pred),
bl AS (SELECT y, size, repetition, floor(('0x'||{bits})::BIGINT / 4503599627370496.0 * size)::BIGINT // 1024 AS block FROM (
  SELECT y, size, repetition, md5('{seed}|block/'||(repetition // 2)||'/'||y||'|'||id) AS h FROM nb CROSS JOIN (SELECT unnest(range({repetitions}))::INT AS repetition))),
ct AS (SELECT y, size, repetition, block, unnest(range(count(*))) AS i FROM bl GROUP BY y, size, repetition, block),
dr AS (SELECT y, repetition, block * 1024 + 1 + floor(('0x'||substr(md5('{seed}|draw/'||repetition||'/'||y||'/'||block||'|'||(i // 4)), 1 + 8 * (i % 4)::INT, 8))::BIGINT
  / 4294967296.0 * least(1024, size - block * 1024))::BIGINT AS no FROM ct),
wt AS (SELECT repetition, nb.*, w FROM (SELECT y, repetition, no, count(*) AS w FROM dr GROUP BY ALL) JOIN nb USING (y, no))"""


@query(f"{_P}, {_drawn_sql(_DRAWS, 77)} SELECT repetition, y, yhat, sum(w)::BIGINT AS n FROM wt GROUP BY ALL")
def stratified_draws(spark, folder):
    """Exact resampling inside classes: every replicate keeps the class sizes."""
    drawn = ce.stratified_draws(predictions(spark, folder), "id", "y", _DRAWS, 77)
    return ce.label_counts(drawn, "y", "yhat", ["repetition"], "w")


@query(
    f"{_P}, {_drawn_sql(100, 78)}, {_REP_ROWS} SELECT metric, round(quantile_cont(value, 0.025), 6) AS ci_2_5, round(quantile_cont(value, 0.975), 6) AS ci_97_5 FROM rl GROUP BY metric"
)
def exact_intervals(spark, folder):
    """Intervals of the label metrics over 100 replicates that keep the class sizes."""
    out = ce.bootstrap_intervals(predictions(spark, folder), "id", "y", "yhat", K, RECALLS, 100, 78)
    return rounded(out, ["ci_2_5", "ci_97_5"])


_REP_LONG = " UNION ALL ".join(
    f"SELECT repetition, {k} AS class_code, p{k} AS score, w * (y = {k})::INT AS pos, w * (y <> {k})::INT AS neg FROM wt" for k in range(K)
)
_REP_PROB = {
    "multiclass_brier": " + ".join(f"power((y = {k})::INT - p{k}, 2)" for k in range(K)),
    "multiclass_log_loss": "-ln([p0, p1, p2, p3][y + 1])",
    "brier_highurgent": "power((y >= 2)::INT - (p2 + p3), 2)",
    "log_loss_highurgent": "-ln(CASE WHEN y >= 2 THEN p2 + p3 ELSE 1 - (p2 + p3) END)",
}
_REP_ALL = f"""{_REP_ROWS},
ws AS (SELECT repetition, class_code, score, sum(pos) AS pos, sum(neg) AS neg FROM ({_REP_LONG}) GROUP BY ALL),
wc AS (SELECT *, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp FROM ws WINDOW v AS (PARTITION BY repetition, class_code ORDER BY score DESC)),
wr AS (SELECT repetition, class_code, 1 - sum(pos * (fp - 0.5 * neg))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE AS auc,
  sum(CASE WHEN pos > 0 THEN pos * tp::DOUBLE / (tp + fp) ELSE 0 END) / sum(pos) AS ap FROM wc GROUP BY ALL),
wp AS (SELECT repetition, {', '.join(f'sum(w * ({v})) / sum(w) AS {n}' for n, v in _REP_PROB.items())} FROM wt GROUP BY repetition),
{_calibration_sql('repetition', 'w', 'wt')},
ra AS (SELECT repetition, metric, value FROM rl
  UNION ALL SELECT repetition, 'auc_roc_ovr_macro', avg(auc) FROM wr GROUP BY repetition
  UNION ALL SELECT repetition, 'auprc_alta', ap FROM wr WHERE class_code = 2 UNION ALL SELECT repetition, 'auprc_urgente', ap FROM wr WHERE class_code = 3
  {' '.join(f"UNION ALL SELECT repetition, '{n}', {n} FROM wp" for n in _REP_PROB)}
  UNION ALL SELECT repetition, 'calibration_intercept', a FROM cal WHERE it = 12
  UNION ALL SELECT repetition, 'calibration_slope', b FROM cal WHERE it = 12)"""


@query(
    f"{_P}, {_WEIGHTED}, {_REP_ALL} SELECT metric, round(quantile_cont(value, 0.025), 4) AS ci_2_5, round(quantile_cont(value, 0.975), 4) AS ci_97_5 FROM ra GROUP BY metric"
)
def probability_intervals(spark, folder):
    """Intervals of every metric of the report over the replicates, calibration included."""
    out = ce.bootstrap_intervals(
        predictions(spark, folder),
        "id",
        "y",
        "yhat",
        K,
        RECALLS,
        REPETITIONS,
        _SEED,
        PROBS,
        PRECISIONS,
        method="poisson",
        calibration=True,
    )
    return rounded(out, ["ci_2_5", "ci_97_5"], 4)


_RIVALS = {"argmax": "yhat", "one_up": "least(yhat + 1, 3)", "always_low": "0"}


@query(
    f"""{_P}, ri AS ({' UNION ALL '.join(f"SELECT '{n}' AS model, y, {e} AS yhat FROM pred" for n, e in _RIVALS.items())}),
rc AS (SELECT model, k, count(*) FILTER (WHERE y = k AND yhat = k)::DOUBLE AS tp, count(*) FILTER (WHERE yhat = k) + count(*) FILTER (WHERE y = k) AS whole
  FROM ri CROSS JOIN (SELECT unnest(range(4)) AS k) GROUP BY ALL),
rs AS (SELECT model, avg(coalesce(2 * tp / nullif(whole, 0), 0)) AS f FROM rc GROUP BY model)
SELECT 'line_items' AS dataset, model, round(f, 6) AS development_f1_macro,
  CASE WHEN row_number() OVER (ORDER BY f DESC, model) = 1 THEN 'highest development_f1_macro' END AS criterion FROM rs"""
)
def model_selection(spark, folder):
    """Development scores of rival predictions; the chosen model carries its criterion."""
    rivals = [F.struct(F.lit(n).alias("model"), F.expr(e).cast("int").alias("yhat")) for n, e in _RIVALS.items()]
    long = predictions(spark, folder).select("y", F.inline(F.array(*rivals)))
    metrics = ce.label_metrics(ce.label_counts(long, "y", "yhat", ["model"]), K, RECALLS, ["model"])
    summary = metrics.where("metric = 'f1_macro'").select(
        F.lit("line_items").alias("dataset"), "model", F.col("value").alias("development_f1_macro")
    )
    model, criterion = select_model(summary, "line_items")
    chosen = F.when(F.col("model") == model, F.lit(criterion))
    return rounded(summary.withColumn("criterion", chosen), ["development_f1_macro"])
