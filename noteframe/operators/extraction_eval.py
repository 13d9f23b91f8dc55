"""Marker-by-marker evaluation of an extractor against reference markers.

Everything here is derived from one small table, the *qualifier cube*: the number of keys
per (extractor, marker, reference fields, predicted fields). All fields come from closed
value lists, so the cube is bounded whatever the number of keys, and the data is read
and shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as x
from ..functions.hashing import poisson_draws
from ..functions.scalar import number_or
from ..sources.tables import stored
from .markers import BINARY_FIELDS, CATEGORY_FIELDS, FEATURE_FIELDS, Ontology

DIMENSIONS = (*BINARY_FIELDS, *CATEGORY_FIELDS, "severity_code")


def qualifier_cube(pairs: DataFrame, by: Sequence[str] = ("extractor",)) -> DataFrame:
    """Counts per (by, marker, ref fields, pred fields) from ``paired_markers`` rows."""
    columns = [*by, "marker", *[f"ref_{f}" for f in FEATURE_FIELDS], *[f"pred_{f}" for f in FEATURE_FIELDS]]
    return pairs.groupBy(*columns).agg(F.count("*").alias("n"))


def _integer(name: str) -> Column:
    return number_or(F.col(name), 0.0, "int")


def confusion_long(
    cube: DataFrame, by: Sequence[str] = ("extractor",), missing: str = "missing", coerce: bool = False
) -> DataFrame:
    """(by, marker, dimension, reference, predicted, count), non-zero cells.

    Presence dimensions count all keys; the qualifier dimensions only keys whose reference
    expresses the marker (present, denied or remote). ``coerce`` reads the numeric
    dimensions as integers with 0 for absent values.
    """
    expressed = (_integer("ref_present") + _integer("ref_negated") + _integer("ref_remote_present")) > 0

    def text(side: str, f: str) -> Column:
        if coerce and (f in BINARY_FIELDS or f == "severity_code"):
            return _integer(f"{side}_{f}").cast("string")
        return F.coalesce(F.col(f"{side}_{f}").cast("string"), F.lit(missing))

    cells = [
        F.struct(
            F.lit(f).alias("dimension"),
            text("ref", f).alias("reference"),
            text("pred", f).alias("predicted"),
            (F.lit(True) if f in BINARY_FIELDS else expressed).alias("counted"),
        )
        for f in DIMENSIONS
    ]
    long = cube.select(*by, "marker", "n", F.inline(F.array(*cells))).where("counted")
    return long.groupBy(*by, "marker", "dimension", "reference", "predicted").agg(F.sum("n").alias("count"))


def _dense_codes(cells: DataFrame, group: Sequence[str], left: str, right: str, weight: str) -> DataFrame:
    """Replace both labels by their position in the sorted union of labels of the group."""
    labels = cells.groupBy(*group).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array(left, right))))).alias("_labels"),
        F.count_distinct(left).alias("_left_values"),
    )
    if group:
        joined = cells.join(labels, list(group))
    else:
        row = labels.select(F.struct("*").alias("s")).scalar()
        joined = cells.withColumns({"_labels": row["_labels"], "_left_values": row["_left_values"]})
    return joined.select(
        *group,
        (F.array_position("_labels", F.col(left)) - 1).cast("double").alias("i"),
        (F.array_position("_labels", F.col(right)) - 1).cast("double").alias("j"),
        F.col(weight).cast("double").alias("w"),
        "_left_values",
    )


def quadratic_kappa(
    cells: DataFrame, group: Sequence[str], left: str, right: str, weight: str, need_two: bool = False
) -> DataFrame:
    """Quadratic weighted kappa per group from label-pair counts.

    Weights use the positions of the labels that occur (the usual definition when no label
    list is given). The expected disagreement only needs first and second moments, so no
    pairwise product of marginals is built.
    """
    coded = _dense_codes(cells, group, left, right, weight)
    i, j, w = F.col("i"), F.col("j"), F.col("w")
    sums = coded.groupBy(*group).agg(
        F.sum(w).alias("n"),
        F.sum(w * (i - j) * (i - j)).alias("o"),
        F.sum(w * i * i).alias("ii"),
        F.sum(w * j * j).alias("jj"),
        F.sum(w * i).alias("si"),
        F.sum(w * j).alias("sj"),
        F.max("_left_values").alias("values"),
    )
    expected = F.col("ii") + F.col("jj") - F.lit(2.0) * F.col("si") * F.col("sj") / F.col("n")
    kappa = F.when(expected != 0, F.lit(1.0) - F.col("o") / expected)
    return sums.select(*group, (F.when(F.col("values") >= 2, kappa) if need_two else kappa).alias("kappa"))


def plain_kappa(
    cells: DataFrame, group: Sequence[str], left: str, right: str, weight: str, need_two: bool = True
) -> DataFrame:
    """Cohen's kappa per group from label-pair counts; NULL when the left side has < 2 values."""
    side = F.inline(
        F.array(
            F.struct(F.col(left).alias("label"), F.col(weight).alias("l"), F.lit(0).cast("bigint").alias("r")),
            F.struct(F.col(right).alias("label"), F.lit(0).cast("bigint").alias("l"), F.col(weight).alias("r")),
        )
    )
    marginals = (
        cells.select(*group, side)
        .groupBy(*group, "label")
        .agg(F.sum("l").cast("double").alias("l"), F.sum("r").cast("double").alias("r"))
        .groupBy(*group)
        .agg(F.sum(F.col("l") * F.col("r")).alias("chance"), F.count_if(F.col("l") > 0).alias("values"))
    )
    observed = cells.groupBy(*group).agg(
        F.sum(F.col(weight)).cast("double").alias("n"),
        F.sum(F.when(F.col(left) == F.col(right), F.col(weight)).otherwise(0)).cast("double").alias("same"),
    )
    both = observed.join(marginals, list(group))
    n, same, chance = F.col("n"), F.col("same"), F.col("chance")
    kappa = F.when(chance != n * n, F.lit(1.0) - (F.lit(1.0) - same / n) / (F.lit(1.0) - chance / (n * n)))
    return both.select(*group, (F.when(F.col("values") >= 2, kappa) if need_two else kappa).alias("kappa"))


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole as double; ``empty`` when whole is 0."""
    fallback = F.lit(empty).cast("double")
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(fallback)


def f1(tp: Column, predicted: Column, actual: Column) -> Column:
    return ratio(F.lit(2) * tp, predicted + actual)


def marker_metrics(cube: DataFrame, by: Sequence[str] = ("extractor",)) -> DataFrame:
    """(by, marker, dimension, n, precision, recall, f1, accuracy, kappa, mae).

    Precision, recall and F1 exist for the presence dimensions only, the mean absolute
    error for the severity code only.
    """
    group = [*by, "marker", "dimension"]
    cells = confusion_long(cube, by, missing="", coerce=True)
    # One row per group: the labels are closed lists, so a group holds a few dozen cells at
    # most, and every figure is a fold over that array (no join, no second pass).
    packed = cells.groupBy(*group).agg(
        F.collect_list(F.struct("reference", "predicted", F.col("count").alias("n"))).alias("c")
    )

    def total(test: str, term: str = "z.n", start: str = "0L") -> str:
        return f"aggregate(filter(c, z -> {test}), {start}, (s, z) -> s + {term})"

    labelled = packed.withColumn(
        "l",
        F.expr("array_sort(array_distinct(concat(transform(c, z -> z.reference), transform(c, z -> z.predicted))))"),
    )
    sums = labelled.selectExpr(
        *group,
        f"{total('true')} AS n",
        total("z.reference = '1' AND z.predicted = '1'") + " AS tp",
        total("z.predicted = '1'") + " AS found",
        total("z.reference = '1'") + " AS actual",
        total("z.reference = z.predicted") + " AS same",
        total("true", "coalesce(abs(try_cast(z.reference AS DOUBLE) - try_cast(z.predicted AS DOUBLE)), 0D) * z.n", "0D")
        + " AS gap",
        total("true", "pow(array_position(l, z.reference) - array_position(l, z.predicted), 2) * z.n", "0D") + " AS o",
        f"transform(l, v -> double({total('z.reference = v')})) AS r",
        f"transform(l, v -> double({total('z.predicted = v')})) AS p",
    )

    def moment(side: str, power: int) -> str:
        return f"aggregate(transform({side}, (v, i) -> v * pow(i, {power})), 0D, (s, v) -> s + v)"

    chance = "aggregate(zip_with(r, p, (a, b) -> a * b), 0D, (s, v) -> s + v)"
    plain = f"1D - (1D - same / n) / (1D - {chance} / (double(n) * n))"
    expected = f"({moment('r', 2)} + {moment('p', 2)} - 2D * {moment('r', 1)} * {moment('p', 1)} / n)"
    varied = "size(filter(r, v -> v > 0)) >= 2"
    binary = x.one_of("dimension", BINARY_FIELDS)
    coded = "dimension = 'severity_code'"

    def share(part: str, whole: str, only: str) -> str:
        return f"CASE WHEN {only} THEN CASE WHEN {whole} <> 0 THEN double({part}) / ({whole}) ELSE 0D END END"

    return sums.selectExpr(
        *group,
        "n",
        share("tp", "found", binary) + " AS precision",
        share("tp", "actual", binary) + " AS recall",
        share("2 * tp", "found + actual", binary) + " AS f1",
        "double(same) / n AS accuracy",
        f"CASE WHEN {varied} THEN CASE WHEN {coded} THEN 1D - o / nullif({expected}, 0D) ELSE {plain} END END AS kappa",
        f"CASE WHEN {coded} THEN gap / n END AS mae",
    )


def presence_scores(pairs: DataFrame, by: Sequence[str] = ("extractor",)) -> DataFrame:
    """(by, marker, n, precision, recall, f1) of presence alone; other fields are not read."""
    ref, pred = _integer("ref_present"), _integer("pred_present")
    counts = pairs.groupBy(*by, "marker").agg(
        F.count("*").alias("n"),
        F.count_if((ref == 1) & (pred == 1)).alias("tp"),
        F.count_if(pred == 1).alias("found"),
        F.count_if(ref == 1).alias("actual"),
    )
    tp, found, actual = F.col("tp"), F.col("found"), F.col("actual")
    return counts.select(
        *by,
        "marker",
        "n",
        ratio(tp, found).alias("precision"),
        ratio(tp, actual).alias("recall"),
        f1(tp, found, actual).alias("f1"),
    )


def presence_counts(
    cube: DataFrame, by: Sequence[str] = ("extractor",), absent: str = "absent"
) -> DataFrame:
    """Per (by, marker): tp, fp, fn, tn of presence; fields compared and wrong of expressed rows.

    The qualifier errors cover four categories and the severity code.
    """
    ref, pred, n = _integer("ref_present"), _integer("pred_present"), F.col("n")
    expressed = (ref + _integer("ref_negated") + _integer("ref_remote_present")) > 0

    def total(test: Column, name: str, value: Column = n) -> Column:
        return F.sum(F.when(test, value).otherwise(0)).alias(name)

    def differs(f: str) -> Column:
        left = F.coalesce(F.col(f"ref_{f}").cast("string"), F.lit(absent))
        right = F.coalesce(F.col(f"pred_{f}").cast("string"), F.lit(absent))
        return (left != right).cast("int")

    wrong = sum([differs(f) for f in CATEGORY_FIELDS], F.lit(0)) + (
        _integer("ref_severity_code") != _integer("pred_severity_code")
    ).cast("int")
    return cube.groupBy(*by, "marker").agg(
        total((ref == 1) & (pred == 1), "tp"),
        total((ref == 0) & (pred == 1), "fp"),
        total((ref == 1) & (pred == 0), "fn"),
        total((ref == 0) & (pred == 0), "tn"),
        total(expressed, "compared", n * (len(CATEGORY_FIELDS) + 1)),
        total(expressed, "wrong", n * wrong),
    )


def extraction_summary(
    cube: DataFrame, by: Sequence[str] = ("extractor",), absent: str = "absent", status: DataFrame | None = None
) -> DataFrame:
    """One row per extractor: macro and micro scores, omission, hallucination, qualification errors.

    The cube is read once. Without a ``status`` table no row failed or was retried.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    s_tp, s_fp, s_fn, s_tn = (F.sum(c) for c in ("tp", "fp", "fn", "tn"))
    out = presence_counts(cube, by, absent).groupBy(*by).agg(
        F.max(tp + fp + fn + tn).alias("n"),
        F.avg(ratio(tp, tp + fp)).alias("macro_precision"),
        F.avg(ratio(tp, tp + fn)).alias("macro_recall"),
        F.avg(f1(tp, tp + fp, tp + fn)).alias("macro_f1"),
        ratio(s_tp, s_tp + s_fp).alias("micro_precision"),
        ratio(s_tp, s_tp + s_fn).alias("micro_recall"),
        f1(s_tp, s_tp + s_fp, s_tp + s_fn).alias("micro_f1"),
        ratio(s_fn, s_tp + s_fn).alias("omission_rate"),
        ratio(s_fp, s_fp + s_tn).alias("hallucination_rate"),
        ratio(F.sum("wrong"), F.sum("compared")).alias("qualification_error_rate"),
    )
    if status is None:
        none = F.lit(0).cast("bigint")
        return out.withColumns({"failed_extractions": none, "retry_count": none})
    return out.join(status, list(by), "left")


def status_counts(predicted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Failed rows and retries per extractor; absent columns mean success and 0."""
    failed = (
        F.count_if(F.col("extraction_status") == "failed") if "extraction_status" in predicted.columns else F.lit(0)
    )
    retries = F.sum(number_or(F.col("retry_count"))) if "retry_count" in predicted.columns else F.lit(0)
    return predicted.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        failed.cast("bigint").alias("failed_extractions"),
        retries.cast("bigint").alias("retry_count"),
    )


def stability(runs: DataFrame, columns: Sequence[str], fields: Sequence[str] = FEATURE_FIELDS) -> DataFrame:
    """Agreement of every unordered pair of runs per marker and field (NULL equals NULL).

    ``runs`` holds one row per key and the nested markers of each run in a column of the
    run's name (``extract_variants``; runs of other sources are joined on the key first).
    """
    names = sorted(columns)

    def same(a: str, b: str) -> Column:
        return F.zip_with(
            a,
            b,
            lambda left, right: F.struct(
                left["marker"].alias("marker"),
                *[left[f].eqNullSafe(right[f]).cast("int").alias(f) for f in fields],
            ),
        )

    pairs = [
        F.struct(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"), same(a, b).alias("cells"))
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    long = runs.select(F.inline(F.array(*pairs))).select("run_a", "run_b", F.inline_outer("cells"))
    sums = long.groupBy("run_a", "run_b", "marker").agg(
        F.count("*").alias("n"), *[F.sum(f).alias(f) for f in fields]
    )
    cells = [F.struct(F.lit(f).alias("dimension"), (F.col(f) / F.col("n")).alias("agreement")) for f in fields]
    return sums.select("run_a", "run_b", "marker", "n", F.inline(F.array(*cells)))


def annotator_agreement(
    left: DataFrame | None, right: DataFrame | None, key: str, spark=None, fields: Sequence[str] = FEATURE_FIELDS
) -> DataFrame:
    """Agreement and kappa per marker and field on values both annotators filled in.

    Inputs are nested marker tables with NULL for values left blank. Without one of them
    the result is a single ``pending`` row.
    """
    if left is None or right is None:
        return spark.range(1).select(
            F.lit("pending").alias("status"), F.lit("two annotated tables are needed").alias("reason")
        )
    a = left.select(key, F.col("markers").alias("a"))
    b = right.select(key, F.col("markers").alias("b"))
    return agreement_of_columns(a.join(b, key), "a", "b", fields)


def agreement_of_columns(
    df: DataFrame, left: str, right: str, fields: Sequence[str] = FEATURE_FIELDS
) -> DataFrame:
    """``annotator_agreement`` of two nested marker columns of one row."""
    cell = lambda a, b, f: F.struct(
        a["marker"].alias("marker"),
        F.lit(f).alias("dimension"),
        a[f].cast("string").alias("left"),
        b[f].cast("string").alias("right"),
    )
    cells = F.flatten(F.zip_with(left, right, lambda a, b: F.array(*[cell(a, b, f) for f in fields])))
    group = ["marker", "dimension"]
    # a few counts per marker and field, read three times: the texts behind them are read once
    counts = stored(df.select(F.inline_outer(cells)).groupBy(*group, "left", "right").agg(F.count("*").alias("count")))
    both = counts.where("left is not null and right is not null")
    observed = counts.groupBy(*group).agg(
        F.sum(F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), F.col("count")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("left") == F.col("right"), F.col("count")).otherwise(0)).alias("same"),
    )
    kappa = plain_kappa(both, group, "left", "right", "count")
    return observed.join(kappa, group, "left").select(
        *group, "n", ratio(F.col("same"), F.col("n"), None).alias("agreement"), "kappa"
    )


def extraction_bootstrap(
    pairs: DataFrame, key: str, ontology: Ontology, repetitions: int, seed: int, by: Sequence[str] = ("extractor",)
) -> DataFrame:
    """(by, repetition, macro_f1, micro_f1) of resampled keys.

    Each key enters a replicate with a Poisson(1) weight (a hash of seed, replicate, key):
    the distributed form of drawing keys with replacement. Replicate sizes vary around the
    number of keys. ``pairs`` holds the nested reference and prediction per key in columns
    ``ref`` and ``pred``; only 3 counts per marker are shuffled, per replicate.
    """
    marks = []
    for i in range(len(ontology.names)):
        truth = F.get(F.col("ref"), F.lit(i))["present"] == 1
        found = F.get(F.col("pred"), F.lit(i))["present"] == 1
        marks += [(f"tp{i}", truth & found), (f"fp{i}", ~truth & found), (f"fn{i}", truth & ~found)]
    slim = pairs.select(*by, key, *[c.cast("int").alias(n) for n, c in marks])
    names = [n for n, _ in marks]
    weighted = slim.select(*by, *names, F.inline_outer(poisson_draws(seed, key, repetitions))).where("w IS NOT NULL")
    sums = weighted.groupBy(*by, "repetition").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n, _ in marks])
    return _f1_of_counts(sums, [*by, "repetition"], len(ontology.names))


def _f1_of_counts(sums: DataFrame, keep: Sequence[str], n_markers: int) -> DataFrame:
    per_marker = [
        f1(F.col(f"tp{i}"), F.col(f"tp{i}") + F.col(f"fp{i}"), F.col(f"tp{i}") + F.col(f"fn{i}"))
        for i in range(n_markers)
    ]
    total = lambda p: sum([F.col(f"{p}{i}") for i in range(n_markers)], F.lit(0))
    tp, fp, fn = total("tp"), total("fp"), total("fn")
    macro = sum(per_marker, F.lit(0.0)) / F.lit(float(n_markers))
    return sums.select(*keep, macro.alias("macro_f1"), f1(tp, tp + fp, tp + fn).alias("micro_f1"))


def percentile_intervals(
    samples: DataFrame, by: Sequence[str], metrics: Sequence[str], with_mean: bool = True
) -> DataFrame:
    """(by, metric, mean, ci_2_5, ci_97_5): exact linear quantiles over replicates.

    The groups hold one value per replicate, so an exact percentile is bounded.
    """
    long = samples.select(
        *by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    )
    return intervals_of_long(long, by, with_mean)


def intervals_of_long(long: DataFrame, by: Sequence[str], with_mean: bool = True) -> DataFrame:
    return long.groupBy(*by, "metric").agg(
        *([F.avg("value").alias("mean")] if with_mean else []),
        F.percentile("value", 0.025).alias("ci_2_5"),
        F.percentile("value", 0.975).alias("ci_97_5"),
    )
