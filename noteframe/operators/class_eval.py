"""Evaluation of ordinal classifiers: label, ranking, probability and calibration metrics.

Label metrics come from the K x K counts, ranking metrics from one table of distinct
scores per class with running totals, and probability metrics from plain averages. All
operators take optional ``by`` columns and a row ``weight``, so the same code evaluates
bootstrap replicates, folds or scenarios in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as x
from ..functions.digests import Texts
from ..functions.hashing import poisson_draws, poisson_weights, uniform
from ..functions.scalar import clip, logit, row_total
from .extraction_eval import f1, intervals_of_long, quadratic_kappa, ratio
from ..sources.tables import stored
from .ordered import positions_by_draw, running_totals


def _weight(weight: str | None) -> Column:
    return F.lit(1).cast("bigint") if weight is None else F.col(weight)


def label_counts(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Counts per (by, y, yhat): at most K x K rows per group."""
    return df.groupBy(*by, F.col(y).cast("int").alias("y"), F.col(yhat).cast("int").alias("yhat")).agg(
        F.sum(_weight(weight)).alias("n")
    )


def dense_confusion(counts: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, y, yhat, n) with all K x K cells, zeros included; no label table is joined."""
    cells = [(i, j) for i in range(n_classes) for j in range(n_classes)]
    wide = counts.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.when((F.col("y") == i) & (F.col("yhat") == j), F.col("n"))), F.lit(0))
            .cast("bigint")
            .alias(f"c{i}_{j}")
            for i, j in cells
        ]
    )
    rows = [
        F.struct(F.lit(i).alias("y"), F.lit(j).alias("yhat"), F.col(f"c{i}_{j}").alias("n")) for i, j in cells
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def confusion_matrix(dense: DataFrame, labels: Sequence[str], by: Sequence[str] = (), row: str = "reference") -> DataFrame:
    """Dense counts as a matrix: one row per reference label, one column per predicted label."""
    wide = dense.groupBy(*by, "y").agg(
        *[F.sum(F.when(F.col("yhat") == j, F.col("n")).otherwise(0)).alias(label) for j, label in enumerate(labels)]
    )
    names = F.array(*[F.lit(v) for v in labels])
    return wide.select(*by, F.get(names, F.col("y")).alias(row), *labels)


def per_class(counts: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, class_code, precision, recall, f1, support) for the fixed class list."""
    classes = F.explode(F.array(*[F.lit(k) for k in range(n_classes)]))
    long = counts.select(*by, "y", "yhat", "n", classes.alias("class_code"))
    k, n = F.col("class_code"), F.col("n")
    sums = long.groupBy(*by, "class_code").agg(
        F.sum(F.when((F.col("y") == k) & (F.col("yhat") == k), n).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("yhat") == k, n).otherwise(0)).alias("found"),
        F.sum(F.when(F.col("y") == k, n).otherwise(0)).alias("support"),
    )
    tp, found, support = F.col("tp"), F.col("found"), F.col("support")
    return sums.select(
        *by,
        "class_code",
        ratio(tp, found).alias("precision"),
        ratio(tp, support).alias("recall"),
        f1(tp, found, support).alias("f1"),
        "support",
    )


def _long(wide: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return wide.select(*by, F.inline(F.array(*cells)))


def label_metrics(
    counts: DataFrame, n_classes: int, named_recalls: dict[str, int], by: Sequence[str] = ()
) -> DataFrame:
    """(by, metric, value): macro F1, quadratic kappa, ordinal MAE, recalls of named classes."""
    # At most K x K cells per group: every figure is a fold over one small array.
    packed = counts.groupBy(*by).agg(F.collect_list(F.struct("y", "yhat", "n")).alias("c"))

    def total(test: str, term: str = "z.n") -> str:
        return f"aggregate(filter(c, z -> {test}), 0D, (s, z) -> s + {term})"

    classes = ", ".join(
        x.struct(
            [
                ("tp", total(f"z.y = {k} AND z.yhat = {k}")),
                ("found", total(f"z.yhat = {k}")),
                ("support", total(f"z.y = {k}")),
            ]
        )
        for k in range(n_classes)
    )
    labels = "array_sort(array_distinct(concat(transform(c, z -> z.y), transform(c, z -> z.yhat))))"
    sums = packed.selectExpr(*by, "c", f"array({classes}) AS k", f"{labels} AS l").selectExpr(
        *by,
        "k",
        total("true") + " AS n",
        total("true", "abs(z.y - z.yhat) * z.n") + " AS gap",
        total("true", "pow(array_position(l, z.y) - array_position(l, z.yhat), 2) * z.n") + " AS o",
        f"transform(l, v -> {total('z.y = v')}) AS r",
        f"transform(l, v -> {total('z.yhat = v')}) AS p",
    )

    def moment(side: str, power: int) -> str:
        return f"aggregate(transform({side}, (v, i) -> v * pow(i, {power})), 0D, (s, v) -> s + v)"

    def share(part: str, whole: str) -> str:
        return f"CASE WHEN {whole} <> 0 THEN {part} / ({whole}) ELSE 0D END"

    f1s = f"transform(k, z -> {share('2 * z.tp', 'z.found + z.support')})"
    expected = f"({moment('r', 2)} + {moment('p', 2)} - 2D * {moment('r', 1)} * {moment('p', 1)} / n)"
    values = {
        "f1_macro": f"aggregate({f1s}, 0D, (s, v) -> s + v) / {n_classes}",
        **{name: share(f"get(k, {code}).tp", f"get(k, {code}).support") for name, code in named_recalls.items()},
        "ordinal_mae": "gap / nullif(n, 0D)",
        "weighted_kappa": f"1D - o / nullif({expected}, 0D)",
    }
    rows = ", ".join(x.struct([("metric", x.lit(name)), ("value", v)]) for name, v in values.items())
    return sums.select(*by, F.inline(F.expr(f"array({rows})")))


def score_table(
    df: DataFrame, y: str, probabilities: Sequence[str], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """(by, class_code, score, pos, neg): one row per distinct score and class."""
    rows = [
        F.struct(
            F.lit(k).alias("class_code"),
            F.col(p).cast("double").alias("score"),
            (F.col(y) == k).alias("is_class"),
        )
        for k, p in enumerate(probabilities)
    ]
    long = df.select(*by, _weight(weight).alias("w"), F.inline(F.array(*rows)))
    return long.groupBy(*by, "class_code", "score").agg(
        F.sum(F.when(F.col("is_class"), F.col("w")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("is_class"), 0).otherwise(F.col("w"))).alias("neg"),
    )


def ranking_metrics(scores: DataFrame, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """(by, class_code, auc, average_precision): one-vs-rest, ties averaged, step-rule AP.

    Rows that share a score are one row here, and running totals are cut into even buckets,
    so no class is ranked inside one task. NULL when a class has no positives or no negatives.
    """
    group = [*by, "class_code"]
    ranked = running_totals(
        scores, -F.col("score"), {"tp": F.col("pos"), "fp": F.col("neg")}, by=group, buckets=buckets
    )
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    sums = ranked.groupBy(*group).agg(
        F.sum(pos).alias("p"),
        F.sum(neg).alias("n"),
        F.sum(pos * (fp - F.lit(0.5) * neg)).alias("above"),
        F.sum(F.when(pos > 0, pos * tp / (tp + fp)).otherwise(0.0)).alias("steps"),
    )
    usable = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(
        *group,
        F.when(usable, F.lit(1.0) - F.col("above") / (F.col("p") * F.col("n"))).alias("auc"),
        F.when(usable, F.col("steps") / F.col("p")).alias("average_precision"),
    )


def macro_auc(ranking: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean one-vs-rest AUC; NULL if it is undefined for any class."""
    return ranking.groupBy(*by).agg(
        F.when(F.count("auc") == n_classes, F.avg("auc")).alias("auc_roc_ovr_macro")
    )


def probability_scores(
    df: DataFrame,
    y: str,
    probabilities: Sequence[str],
    high_from: int,
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """(by, multiclass and binary upper-band Brier score and log loss), one aggregation."""
    tiny = 2.220446049250313e-16
    target = F.col(y)
    brier = reduce(
        add, [F.pow(F.when(target == k, 1.0).otherwise(0.0) - F.col(p), 2) for k, p in enumerate(probabilities)]
    )
    chosen = F.get(F.array(*[F.col(p) for p in probabilities]), target.cast("int"))
    loss = -F.ln(clip(chosen, tiny, 1.0 - tiny))
    high = (target >= high_from).cast("double")
    p = clip(row_total(probabilities[high_from:]), 1e-6, 1.0 - 1e-6)
    binary_brier = F.pow(high - p, 2)
    binary_loss = -F.when(target >= high_from, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p))

    def mean(value: Column) -> Column:
        if weight is None:
            return F.avg(value)
        return F.sum(value * F.col(weight)) / F.sum(F.col(weight))

    return df.groupBy(*by).agg(
        mean(brier).alias("multiclass_brier"),
        mean(loss).alias("multiclass_log_loss"),
        mean(binary_brier).alias("brier_highurgent"),
        mean(binary_loss).alias("log_loss_highurgent"),
    )


def calibration_fit(
    df: DataFrame,
    y: str,
    probabilities: Sequence[str],
    high_from: int,
    by: Sequence[str] = (),
    weight: str | None = None,
    steps: int = 25,
    tolerance: float = 1e-10,
) -> DataFrame:
    """(by, calibration_intercept, calibration_slope): logistic fit of the outcome on logit(p).

    Newton's method: each step is one aggregation over the distinct scores of all groups at
    once (equal scores fold first), and the two parameters of each group (fold, replicate,
    scenario) are all that comes back. NULLs where one class is absent or scores do not vary.
    """
    scores = df.select(
        *by,
        (F.col(y) >= high_from).cast("double").alias("_t"),
        logit(row_total(probabilities[high_from:])).alias("_x"),
        _weight(weight).alias("_w"),
    )
    folded = scores.groupBy(*by, "_t", "_x").agg(F.sum("_w").cast("double").alias("_w"))
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    names = ("calibration_intercept", "calibration_slope")
    keys = [df.select(*by).schema[c] for c in by]
    state = T.StructType([*keys, T.StructField("_a", T.DoubleType()), T.StructField("_b", T.DoubleType())])
    fitted: dict[tuple, tuple[float, float] | None] = {}
    groups = folded.groupBy(*by).agg(F.min("_t").alias("low"), F.max("_t").alias("high")).collect()
    for row in groups:
        varied = row["low"] is not None and row["low"] != row["high"]
        fitted[tuple(row[c] for c in by)] = (0.0, 0.0) if varied else None
    m = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_a") + F.col("_b") * F.col("_x"))))
    gap, slope = F.col("_w") * (F.col("_t") - m), F.col("_w") * m * (F.lit(1.0) - m)
    sums = [gap, gap * F.col("_x"), slope, slope * F.col("_x"), slope * F.col("_x") * F.col("_x")]
    open_groups = {k for k, v in fitted.items() if v is not None}
    for _ in range(steps):
        if not open_groups:
            break
        now = df.sparkSession.createDataFrame([(*k, *fitted[k]) for k in open_groups], state)
        joined = reduce(lambda on, c: on & folded[c].eqNullSafe(now[c]), by, F.lit(True))
        rows = folded.join(now, joined) if by else folded.withColumns({c: F.lit(fitted[()][i]) for i, c in enumerate(("_a", "_b"))})
        totals = rows.groupBy(*[folded[c] for c in by]).agg(*[F.sum(v).alias(f"_s{i}") for i, v in enumerate(sums)])
        for row in totals.collect():
            key = tuple(row[: len(by)])
            g0, g1, h00, h01, h11 = row[len(by) :]
            det = h00 * h11 - h01 * h01
            # Scores that do not vary, or a perfect split, have no finite fit.
            if not det > 1e-12 * h00 * h11:
                fitted[key] = None
                open_groups.discard(key)
                continue
            da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            fitted[key] = (fitted[key][0] + da, fitted[key][1] + db)
            if max(abs(da), abs(db)) < tolerance:
                open_groups.discard(key)
    folded.unpersist()
    out = df.sparkSession.createDataFrame([(*k, *(v or (None, None))) for k, v in fitted.items()], state)
    return out.withColumnsRenamed(dict(zip(("_a", "_b"), names, strict=True)))


def calibration_curve(
    df: DataFrame, y: str, probabilities: Sequence[str], high_from: int, n_bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """(by, target, bin, n, mean_predicted, observed_fraction); right-closed bins, empty ones left out."""
    edges = [i * (1.0 / n_bins) for i in range(1, n_bins)]

    def row(name: str, seen: Column, p: Column) -> Column:
        return F.struct(F.lit(name).alias("target"), seen.cast("double").alias("seen"), p.alias("p"))

    rows = [row(f"class_{k}", F.col(y) == k, F.col(c)) for k, c in enumerate(probabilities)]
    rows.append(row("high_or_urgent", F.col(y) >= high_from, row_total(probabilities[high_from:])))
    long = df.select(*by, F.inline(F.array(*rows)))
    bin_index = reduce(add, [(F.col("p") > e).cast("int") for e in edges], F.lit(0))
    return long.groupBy(*by, "target", bin_index.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg("seen").alias("observed_fraction")
    )


def class_weights(df: DataFrame, y: str, out: str = "class_weight") -> DataFrame:
    """Add the balanced weight n / (K * n_class) of each row's class."""
    sizes, total, k = class_sizes(df, y)
    return df.withColumn(out, total / (k * F.element_at(sizes, F.col(y))))


def class_sizes(df: DataFrame, y: str) -> tuple[Column, Column, Column]:
    """(map class -> rows, all rows, number of classes) as scalar subqueries over closed classes."""
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    stats = counts.agg(
        F.struct(
            F.map_from_entries(F.collect_list(F.struct(F.col(y), F.col("n")))).alias("sizes"),
            F.sum("n").alias("n"),
            F.count("*").alias("k"),
        ).alias("s")
    ).scalar()
    return stats["sizes"], stats["n"], stats["k"]


def classification_report(
    df: DataFrame,
    y: str,
    yhat: str,
    n_classes: int,
    named_recalls: dict[str, int],
    probabilities: Sequence[str] | None = None,
    named_precisions: dict[str, int] | None = None,
    high_from: int = 2,
    by: Sequence[str] = (),
    weight: str | None = None,
    calibration: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """(by, metric, value): every metric that applies; label metrics only without probabilities."""
    out = label_metrics(label_counts(df, y, yhat, by, weight), n_classes, named_recalls, by)
    if probabilities is None:
        return out
    ranking = ranking_metrics(score_table(df, y, probabilities, by, weight), by, buckets)
    precisions = [
        F.max(F.when(F.col("class_code") == code, F.col("average_precision"))).alias(name)
        for name, code in (named_precisions or {}).items()
    ]
    ranked = ranking.groupBy(*by).agg(
        F.when(F.count("auc") == n_classes, F.avg("auc")).alias("auc_roc_ovr_macro"), *precisions
    )
    scores = probability_scores(df, y, probabilities, high_from, by, weight)
    out = out.unionByName(_long(ranked, by, ["auc_roc_ovr_macro", *(named_precisions or {})])).unionByName(
        _long(
            scores,
            by,
            ["multiclass_brier", "multiclass_log_loss", "brier_highurgent", "log_loss_highurgent"],
        )
    )
    if calibration:
        fit = calibration_fit(df, y, probabilities, high_from, by, weight)
        out = out.unionByName(_long(fit, by, ["calibration_intercept", "calibration_slope"]))
    return out


def poisson_replicates(df: DataFrame, key: str, repetitions: int, seed: int) -> DataFrame:
    """One row per key and replicate it enters, with its Poisson(1) weight ``w``.

    Weights are hashes of (seed, replicate, key). Class sizes are kept on average.
    """
    drawn = df.select("*", F.inline_outer(poisson_draws(seed, key, repetitions)))
    return drawn.where("w IS NOT NULL")


def _block_counts(ends: np.ndarray, seed: int, repetitions: int, block: int) -> Callable:
    """Arrow map: (cell, counts), how often the replicates' draws of a task's rows pick a block.

    A draw is half of md5(seed|block/<half of the replicate>/<class>|<key>), taken times the size
    of the row's class. Cells number the blocks of all classes; ``counts`` is empty where a row
    is no draw.
    """
    cells = int(ends[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((repetitions, cells), np.uint32)
        waiting: list[np.ndarray] = []

        def add() -> None:
            met = np.concatenate(waiting, 1)
            for r in range(repetitions):
                total[r] += np.bincount(met[r], minlength=cells).astype(np.uint32)
            waiting.clear()

        for batch in batches:
            n, low = (batch.column(c).to_numpy().astype(float) for c in ("n", "low"))
            met = np.zeros((repetitions, batch.num_rows), np.int64)
            texts = Texts(batch.column("text"))
            for g in range((repetitions + 1) // 2):
                words = texts.md5(f"{seed}|block/{g}").view(">u8")
                halves = (words[:, 0] >> 12, ((words[:, 0] & 0xFFF) << 40) | (words[:, 1] >> 24))
                for r, u in zip(range(2 * g, min(2 * g + 2, repetitions)), halves):
                    met[r] = np.floor(u.astype(float) / 2.0**52 * n) // block + low
            waiting.append(met)
            if sum(w.shape[1] for w in waiting) >= 1 << 16:
                add()
        if waiting:
            add()
        for at in range(0, cells, 4096):
            part = np.ascontiguousarray(total[:, at : at + 4096].T)
            found = part.any(1).nonzero()[0]
            if len(found):
                kind = "<u4" if part.max() > 0xFFFF else "<u2" if part.max() > 0xFF else "u1"
                counts = [part[i].astype(kind).tobytes() for i in found]
                yield pa.RecordBatch.from_arrays([pa.array(found + at), pa.array(counts, pa.binary())], ["_cell", "_counts"])

    return run


def _inside(cell: int, counts: Sequence[bytes], ends: np.ndarray, classes: Sequence, seed: int, repetitions: int, block: int) -> np.ndarray:
    """(place in the block, replicate): how often the draws that picked the block pick a place."""
    total = sum(np.frombuffer(c, {1: "u1", 2: "<u2", 4: "<u4"}[len(c) // repetitions]).astype(np.int64) for c in counts)
    k = int(np.searchsorted(ends, cell, "right"))
    number = cell - (int(ends[k - 1]) if k else 0)
    name, size = classes[k]
    room = min(block, size - number * block)
    hashes = (total + 3) // 4
    g = np.arange(int(hashes.sum())) - np.repeat(np.cumsum(hashes) - hashes, hashes)
    words = Texts(pa.array([str(v) for v in range(int(hashes.max(initial=0)))], pa.string()).take(pa.array(g))).md5(
        [f"{seed}|draw/{r}/{name}/{number}|" for r in range(repetitions)], np.repeat(np.arange(repetitions), hashes)
    )
    place = np.floor(words.view(">u4").astype(float) / 2.0**32 * room).astype(np.int64)
    used = 4 * g[:, None] + np.arange(4) < np.repeat(total, hashes)[:, None]
    code = place * repetitions + np.repeat(np.arange(repetitions), hashes)[:, None]
    return np.bincount(code[used], minlength=room * repetitions).reshape(room, repetitions)


def stratified_weights(
    df: DataFrame, key: str, y: str, repetitions: int, seed: int, block: int = 1024, out: str = "weights"
) -> DataFrame:
    """Exact resampling inside each class: per row, how often each replicate draws it (array).

    The rows of a class are numbered in hash order and cut into blocks of ``block`` numbers.
    First every draw picks a block, and each task sums up what its rows pick; then the rows of a
    block and its counts meet in one group, where the draws pick rows. Rows are shuffled once,
    nothing is joined with them but running totals, and replicates are not unfolded.
    """
    sizes = sorted((str(r[y]), r[y], r["n"]) for r in df.groupBy(y).agg(F.count("*").alias("n")).collect())
    if not sizes:
        return df.withColumn(out, F.array().cast("array<int>"))
    if any(v is None for _, v, _ in sizes):
        raise ValueError(f"{y} is null in some rows")
    classes = [(name, n) for name, _, n in sizes]
    ends = np.cumsum([-(-n // block) for _, n in classes])
    of = lambda values: F.element_at(F.create_map(*[F.lit(v) for (_, k, _), n in zip(sizes, values) for v in (k, int(n))]), F.col(y))
    low = of([0, *ends[:-1]]).cast("bigint")
    text = F.concat(F.lit("/"), F.col(y).cast("string"), F.lit("|"), F.col(key).cast("string"))
    drawn = df.select(of([n for _, n in classes]).cast("bigint").alias("n"), low.alias("low"), text.alias("text"))
    counts = drawn.where("text IS NOT NULL").mapInArrow(_block_counts(ends, seed, repetitions, block), "_cell long, _counts binary")
    numbered = positions_by_draw(df.withColumn("_u", uniform(seed, key, "order")), "_u", key, "_no", by=[y])
    cell = (low + F.floor((F.col("_no") - 1) / block)).cast("bigint")
    members = numbered.drop("_u").withColumn("_cell", cell)
    met = members.unionByName(counts, allowMissingColumns=True)
    names = df.columns

    def weigh(group: pa.Table) -> pa.Table:
        counted = pc.is_valid(group["_counts"])
        rows = group.filter(pc.invert(counted)).sort_by("_no")
        parts = group["_counts"].filter(counted).to_pylist()
        found = np.zeros((rows.num_rows, repetitions), np.int32)
        if parts:
            drawn = _inside(group["_cell"][0].as_py(), parts, ends, classes, seed, repetitions, block)
            found[: len(drawn)] = drawn[: len(found)]
        lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * repetitions, pa.array(found.ravel()))
        return rows.select(names).append_column(out, lists)

    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema.fields], T.StructField(out, T.ArrayType(T.IntegerType()))])
    return met.groupBy("_cell").applyInArrow(weigh, schema)


def stratified_draws(
    df: DataFrame, key: str, y: str, repetitions: int, seed: int, block: int = 1024
) -> DataFrame:
    """Exact resampling inside each class: n_class draws with replacement per replicate.

    Returns the rows of ``df`` with ``repetition`` and ``w``, the times that a replicate draws
    them (``stratified_weights``).
    """
    weighed = stratified_weights(df, key, y, repetitions, seed, block, "_weights")
    rows = weighed.select(*[F.col(f"`{c}`") for c in df.columns], F.posexplode("_weights").alias("repetition", "w"))
    return rows.where("w > 0").withColumn("w", F.col("w").cast("bigint"))


def folded_replicates(weighed: DataFrame, columns: Sequence[str], repetitions: int, weights: str = "weights") -> DataFrame:
    """(columns, repetition, w): equal rows fold into one before their replicates unfold."""
    sums = [F.sum(F.get(weights, F.lit(r))).alias(f"_w{r}") for r in range(repetitions)]
    folded = weighed.groupBy(*columns).agg(*sums)
    rows = folded.select(*columns, F.posexplode(F.array(*[F.col(f"_w{r}") for r in range(repetitions)])).alias("repetition", "w"))
    return rows.where("w > 0")


def bootstrap_intervals(
    df: DataFrame,
    key: str,
    y: str,
    yhat: str,
    n_classes: int,
    named_recalls: dict[str, int],
    repetitions: int,
    seed: int,
    probabilities: Sequence[str] | None = None,
    named_precisions: dict[str, int] | None = None,
    method: str = "exact",
    high_from: int = 2,
    calibration: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """(metric, ci_2_5, ci_97_5) over replicates of the classification report.

    ``method='exact'`` draws inside each class as a finite sample does; ``'poisson'`` weighs
    rows independently, without a shuffle of the rows. Rows that agree in class, prediction and
    probabilities fold into one with a weight per replicate before anything is measured.
    """
    told = [y, yhat, *(probabilities or [])]
    slim = df.select(*dict.fromkeys([key, *told]))
    if method == "exact":
        weighed = stratified_weights(slim, key, y, repetitions, seed)
    else:
        weighed = slim.withColumn("weights", poisson_weights(seed, key, repetitions))
    replicates = folded_replicates(weighed, told, repetitions)
    if probabilities is not None:  # many parts of the report read them
        replicates = stored(replicates)
    report = classification_report(
        replicates,
        y,
        yhat,
        n_classes,
        named_recalls,
        probabilities,
        named_precisions,
        high_from,
        by=["repetition"],
        weight="w",
        calibration=calibration,
        buckets=buckets,
    )
    return intervals_of_long(report, [], with_mean=False)
