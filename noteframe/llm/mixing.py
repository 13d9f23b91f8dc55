"""Mixing sources to target weights along a time-varying curriculum, with SQL functions only.

Targets come from water-filling: sources share all words by weight, none takes more than
``cap`` times its size, and the excess goes to the others by weight. Every source has a
schedule of weights over training time; its integral, scaled to the target, is the source's
cumulative token demand. Documents of a source stand in hash order; the words before a
document are inverted through the demand into a training time, and the mix is sorted by it.

No source is put into one task: the order inside a source is cut by the leading digits of a
hash into even buckets, a window runs inside a bucket and the totals of earlier buckets come
from a table with one row per source and bucket. Windows over that table hold one row per
source (or bucket of a source), never documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Weight over training time of the sources of each weight class: (time, factor) knots.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def _segments(knots: Sequence[tuple[float, float]]) -> str:
    """A schedule as an array of segments with the share of its integral before and after."""
    pairs = list(zip(knots, knots[1:], strict=False))
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pairs]
    total, before, out = sum(areas), 0.0, []
    for (a, b), area in zip(pairs, areas, strict=True):
        if area > 0:
            out.append(
                f"named_struct('t', {a[0]!r}D, 'w', {a[1]!r}D, "
                f"'slope', {(b[1] - a[1]) / (b[0] - a[0])!r}D, 'low', {before!r}D, "
                f"'high', {before + area!r}D, 'all', {total!r}D)"
            )
        before += area
    return f"array({', '.join(out)})"


def _inverse(share: str, segments: str) -> str:
    """SQL of the training time at which a share (0 to 1) of the schedule's integral is met."""
    area = f"({share}) * {segments}[0].all"
    hit = f"coalesce(get(filter({segments}, s -> {area} < s.high), 0), element_at({segments}, -1))"
    rest = f"({area} - s.low)"
    root = f"sqrt(greatest(s.w * s.w + 2 * s.slope * {rest}, 0D))"
    time = f"CASE WHEN s.w + {root} > 0 THEN s.t + 2 * {rest} / (s.w + {root}) ELSE s.t END"
    return f"transform(array({hit}), s -> {time})[0]"


def source_targets(totals: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """(source, bucket, base, source_size, target, class) from sizes per source and bucket.

    ``base`` counts the source's words in earlier buckets.
    """
    inside = W.partitionBy("source")
    sized = totals.withColumns(
        {
            "base": F.sum("words").over(inside.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
            - F.col("words"),
            "source_size": F.sum("words").over(inside),
        }
    )
    sources = sized.groupBy("source").agg(F.first("source_size").alias("size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")
    )
    sources = sources.withColumn("place", place).withColumn("weight", weight)
    order = W.orderBy(F.col("ratio"), F.col("place"))
    up_to = order.rowsBetween(W.unboundedPreceding, 0)
    onward = order.rowsBetween(0, W.unboundedFollowing)
    level = (
        (F.sum("size").over(W.partitionBy()) - F.lit(cap) * (F.sum("size").over(up_to) - F.col("size")))
        / F.sum("weight").over(onward)
    )
    filled = sources.withColumn("ratio", F.lit(cap) * F.col("size") / F.col("weight")).withColumn(
        "level", level
    )
    reached = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(
        W.partitionBy()
    )["level"]
    target = F.least(F.col("weight") * reached, F.lit(float(cap)) * F.col("size"))
    named = filled.select(
        F.col("source").alias("name"),
        (F.col("place") % len(weights)).alias("class"),
        F.coalesce(target, F.lit(0.0)).alias("target"),
    )
    return sized.join(named, sized["source"].eqNullSafe(named["name"])).drop("name", "words")


def curriculum_mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: int = CAP,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """The mix of all documents: row (the carried columns), size, source, source_size, target,
    taken and passes.

    ``size`` counts words (null text: 0). Sources by code point, null last, have the
    ``weights`` in turn and the ``schedules`` likewise. ``passes`` has one entry per time that
    a document is met: its number, the words taken (all but the last of a source are whole)
    and the training time in [0, 1]. ``taken`` is their sum, so the words taken of a source
    are its target rounded to whole words. Empty documents and tables take nothing. Equal rows
    are separate documents; the order inside a source is that of MD5 over doc_id and text, so
    reruns agree. Only ``carry`` columns (all by default) go through the shuffle.
    """
    text, doc = F.col("text"), F.col("doc_id").cast("string")
    key = F.md5(F.concat(F.coalesce(doc, F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = docs.select(
        row.alias("row"),
        F.col("source").alias("source"),
        word_count(text).alias("size"),
        key.alias("key"),
    ).withColumn("bucket", F.substring("key", 1, 3))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    plan = source_targets(totals, weights, cap)
    plan = plan.select(
        F.col("source").alias("of"),
        F.col("bucket").alias("part"),
        "base",
        "source_size",
        "target",
        F.element_at(
            F.array(*[F.expr(_segments(s)) for s in schedules]),
            (F.col("class") % len(schedules) + 1).cast("int"),
        ).alias("segments"),
    )
    inside = W.partitionBy("source", "bucket").orderBy("key")
    placed = (
        rows.withColumn(
            "before",
            F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"),
        )
        .join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("part")))
        .withColumn("before", F.col("before") + F.col("base"))
        .withColumn("demand", F.floor(F.col("target") + 0.5).cast("long"))
    )
    words = "greatest(0L, least(size, demand - before - n * source_size))"
    time = _inverse("(before + n * source_size) / demand", "segments")
    passes = (
        f"transform(filter(sequence(0L, {int(cap) - 1}L), n -> {words} > 0), n -> named_struct("
        f"'number', n + 1, 'words', {words}, 'position', {time}))"
    )
    return placed.select(
        "row",
        "source",
        "size",
        "source_size",
        "target",
        F.expr(f"aggregate(sequence(0L, {int(cap) - 1}L), 0L, (a, n) -> a + {words})").alias("taken"),
        F.expr(passes).alias("passes"),
    )


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word, white space as it was."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), F.greatest(count, F.lit(0)).cast("int")), "")


def training_order(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` as training meets them: one per pass, range-sorted by position.

    A document that the mix takes more than once is repeated; the last pass of a source may
    take only the first words of a text. All columns are returned as they came.
    """
    mixed = curriculum_mix(docs, weights, cap)
    met = mixed.select("row", "size", F.explode("passes").alias("pass"))
    cut = F.when(F.col("pass.words") < F.col("size"), first_words(F.col("row.text"), F.col("pass.words")))
    row = F.col("row").withField("text", F.coalesce(cut, F.col("row.text")))
    ordered = met.select(row.alias("row"), F.col("pass.position").alias("position")).orderBy(
        "position", "row.doc_id"
    )
    return ordered.select("row.*")
