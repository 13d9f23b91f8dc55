"""Running totals and ranks over a whole table without a one-task window.

A global (or per-class) ordered window puts all rows of a group into one task. Here the
order key is cut into buckets, the running total inside a bucket is a window, and the
totals of all earlier buckets of the group are added from a small table (one row per
group and bucket). The result is exact; only the size of a task changes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import stored

OVERSAMPLE = 32


def default_buckets(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, order: Column, buckets: int) -> Column:
    """Array of ``buckets - 1`` cut points of ``order``, as a scalar subquery.

    The cut points are quantiles of the ``OVERSAMPLE * buckets`` keys with the smallest
    hash: a bounded, deterministic sample, so every branch of a plan (and every retried
    task) sees the same cut points. ``order`` must be (nearly) distinct per row; aggregate
    repeated keys first.
    """
    sampled = (
        df.select(order.alias("k")).orderBy(F.xxhash64("k"), "k").limit(buckets * OVERSAMPLE)
    )
    cuts = (
        f"transform(sequence(1, {buckets - 1}), i -> get(ks, int(floor(i * size(ks) / {buckets}))))"
    )
    return sampled.agg(F.sort_array(F.collect_list("k")).alias("ks")).select(F.expr(cuts)).scalar()


def order_bucket(order: str, cuts: str, buckets: int) -> Column:
    """Bucket 0..buckets-1 of ``order``: how many cut points lie below it (binary search)."""
    steps, step = [], 1
    while step < buckets:
        steps.insert(0, str(step))
        step *= 2
    return F.expr(
        f"aggregate(array({', '.join(steps)}), 0, (low, s) -> "
        f"low + CASE WHEN get({cuts}, low + s - 1) < {order} THEN s ELSE 0 END)"
    )


def running_totals(
    df: DataFrame,
    order: Column,
    totals: Mapping[str, Column],
    by: Sequence[str] = (),
    buckets: int | None = None,
    bucket: Column | None = None,
    store: bool = False,
) -> DataFrame:
    """Add inclusive running sums of ``totals`` along ``order`` inside each ``by`` group.

    ``bucket`` overrides the sampled buckets when a monotone, evenly spread bucket of
    ``order`` is known (for example the leading digits of a uniform draw). The input is read
    up to three times (cut points, bucket totals, rows); ``store`` checkpoints it first, which
    pays off when it is the end of a long chain.
    """
    buckets = buckets or default_buckets(df)
    names = df.columns
    if store:
        df = stored(df.withColumn("_order", order))
        order = F.col("_order")
    group = [F.col(c) for c in by]
    base = df.withColumn("_order", order)
    if bucket is None:
        full = F.struct(*group, F.col("_order"))
        base = base.withColumns({"_full": full, "_cuts": cut_points(base, full, buckets)})
        base = base.withColumn("_bucket", order_bucket("_full", "_cuts", buckets)).drop("_full", "_cuts")
    else:
        base = base.withColumn("_bucket", bucket.cast("int"))
    cell = F.struct(F.struct(*group, F.lit(0).alias("_g")).alias("g"), F.col("_bucket").alias("b"))
    base = base.withColumn("_cell", cell).drop("_bucket")

    inside = W.partitionBy("_cell").orderBy("_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = base.withColumns({f"_in_{n}": F.sum(c).over(inside) for n, c in totals.items()})

    cells = base.groupBy("_cell").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
    before = W.partitionBy("_cell.g").orderBy("_cell.b").rowsBetween(W.unboundedPreceding, -1)
    earlier = cells.select(
        "_cell", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals]
    )
    out = local.join(earlier, "_cell")
    return out.select(
        *[F.col(c) for c in names],
        *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in totals],
    )


def positions(df: DataFrame, order: Column, name: str = "position", by: Sequence[str] = (), **kwargs) -> DataFrame:
    """1..n along ``order`` (distinct per row), over the whole table or inside groups."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, by=by, **kwargs)


def positions_by_draw(
    df: DataFrame, draw: str, tie: str, name: str = "position", by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """1..n in the order of a uniform draw column; the draw itself gives even buckets."""
    buckets = buckets or default_buckets(df)
    bucket = F.floor(F.col(draw) * buckets)
    return positions(df, F.struct(draw, tie), name, by, buckets=buckets, bucket=bucket)
