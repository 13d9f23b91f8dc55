"""Samples, splits, folds and perturbations by hashed draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from .class_eval import class_sizes
from .joins import anti_join
from .ordered import default_buckets, positions_by_draw


def first_n_per_stratum(df: DataFrame, stratum: str, order: Sequence, n: int) -> DataFrame:
    """Up to n rows per stratum, for any n.

    Rows are ranked inside hash buckets of a stratum first, so a hot stratum is split; the
    rank over the stratum then sees at most n rows of each bucket.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(default_buckets(df)))

    def limited(rows: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")

    return limited(limited(df.withColumn("_part", part), stratum, "_part"), stratum).drop("_part")


def stratified_sample(
    df: DataFrame, key: str, stratum: str, n: int, seed: int, strata: Sequence | None = None
) -> DataFrame:
    """min(n, size) random rows of each stratum (of the listed strata, if given)."""
    base = df if strata is None else df.where(F.col(stratum).isin(*strata))
    drawn = base.withColumn("_u", uniform(seed, key, "sample"))
    return first_n_per_stratum(drawn, stratum, [F.col("_u"), F.col(key)], n).drop("_u")


def with_critical_row(
    sample: DataFrame, everything: DataFrame, key: str, critical: str, seed: int, size: int
) -> DataFrame:
    """Add one critical row if the sample has none and the table has one outside the sample.

    The sample holds at most ``size`` rows, so the first ``size + 1`` critical rows in random
    order include one outside it whenever there is one. Both are read once, and the choice is
    made on that bounded union.
    """
    first = (
        everything.where(F.col(critical) == 1)
        .withColumn("_u", uniform(seed, key, "critical"))
        .orderBy("_u", key)
        .limit(size + 1)
    )
    own = sample.select(*everything.columns, F.lit(None).cast("double").alias("_u"), F.lit(0).alias("_extra"))
    both = own.unionByName(first.withColumn("_extra", F.lit(1)))
    marked = both.withColumns(
        {
            "_taken": F.min("_extra").over(W.partitionBy(key)) == 0,
            "_have": F.max(F.when(F.col("_extra") == 0, F.col(critical))).over(W.partitionBy()),
        }
    )
    place = F.row_number().over(W.partitionBy("_extra", "_taken").orderBy("_u", key))
    chosen = (F.coalesce("_have", F.lit(0)) == 0) & ~F.col("_taken") & (F.col("_place") == 1)
    return marked.withColumn("_place", place).where((F.col("_extra") == 0) | chosen).select(*sample.columns)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in a random but reproducible order."""
    return df.orderBy(uniform(seed, key, "shuffle"), key)


def random_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Simple random sample of n rows, ordered by key."""
    return df.orderBy(uniform(seed, key, "rows"), key).limit(n).orderBy(key)


def train_test_split(
    df: DataFrame, key: str, y: str, test_size: float, seed: int, out: str = "is_test", buckets: int | None = None
) -> DataFrame:
    """Add 0/1: the first round(test_size * n_class) rows of each class in hash order are test rows.

    The split is a column, so no later stage has to rebuild it.
    """
    sizes, _, _ = class_sizes(df, y)
    drawn = df.withColumn("_u", uniform(seed, key, "split"))
    ranked = positions_by_draw(drawn, "_u", key, "_rank", by=[y], buckets=buckets)
    quota = F.rint(F.element_at(sizes, F.col(y)) * F.lit(float(test_size)))
    return ranked.withColumn(out, (F.col("_rank") <= quota).cast("int")).drop("_u", "_rank")


def stratified_folds(
    df: DataFrame, key: str, y: str, folds: int, seed: int, out: str = "fold", salt: str = "fold", buckets: int | None = None
) -> DataFrame:
    """Add a fold number 0..folds-1, dealt in hash order inside each class."""
    drawn = df.withColumn("_u", uniform(seed, key, salt))
    ranked = positions_by_draw(drawn, "_u", key, "_rank", by=[y], buckets=buckets)
    return ranked.withColumn(out, ((F.col("_rank") - 1) % folds).cast("int")).drop("_u", "_rank")


def flipped(flag, key: str, rate: float, seed: int, salt) -> Column:
    """0/1 flag, flipped at a rate by a hash of (seed, salt, key)."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.when(uniform(seed, key, salt) < rate, F.lit(1) - flag).otherwise(flag)


def scenario_rows(df: DataFrame, scenarios: Sequence[Mapping[str, object]]) -> DataFrame:
    """Each row once per scenario, with the scenario's parameters as columns.

    Scenarios are a short literal array unfolded in place: no join, and all scenarios run
    in one job; group by the ``scenario`` column.
    """
    names = list(scenarios[0])
    rows = F.array(*[F.struct(*[F.lit(s[n]).alias(n) for n in names]) for s in scenarios])
    return df.select(F.inline(rows), *df.columns).select(*names, *df.columns)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack parts by column name; absent columns become NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def label_domain(df: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct values of two columns together."""
    return df.select(F.explode(F.array(F.col(left), F.col(right))).alias("label")).distinct()
