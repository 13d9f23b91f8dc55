"""Table and scale quality checks, reliability, correlation, missingness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as x
from ..functions.hashing import as_column
from ..functions.scalar import round_half_even, row_total
from .contracts import guard
from .joins import duplicate_keys


def in_range(value, low: float, high: float) -> Column:
    """NULL fails, as an absent value is not between two bounds."""
    return F.coalesce(as_column(value).between(low, high), F.lit(False))


def all_in_range(items: Sequence[str], low: float, high: float) -> Column:
    checks = [in_range(c, low, high) for c in items]
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def at_most(a, b) -> Column:
    """Implication between flags: a <= b."""
    return F.coalesce(as_column(a) <= as_column(b), F.lit(False))


def total_matches(items: Sequence[str], total: str) -> Column:
    return F.coalesce(row_total(items) == F.col(total), F.lit(False))


def quality_checks(
    df: DataFrame, checks: Mapping[str, tuple[Column, str]], unique: Mapping[str, tuple[str, str]] | None = None
) -> DataFrame:
    """(check, passed, details) rows; every row-level check shares one pass over the table.

    ``checks``: name -> (row condition, details). ``unique``: name -> (key, details).
    """
    aggregates = [F.coalesce(F.bool_and(c), F.lit(True)).alias(n) for n, (c, _) in checks.items()]
    one = df.agg(*aggregates) if aggregates else df.sparkSession.range(1)
    rows = [
        F.struct(F.lit(n).alias("check"), F.col(n).alias("passed"), F.lit(d).alias("details"))
        for n, (_, d) in checks.items()
    ]
    for name, (key, details) in (unique or {}).items():
        repeated = duplicate_keys(df, key).agg(F.count("*")).scalar()
        rows.append(
            F.struct(F.lit(name).alias("check"), (repeated == 0).alias("passed"), F.lit(details).alias("details"))
        )
    return one.select(F.inline(F.array(*rows)))


def failed_checks(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if(~F.col("passed")).alias("n_failed"))


def quality_gate(df: DataFrame, checks: DataFrame) -> DataFrame:
    """Pass ``df`` on only if no check failed; otherwise the query fails with the count."""
    failed = checks.agg(F.count_if(~F.col("passed"))).scalar()
    return guard(df, failed == 0, F.concat(F.lit("quality checks failed: "), failed.cast("string")))


def cronbach_alpha(df: DataFrame, scales: Mapping[str, Sequence[str]]) -> DataFrame:
    """(scale, alpha): one pass for all scales; NULL with < 2 items or no total variance."""
    aggregates, rows = [], []
    for i, (scale, items) in enumerate(scales.items()):
        for j, item in enumerate(items):
            aggregates.append(F.var_samp(F.col(item).cast("double")).alias(f"_v{i}_{j}"))
        aggregates.append(F.var_samp(row_total([F.col(c).cast("double") for c in items])).alias(f"_t{i}"))
        k, total = len(items), F.col(f"_t{i}")
        spread = row_total([f"_v{i}_{j}" for j in range(k)])
        alpha = (
            F.when(total > 0, F.lit(k / (k - 1)) * (F.lit(1.0) - spread / total))
            if k >= 2
            else F.lit(None).cast("double")
        )
        rows.append(F.struct(F.lit(scale).alias("scale"), alpha.alias("alpha")))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def correlations(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Pearson correlation of all column pairs, long form (a, b, r), one pass."""
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}~{b}") for a, b in pairs])

    def row(a: str, b: str, source: str) -> Column:
        return F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), round_half_even(F.col(f"`{source}`"), digits).alias("r")
        )

    rows = [row(a, b, f"{a}~{b}") for a, b in pairs] + [row(b, a, f"{a}~{b}") for a, b in pairs if a != b]
    return one.select(F.inline(F.array(*rows)))


def with_missing_values(
    df: DataFrame,
    key: str,
    rate: float,
    seed: int,
    protected: Sequence[str] = (),
    text_columns: Sequence[str] = (),
) -> DataFrame:
    """Blank values at a rate, per column; protected and unlisted text columns stay whole.

    The draw depends on seed, column name and key only, so a column that several tables
    share gets the same mask in each of them.
    """
    if rate <= 0:
        return df
    kept = {key, *protected}
    out = []
    for field in df.schema.fields:
        name = x.col(field.name)
        is_text = isinstance(field.dataType, T.StringType)
        if field.name in kept or (is_text and field.name not in text_columns):
            out.append(name)
            continue
        draw = x.uniform(x.lit(str(seed)), x.lit(field.name), x.col(key))
        out.append(f"CASE WHEN {draw} >= {x.lit(float(rate))} THEN {name} END AS {name}")
    return df.selectExpr(*out)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per label (order by label when it is shown)."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def require_class_counts(df: DataFrame, label: str, folds: int) -> DataFrame:
    """Fail the query when the smallest class has fewer rows than folds."""
    smallest = class_distribution(df, label).agg(F.min("n")).scalar()
    return guard(df, smallest >= folds, F.concat(F.lit("smallest class has rows: "), smallest.cast("string")))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of distinct values of each column.

    Each column is reduced to its distinct values first (long form, partial
    aggregation), which avoids the row expansion of several ``countDistinct``.
    """
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]))
    ).where("v is not null")
    per_column = long.distinct().groupBy("c").agg(F.count("*").alias("n"))
    return per_column.agg(
        *[F.coalesce(F.max(F.when(F.col("c") == c, F.col("n"))), F.lit(0)).alias(f"n_{c}") for c in columns]
    )
