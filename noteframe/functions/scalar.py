"""Numeric column functions (native expressions, no UDF)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import as_column


def clip(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), as_column(x)))


def sigmoid(x, bound: float = 35.0) -> Column:
    """Logistic function of x clipped to +-bound."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -bound, bound)))


def logit(p, eps: float = 1e-6) -> Column:
    """Log odds of p clipped to [eps, 1 - eps]."""
    clipped = clip(p, eps, 1.0 - eps)
    return F.ln(clipped / (F.lit(1.0) - clipped))


def min_max(df: DataFrame, x: str, constant: float = 0.5) -> Column:
    """Min-max scaling of a column of ``df``; a constant column becomes ``constant``.

    The two statistics are one scalar subquery: the scan stays lazy, nothing is
    collected and no join is planned.
    """
    stats = df.agg(F.struct(F.min(x).alias("low"), F.max(x).alias("high")).alias("s")).scalar()
    spread = stats["high"] - stats["low"]
    return F.when(spread < 1e-12, F.lit(constant)).otherwise((F.col(x) - stats["low"]) / spread)


def z_score(df: DataFrame, x: str) -> Column:
    """(x - mean) / population standard deviation."""
    stats = df.agg(
        F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd")).alias("s")
    ).scalar()
    return (F.col(x) - stats["mean"]) / stats["sd"]


def weighted_index(terms: Sequence[tuple[Column, float]]) -> Column:
    """Composite index in [0, 1]; weights must be >= 0 and sum to 1."""
    weights = [float(w) for _, w in terms]
    if min(weights) < 0 or abs(sum(weights) - 1.0) > 1e-8:
        raise ValueError("weights must be non-negative and sum to 1")
    return clip(reduce(add, [F.lit(w) * c for (c, _), w in zip(terms, weights)]), 0.0, 1.0)


def cut_right(x, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands (edges[i], edges[i+1]] -> labels[i]; NULL outside."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    x = as_column(x)
    band = F.when(x <= edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        band = band.when(x <= upper, F.lit(label))
    return band


def digitize_left(x, bins: Sequence[float]) -> Column:
    """Index i with bins[i-1] <= x < bins[i] (left-closed)."""
    x = as_column(x)
    index = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(bins):
        index = index.when(x < edge, F.lit(i))
    return index.otherwise(F.lit(len(bins)))


def reverse_scored(items: Sequence, listed: Sequence[int], low: int, high: int) -> list[Column]:
    """Reverse the items whose 1-based position is listed: (low + high) - raw."""
    chosen = set(listed)
    return [
        (F.lit(low + high) - as_column(c)) if i in chosen else as_column(c)
        for i, c in enumerate(items, start=1)
    ]


def row_total(items: Sequence) -> Column:
    """Sum of item columns in one row."""
    return reduce(add, [as_column(c) for c in items])


def row_max(flags: Sequence) -> Column:
    """Largest flag in one row (1 when any flag is set)."""
    columns = [as_column(c) for c in flags]
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def round_half_even(x, digits: int = 0) -> Column:
    """Round half to even, scaled in binary (x * 10^d) as array libraries do."""
    scale = float(10**digits)
    return F.rint(as_column(x) * F.lit(scale)) / F.lit(scale)


def number_or(x, default: float = 0.0, type_name: str = "double") -> Column:
    """Numeric value of a text or number column; ``default`` when absent or not a number."""
    parsed = as_column(x).try_cast("double")
    return F.coalesce(F.when(~F.isnan(parsed), parsed), F.lit(float(default))).cast(type_name)


def number_or_missing(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """``number_or`` of a column that may not exist in ``df``."""
    return number_or(F.col(name), default) if name in df.columns else F.lit(float(default))


def aligned_probabilities(
    by_class: dict[int, Column], n_classes: int, floor: float = 1e-9
) -> list[Column]:
    """Probabilities in class order 0..n-1, floored and divided by their sum."""
    floored = [
        F.greatest(as_column(by_class[k]), F.lit(floor)) if k in by_class else F.lit(floor)
        for k in range(n_classes)
    ]
    total = reduce(add, floored)
    return [p / total for p in floored]


def argmax(columns: Sequence) -> Column:
    """Position of the largest value; the first one wins on ties."""
    values = F.array(*[as_column(c) for c in columns])
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def high_band(probabilities: Sequence[str], available: Sequence[str] | None = None) -> Column:
    """Sum of the probabilities of the upper classes; NULL if a column is missing."""
    if available is not None and not set(probabilities) <= set(available):
        return F.lit(None).cast("double")
    return row_total(probabilities)


def code_label(code, labels: Sequence[str]) -> Column:
    """Ordinal code -> label; NULL for codes outside the list."""
    return F.get(F.array(*[F.lit(v) for v in labels]), as_column(code).cast("int"))


def label_code(label, labels: Sequence[str]) -> Column:
    """Label -> ordinal code; NULL for unknown labels."""
    position = F.array_position(F.array(*[F.lit(v) for v in labels]), as_column(label))
    return F.when(position > 0, (position - 1).cast("int"))


def severity_label(code, labels: Sequence[str], top: Column | str | None = None) -> Column:
    """Severity code -> label; the label of the last code may be replaced by ``top``."""
    base = code_label(code, labels)
    if top is None:
        return base
    top = top if isinstance(top, Column) else F.lit(top)
    return F.when(as_column(code) >= len(labels) - 1, top).otherwise(base)
