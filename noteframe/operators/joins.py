"""Checked equi-joins on one key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import guard, require_columns


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str, source: str) -> DataFrame:
    """Fail the query if a key repeats.

    The check is a scalar subquery over the key column only, with a partial aggregation
    before its shuffle, so a hot key cannot overload a task.
    """
    repeated = duplicate_keys(df, key).agg(F.count("*")).scalar()
    return guard(
        df, repeated == 0, F.concat(F.lit(f"{source}: repeated values of {key}: "), repeated.cast("string"))
    )


def join_one_to_one(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    check: Sequence[str] = ("left", "right"),
) -> DataFrame:
    """Equi-join of two tables that hold each key once.

    ``check`` names the sides to verify; leave out a side that is unique by construction
    (for example the output of ``groupBy(key)``). The join strategy is left to AQE.
    """
    require_columns(left, [key], "left side")
    require_columns(right, [key], "right side")
    if "left" in check:
        left = require_unique(left, key, "left side")
    if "right" in check:
        right = require_unique(right, key, "right side")
    return left.join(right, key, how)


def with_suffixes(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rename only the columns that occur on both sides (other than the key)."""
    shared = [c for c in left.columns if c in set(right.columns) and c != key]
    return (
        left.withColumnsRenamed({c: c + suffixes[0] for c in shared}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in shared}),
    )


def anti_join(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``taken``."""
    return df.join(taken.select(key), key, "left_anti")


def refuse_orphans(df: DataFrame, reference: DataFrame, key: str, source: str) -> DataFrame:
    """Fail the query with the number of rows whose key has no match in ``reference``."""
    orphans = anti_join(df, reference, key).agg(F.count("*")).scalar()
    return guard(df, orphans == 0, F.concat(F.lit(f"{source}: rows without a match: "), orphans.cast("string")))


def lineage(
    predictions: DataFrame,
    parts: Sequence[tuple[DataFrame, Sequence[str], tuple[str, str] | None]],
    key: str,
    constants: Mapping[str, object],
    check: Sequence[str] = ("left", "right"),
) -> DataFrame:
    """Predictions left-joined with the available columns of each part, plus constants.

    Each part is (table, wanted columns, suffixes or None); wanted columns that a table
    lacks are left out.
    """
    out = predictions
    for i, (table, wanted, suffixes) in enumerate(parts):
        side = table.select(key, *[c for c in wanted if c in table.columns and c != key])
        if suffixes:
            out, side = with_suffixes(out, side, key, suffixes)
        sides = [s for s in check if s == "right" or i == 0]
        out = join_one_to_one(out, side, key, "left", sides)
    return out.withColumns({n: F.lit(v) for n, v in constants.items()})
