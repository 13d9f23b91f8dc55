"""Schema contracts, label-leak guards and projections."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys that may not reach a text stage. Callers can add, not remove.
FORBIDDEN_KEYS = (
    "prioridade_referencia",
    "prioridade_referencia_codigo",
    "prioridade_prevista",
    "prioridade_prevista_codigo",
    "priority",
    "priority_code",
    "prioridade",
    "priority_label",
    "label",
    "target",
    "yref",
    "yhat",
)


def require_columns(df: DataFrame, columns: Iterable[str], source: str) -> DataFrame:
    """Raise at plan time, naming every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{source} lacks required columns: {missing}")
    return df


def require_symmetric(df: DataFrame, left: Iterable[str], right: Iterable[str]) -> DataFrame:
    """Both column families must be complete."""
    have = set(df.columns)
    missing_left, missing_right = sorted(set(left) - have), sorted(set(right) - have)
    if missing_left or missing_right:
        raise ValueError(
            f"column families are not symmetric; left missing {missing_left}, right missing {missing_right}"
        )
    return df


def refuse_label_columns(df: DataFrame, fragments: Sequence[str] = ("priority", "prioridade")) -> DataFrame:
    """Refuse a table with a column whose name contains a label fragment."""
    leaked = [c for c in df.columns if any(f in c.lower() for f in fragments)]
    if leaked:
        raise ValueError(f"label columns found in the input of a text stage: {leaked}")
    return df


def _forbidden_set(extra: Iterable[str]) -> set[str]:
    return {k.strip().lower() for k in (*FORBIDDEN_KEYS, *extra)}


def _type_paths(dtype: T.DataType, forbidden: set[str], path: str) -> list[str]:
    if isinstance(dtype, T.StructType):
        found = []
        for field in dtype.fields:
            child = f"{path}.{field.name}" if path else field.name
            if field.name.strip().lower() in forbidden:
                found.append(child)
            found += _type_paths(field.dataType, forbidden, child)
        return found
    if isinstance(dtype, T.ArrayType):
        return _type_paths(dtype.elementType, forbidden, f"{path}[]")
    if isinstance(dtype, T.MapType):
        return _type_paths(dtype.valueType, forbidden, f"{path}.*")
    return []


def forbidden_schema_paths(schema: T.StructType, extra: Iterable[str] = ()) -> list[str]:
    """Paths of forbidden names at any depth of a schema (plan time, no data read)."""
    return _type_paths(schema, _forbidden_set(extra), "")


def forbidden_map_keys(column: str, extra: Iterable[str] = ()) -> Column:
    """Forbidden keys of a map column, in key order of the map."""
    forbidden = sorted(_forbidden_set(extra))
    return F.filter(F.map_keys(column), lambda k: F.lower(F.trim(k)).isin(*forbidden))


def forbidden_json_paths(json_text, extra: Iterable[str] = ()) -> Column:
    """Paths ``a.b[0].c`` of forbidden keys at any depth of a JSON text column.

    The depth of a JSON text is not bounded by a schema, so the walk is an Arrow-batched
    function. A text that holds none of the names (nor an escape that may hide one) cannot
    match and is not sent there. NULL or broken JSON gives an empty array.
    """
    forbidden = _forbidden_set(extra)
    source = F.col(json_text) if isinstance(json_text, str) else json_text
    lowered = F.lower(source)
    hints = [F.contains(lowered, F.lit(name)) for name in sorted(forbidden)]
    possible = reduce(or_, hints, F.contains(source, F.lit("\\u")))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def paths(texts: pd.Series) -> pd.Series:
        def walk(value, path: str) -> list[str]:
            found = []
            if isinstance(value, dict):
                for key, child in value.items():
                    below = f"{path}.{key}" if path else key
                    if key.strip().lower() in forbidden:
                        found.append(below)
                    found += walk(child, below)
            elif isinstance(value, list):
                for i, child in enumerate(value):
                    found += walk(child, f"{path}[{i}]")
            return found

        def one(text) -> list[str]:
            try:
                return walk(json.loads(text), "") if text is not None else []
            except ValueError:
                return []

        return texts.map(one)

    return paths(F.when(possible, source))


def guard(df: DataFrame, ok: Column, message: Column) -> DataFrame:
    """Fail the query when ``ok`` is false; a lazy check that runs with the plan."""
    return df.where(F.assert_true(ok, message).isNull())


def allowed_only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Allow-list projection: nothing else reaches the next stage."""
    require_columns(df, columns, "allow-list projection")
    return df.select(*columns)


def with_constants(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """Add constant provenance columns."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def renamed_prefix(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename every column that starts with ``old`` to start with ``new``."""
    return df.withColumnsRenamed({c: new + c[len(old):] for c in df.columns if c.startswith(old)})


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of one key; an unknown key fails the query."""
    row = df.where(F.col(key) == F.lit(value)).limit(1)
    # An aggregate always has one row, so the check also runs when nothing was found.
    one = row.agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("r"))
    return guard(one, F.col("n") > 0, F.lit(f"key not found: {value}")).select("r.*")


def visible_and_audit(
    sample: DataFrame, visible: Sequence[str | Column], audit: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Two projections of one sample: what an annotator sees, and the labels kept apart."""
    return sample.select(*visible), sample.select(*audit)


def blank_form(df: DataFrame, shown: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Shown columns plus empty text columns to fill in."""
    return df.select(*shown, *[F.lit("").alias(f) for f in fields])
