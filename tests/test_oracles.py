"""Every query with check SQL gives the same rows, names and types as DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not available")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def _sorted(rows):
    return sorted((tuple(_cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    index = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert sorted(types) == columns
    expected = _sorted([[r[i] for i in index] for r in cursor.fetchall()])
    assert _sorted([[r[c] for c in columns] for r in df.collect()]) == expected
    for field in df.schema.fields:
        assert types[field.name] == TYPES[field.dataType.simpleString()], field.name


def test_entry_runs(spark):
    rows = entry_point.entry(spark).collect()
    assert [r["position"] for r in rows] == list(range(1, len(rows) + 1))
