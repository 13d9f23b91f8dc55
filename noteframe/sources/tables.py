"""Readers and writers: CSV, JSON lines, JSON objects, run folders and manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stage_path(root: str, run_id: str, stage: str, name: str = "") -> str:
    """``<root>/run_id=<run>/stage=<stage>/<name>``: the layout of partition discovery."""
    return "/".join(p for p in (root.rstrip("/"), f"run_id={run_id}", f"stage={stage}", name) if p)


def work_dir(spark: SparkSession) -> str:
    """Folder for files between steps: the one that ``spark.checkpoint.dir`` names.

    Where it is unset, a folder below the session's warehouse, which executors share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table that several branches of a plan read (reliable checkpoint).

    Files go to the checkpoint folder of the session, so lost executors cost no recomputation.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    floats = (T.FloatType, T.DoubleType)
    return df.withColumns(
        {
            f.name: F.when(~F.isnan(f.name), F.col(f.name))
            for f in df.schema.fields
            if isinstance(f.dataType, floats)
        }
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a declared schema (no inference pass); empty fields are NULL."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with header, overwriting; NULL is written as an empty field."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')
    return path


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One record per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_records(df: DataFrame, path: str, nested: Sequence[str]) -> tuple[str, str]:
    """Full records as JSON lines, and a compact Parquet index without the nested columns."""
    full, index = f"{path}/records", f"{path}/index"
    write_jsonl(df, full)
    df.drop(*nested).write.mode("overwrite").parquet(index)
    return full, index


def read_json_object(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file that holds one JSON object, as a one-row table; anything else is refused."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.json(path, multiLine=True)
    text = spark.read.text(path, wholetext=True)
    starts = text.agg(F.bool_and(F.ltrim("value").startswith("{"))).scalar()
    return df.where(F.assert_true(starts, F.lit(f"a JSON object was expected in {path}")).isNull())


def manifest(df: DataFrame, counts: Mapping[str, Column], constants: Mapping[str, object]) -> DataFrame:
    """One row of counts and constants about a stage, from one aggregation."""
    return df.agg(*[c.alias(n) for n, c in counts.items()]).withColumns(
        {n: F.lit(v) for n, v in constants.items()}
    )


def write_manifest(row: DataFrame, path: str) -> str:
    """One JSON object in one file (the row count is 1 by construction)."""
    row.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_stage(df: DataFrame, root: str, run_id: str, stage: str, name: str) -> str:
    """Publish a table of a run as Parquet."""
    path = stage_path(root, run_id, stage, name)
    df.write.mode("overwrite").parquet(path)
    return path


#: The record that completes a stage. It is written after the stage's tables.
COMMIT = "_record"


def table_digest(df: DataFrame) -> DataFrame:
    """One row: (rows, digest). The digest is a sum over rows, so order and files do not show.

    A row counts as the first 32 bits of the MD5 of its columns as text, in order, nulls as
    an empty text behind another mark.
    """
    cells = [F.concat(F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *cells)), 1, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest"))


def commit_stage(df_by_name: Mapping[str, DataFrame], root: str, run_id: str, stage: str) -> DataFrame:
    """Publish the tables of a stage, then its record: (name, rows, digest) of what was written.

    Rows and digests are taken from the files as they are read back. A stage that stops before
    its record, or is being written again, has none, and ``committed_bundle`` refuses it.
    """
    spark = next(iter(df_by_name.values())).sparkSession
    path = stage_path(root, run_id, stage, COMMIT)
    told = "name string, rows long, digest string"
    spark.createDataFrame([], told).coalesce(1).write.mode("overwrite").parquet(path)
    rows = []
    for name, df in df_by_name.items():
        written = spark.read.parquet(write_stage(df, root, run_id, stage, name))
        rows.append((name, *table_digest(written).first()))
    record = spark.createDataFrame(rows, told)
    record.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def committed_bundle(
    spark: SparkSession, root: str, run_id: str, tables: Mapping[str, tuple[str, str]], verify: bool = False
) -> dict[str, DataFrame]:
    """``load_bundle`` of stages whose records are complete; one error lists all that are not.

    The record must name the table and hold as many rows as its files do (read from file
    footers). ``verify`` also compares digests, which reads the tables.
    """
    records = load_bundle(spark, root, run_id, {s: (s, COMMIT) for s, _ in tables.values()})
    told = {(s, r["name"]): r for s, record in records.items() for r in record.collect()}

    def refuse(broken: list[str]) -> None:
        if broken:
            raise ValueError("incomplete stages: " + "; ".join(sorted(broken)))

    refuse([f"{s}/{t} has no record" for s, t in tables.values() if (s, t) not in told])
    found = load_bundle(spark, root, run_id, tables)
    refuse([f"{s}/{t} has not the rows of its record" for n, (s, t) in tables.items() if told[s, t]["rows"] != found[n].count()])
    if verify:
        digests = {n: table_digest(df).first()["digest"] for n, df in found.items()}
        refuse([f"{s}/{t} has not the content of its record" for n, (s, t) in tables.items() if told[s, t]["digest"] != digests[n]])
    return found


def load_bundle(
    spark: SparkSession, root: str, run_id: str, tables: Mapping[str, tuple[str, str]]
) -> dict[str, DataFrame]:
    """All named tables of one run, lazily; one error lists every missing table.

    ``tables``: name -> (stage, table name).
    """
    found, missing = {}, []
    for name, (stage, table) in tables.items():
        try:
            found[name] = spark.read.parquet(stage_path(root, run_id, stage, table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(f"{stage}/{table}")
    if missing:
        raise FileNotFoundError("missing tables: " + ", ".join(sorted(missing)))
    return found
