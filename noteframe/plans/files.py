"""Queries through readers and writers: CSV, JSON lines, JSON objects, run folders, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import tables as io
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def _fresh(spark) -> str:
    """A new folder below the shared working folder."""
    return f"{io.work_dir(spark)}/noteframe-{uuid.uuid4().hex[:12]}"


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def csv_round_trip(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_acctbal", F.expr("CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment")
    )
    path = io.write_csv(customers, f"{_fresh(spark)}/customers")
    schema = "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING"
    return io.nan_to_null(io.read_csv(spark, path, schema))


@query("SELECT conv_id, turn, md5(text) AS text_md5, role AS role, turn + 1 AS next_turn FROM conversations")
def jsonl_round_trip(spark, folder):
    """Nested records as JSON lines with a compact index, read back and joined."""
    turns = table(spark, folder, "conversations").select(
        "conv_id", "turn", "text", F.struct("role", (F.col("turn") + 1).alias("next_turn")).alias("metadata")
    )
    full, index = io.write_records(turns, f"{_fresh(spark)}/turns", ["metadata"])
    schema = "conv_id BIGINT, turn BIGINT, text STRING, metadata STRUCT<role: STRING, next_turn: BIGINT>"
    records = io.read_jsonl(spark, full, schema).select("conv_id", "turn", "metadata")
    slim = spark.read.parquet(index)
    return slim.join(records, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.md5("text").alias("text_md5"), "metadata.role", "metadata.next_turn"
    )


@query(
    f"""SELECT count(*)::BIGINT AS n_turns, count(DISTINCT conv_id)::BIGINT AS n_conversations, count(*) FILTER (WHERE role = 'user')::BIGINT AS n_user,
  'rules' AS provider, 'v1' AS version FROM conversations"""
)
def stage_manifest(spark, folder):
    """One aggregation, written as one JSON object and read back with a check."""
    turns = table(spark, folder, "conversations")
    row = io.manifest(
        turns,
        {
            "n_turns": F.count("*"),
            "n_conversations": F.count_distinct("conv_id"),
            "n_user": F.count_if(F.col("role") == "user"),
        },
        {"provider": "rules", "version": "v1"},
    )
    path = io.write_manifest(row, f"{_fresh(spark)}/manifest")
    schema = "n_turns BIGINT, n_conversations BIGINT, n_user BIGINT, provider STRING, version STRING"
    return io.read_json_object(spark, path, schema)


@query("SELECT c_mktsegment, count(o_orderkey)::BIGINT AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def run_bundle(spark, folder):
    """Tables published under run and stage folders, loaded as one named bundle."""
    root = _fresh(spark)
    io.commit_stage({"customer": table(spark, folder, "customer")}, root, "r1", "01_profiles")
    io.commit_stage({"orders": table(spark, folder, "orders")}, root, "r1", "02_scores")
    tables = {"profiles": ("01_profiles", "customer"), "scores": ("02_scores", "orders")}
    bundle = io.committed_bundle(spark, root, "r1", tables)
    joined = bundle["profiles"].join(bundle["scores"], F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"))



def _record_sql(name: str, source: str, columns: list[str]) -> str:
    cells = ", ".join(f"CASE WHEN {c} IS NULL THEN '0' ELSE '1' || {c}::VARCHAR END" for c in columns)
    return f"""SELECT '{name}' AS name, count(*)::BIGINT AS rows,
  coalesce(sum(('0x'||substr(md5(concat_ws('|', {cells})), 1, 8))::BIGINT), 0)::VARCHAR AS digest FROM ({source})"""


@query(
    _record_sql("customers", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS seg FROM customer", ["c_custkey", "c_name", "seg"])
    + " UNION ALL "
    + _record_sql("turns", "SELECT conv_id, turn, role, text FROM conversations", ["conv_id", "turn", "role", "text"])
)
def stage_record(spark, folder):
    """The record of a stage of two tables: rows and digests of what its files hold."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", F.expr("CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS seg"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return io.commit_stage({"customers": customers, "turns": turns}, _fresh(spark), "r1", "03_notes")
