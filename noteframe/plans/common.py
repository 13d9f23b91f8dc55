"""Table access and small helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_SEED = 20260324


_SCHEMAS: dict = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table; its schema is read once per path, so later reads start no job."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


#: Session setting: the number of tasks that work bound by CPU is dealt over. For tables that
#: lie in few large row groups; where it is unset, rows are worked on where they are read.
CPU_TASKS = "spark.noteframe.cpu.tasks"


def dealt(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as the session asks for, or as they are."""
    tasks = df.sparkSession.conf.get(CPU_TASKS, None)
    return df.repartition(int(tasks)) if tasks else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Round doubles at the last step, so that summation order does not show."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with totals of its orders (0 for customers without orders)."""
    orders = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("patient_id"))
        .agg(
            F.count("*").alias("n_orders"),
            F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
        )
    )
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("patient_id"),
        F.col("c_nationkey").alias("nk"),
        F.col("c_acctbal").alias("bal"),
        F.col("c_mktsegment").alias("seg"),
    )
    # Both sides hold a customer once: the primary key, and the output of a groupBy. The
    # partition count is fixed here, so CPU-bound text work that follows keeps its tasks; the
    # join needs this shuffle anyway and later joins on the key reuse it.
    customers = customers.repartition(shuffle_partitions(spark), "patient_id")
    joined = customers.join(orders, "patient_id", "left")
    return joined.fillna(0, ["n_orders", "n_open", "n_urgent"]).fillna(0.0, ["total"])


ACCOUNTS_SQL = """
acc AS (
  SELECT c.c_custkey AS patient_id, c.c_nationkey AS nk, c.c_acctbal AS bal, c.c_mktsegment AS seg,
    coalesce(n_orders, 0) AS n_orders, coalesce(n_open, 0) AS n_open, coalesce(n_urgent, 0) AS n_urgent,
    coalesce(total, 0.0) AS total
  FROM customer c LEFT JOIN (
    SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open,
      count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
      sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total
    FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey)"""
