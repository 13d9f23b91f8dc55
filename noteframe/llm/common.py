"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import stored

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def kept(df: DataFrame) -> DataFrame:
    """The table cut from its lineage by a reliable checkpoint in the shared folder."""
    return stored(df)


def components(links: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Connected components of undirected links: (node, root), one row per linked node.

    Randomised contraction: in each round every node takes the neighbour of the smallest
    mixed id (its own included) as its representative, links are rewritten to the
    representatives and loops go. A constant share of the nodes goes in each round, so the
    rounds grow with the logarithm of the nodes. Each round pre-aggregates before it
    shuffles, so a hub costs no more than its links. ``root`` is one node of the component,
    not a particular one. Node ids must be longs; null ends are left out.
    """
    spark = links.sparkSession

    def mixed(name: str, salt: int) -> Column:
        return F.struct(F.xxhash64(F.col(name), F.lit(salt)).alias("h"), F.col(name).alias("id"))

    edges = kept(
        links.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u != v")
        .distinct()
    )
    maps = None
    salt = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(mixed("v", salt)).alias("near"))
        step = kept(near.select("u", F.least("near", mixed("u", salt))["id"].alias("r")))
        if maps is None:
            maps = step.select(F.col("u").alias("node"), F.col("r").alias("root"))
        else:
            maps = maps.join(step, maps["root"] == step["u"], "left").select(
                "node", F.coalesce("r", "root").alias("root")
            )
        maps = kept(maps)
        left_ends = step.select(F.col("u"), F.col("r").alias("ru"))
        right_ends = step.select(F.col("u").alias("v"), F.col("r").alias("rv"))
        edges = kept(
            edges.join(left_ends, "u")
            .join(right_ends, "v")
            .select(F.col("ru").alias("u"), F.col("rv").alias("v"))
            .where("u != v")
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            .distinct()
        )
        salt += 1
    if maps is None:
        return spark.createDataFrame([], "node long, root long")
    return maps


def as_row(df: DataFrame) -> Column:
    """All columns as one struct, so that columns added beside it cannot clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])
