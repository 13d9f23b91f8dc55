"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Vectors are dealt by hash into blocks, queries into blocks, and each pair of blocks is one
group: a task sorts its vectors once per dimension and answers its queries by sorted access
from the end of each list that the sign of the query's component asks for, random access for
the full score of what is met, and stops as soon as the sum of the frontiers falls below the
kth score. Each group gives at most k rows a query; a limited rank merges the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept

SCALE = 1024


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, copies): integer components of the vectors that take part, copies folded.

    Null vectors and vectors with null or non-finite components take no part.
    """
    whole = F.transform(
        F.col("embedding"), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long")
    )
    bad = F.exists(
        F.col("embedding"),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
    )
    fine = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~bad)
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).groupBy(
        "vec_id", "v"
    ).agg(F.count("*").alias("copies"))


class Lists:
    """Vectors of one block with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.copies = ids[order], vectors[order], copies[order]
        self.up = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.up, axis=0)

    def search(self, query: np.ndarray, own: int, k: int, first: int = 8) -> list[tuple[int, int, int]]:
        """(score, place, copies) of the k best, ties to the smaller id; ``own`` copies less one."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        seen = np.zeros(n, bool)
        best_score = np.empty(0, np.int64)
        best_at = np.empty(0, np.int64)
        depth, step = 0, first
        while depth < n:
            high = min(n, depth + step)
            if len(used):
                down = query[used] > 0
                rows = np.arange(depth, high)[:, None]
                rows = np.where(down[None, :], n - 1 - rows, rows)
                met = np.unique(self.up[rows, used[None, :]])
                bound = int(self.sorted[np.where(down, n - high, high - 1), used] @ query[used])
            else:
                met, bound, high = np.arange(n), 0, n
            new = met[~seen[met]]
            seen[new] = True
            scores = self.vectors[new] @ query
            best_score, best_at = np.concatenate((best_score, scores)), np.concatenate((best_at, new))
            keep = np.lexsort((best_at, -best_score))
            weight = self.copies[best_at[keep]] - (best_at[keep] == own)
            enough = int(np.searchsorted(np.cumsum(weight), k)) + 1
            keep = keep[:enough]
            best_score, best_at = best_score[keep], best_at[keep]
            full = weight[:enough].sum() >= k
            if full and int(best_score[-1]) > bound:  # at a tie an unseen id could be smaller
                break
            depth, step = high, step * 2
        out = []
        for score, at in zip(best_score.tolist(), best_at.tolist(), strict=True):
            if copies := int(self.copies[at]) - (at == own):
                out.append((score, at, copies))
        return out


def _answers(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Best k of the block's vectors (right) for each query (left)."""
    out: tuple[list, ...] = ([], [], [], [], [])
    if left.num_rows and right.num_rows:
        dim = right["dim"][0].as_py()
        flat = right["v"].combine_chunks().values.to_numpy(zero_copy_only=False)
        lists = Lists(
            right["vec_id"].to_numpy(),
            flat.astype(np.int64).reshape(right.num_rows, dim),
            right["copies"].to_numpy(),
        )
        queries = left["v"].combine_chunks().values.to_numpy(zero_copy_only=False)
        queries = queries.astype(np.int64).reshape(left.num_rows, dim)
        for i, (query, row) in enumerate(
            zip(left["vec_id"].to_pylist(), left["row"].to_pylist(), strict=True)
        ):
            low, high = np.searchsorted(lists.ids, [query, query + 1])
            own = next((j for j in range(low, high) if (lists.vectors[j] == queries[i]).all()), -1)
            for score, at, copies in lists.search(queries[i], own, k):
                for column, value in zip(
                    out, (query, row, int(lists.ids[at]), score, min(copies, k)), strict=True
                ):
                    column.append(value)
    names = ["query_id", "row", "vec_id", "score", "copies"]
    return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, out, strict=True)})


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vector_block: int = 8192,
    query_block: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every query row, itself left out.

    Scores are inner products of floor(1024 * x); ties go to the smaller vec_id. Only vectors
    of equal length are compared. A row whose vec_id is null takes no part. Rows that repeat
    are candidates of each other and are searched once each; a query with fewer candidates
    gives all of them. An empty table gives no rows, further columns are not read.
    """
    sized = kept(quantised(vectors).withColumn("dim", F.size("v")))
    counts = sized.agg(F.count("*"), F.count_if(is_query)).first()
    n, n_queries = counts[0], counts[1]
    asked = sized.where(is_query).withColumn("row", F.xxhash64("v"))
    blocks = max(1, math.ceil(n / vector_block))
    parts = max(1, math.ceil(n_queries / query_block))
    left = asked.select(
        "vec_id",
        "v",
        "row",
        "dim",
        (F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts))).alias("part"),
        F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"),
    )
    right = sized.select(
        "vec_id",
        "v",
        "copies",
        "dim",
        F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks)).alias("block"),
        F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"),
    )
    keys = ["dim", "block", "part"]
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(
            lambda a, b: _answers(a, b, k),
            "query_id long, row long, vec_id long, score long, copies long",
        )
    )
    order = W.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    each = found.select(
        "query_id", "row", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).drop("col")
    best = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    again = asked.where("copies > 1").select(
        F.col("vec_id").alias("id"),
        F.col("row").alias("of"),
        F.explode(F.sequence(F.lit(2), F.col("copies").cast("int"))),
    )
    repeated = best.join(again, (best["query_id"] == again["id"]) & (best["row"] == again["of"]))
    columns = ["query_id", "rank", "vec_id", "score"]
    return best.select(*columns).unionByName(repeated.select(*columns))
