"""Exact ranked lexical search with the best position algorithm over impact lists.

One pass takes every text apart and keeps, for the terms that the queries hold, the count of
each in the document (a slim forward index, written to the shared folder) beside the number of
all its terms. The statistics of the collection come from that index. A second pass reads the
index where it lies, in blocks of documents: a block makes one list per term, sorted by impact,
and every query runs the best position algorithm over the lists of its terms:

- sorted access reads on from the best position of each list, the end of its unbroken run of
  seen positions;
- direct access looks each new document up in all other lists, which gives its score and marks
  its positions there as seen, so best positions run ahead of what was read;
- no unseen document can score more than the impacts just after the best positions add up to,
  which is at most the usual threshold of the last positions read. The search stops when that
  sum is strictly below the kth score, so ties are never lost.

Documents are never shuffled; a block gives at most k rows a query, and a limited rank merges
the blocks. Memory is bounded by the block. Queries are handed to tasks in batches of bounded
text, one pass each, so what is broadcast does not grow with the documents or the queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept

#: Bytes: separators become spaces, A-Z become a-z; all bytes above 127 belong to terms.
_TABLE = bytes(
    b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
    for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order: runs of ASCII letters, digits and all that is beyond ASCII."""
    return (text or "").encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Collection:
    """Documents with a term, terms of all documents, and documents that hold each term."""

    documents: int
    terms: int
    holding: Sequence[int]

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.holding[term] + 1)))


class Lists:
    """Impact lists of one block, from its forward index (``start`` cuts ``term`` and ``count``)."""

    def __init__(
        self, ids: list, size: np.ndarray, start: np.ndarray, term: np.ndarray, count: np.ndarray,
        stats: Collection,
    ):
        # documents by id, null last: the smaller place wins a tie
        known = [(i is None, i or 0, at) for at, i in enumerate(ids)]
        order = np.array([at for *_, at in sorted(known)], np.int64)
        self.ids = [ids[i] for i in order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, np.diff(start))
        m = 25 + 75 * size * stats.documents // max(1, stats.terms)
        impact = 1_000_000_000 * count // (1000 * count + 8 * np.repeat(m, np.diff(start)))
        by = np.lexsort((doc, -impact, term))
        self.term, self.doc, self.impact = term[by], doc[by], impact[by]
        self.first = np.searchsorted(self.term, np.arange(len(stats.holding) + 1))
        # the same rows by (term, doc), for direct access
        self.by_doc = np.lexsort((self.doc, self.term))
        self.sorted_doc = self.doc[self.by_doc]
        self.weight = [stats.weight(t) if n else 0 for t, n in enumerate(stats.holding)]

    def search(
        self, query: Sequence[tuple[int, int]], k: int, floor: int = 0, step: int = 8
    ) -> list[tuple[int, int]]:
        """(score, place) of the k best documents of a score above 0, ties to the smaller place.

        ``query`` is (term, times in the query). Documents below ``floor``, the kth score of
        earlier blocks, may be left out. ``read`` counts the sorted accesses made.
        """
        self.read = 0
        lists = []
        for t, times in query:
            low, high = int(self.first[t]), int(self.first[t + 1])
            if low < high and self.weight[t]:
                lists.append((low, high, times * self.weight[t]))
        if not lists:
            return []
        n = len(lists)
        seen = [np.zeros(high - low, bool) for low, high, _ in lists]
        best = [0] * n  # positions before this one are all seen
        known = np.zeros(len(self.ids), bool)
        scores, places = np.empty(0, np.int64), np.empty(0, np.int64)
        while True:
            met = []
            for i, (low, high, _) in enumerate(lists):
                end = min(high - low, best[i] + step)
                met.append(self.doc[low + best[i] : low + end])
                self.read += end - best[i]
            found = np.unique(np.concatenate(met))
            new = found[~known[found]]
            known[new] = True
            total = np.zeros(len(new), np.int64)
            bound = 0
            for i, (low, high, weight) in enumerate(lists):
                row = low + np.searchsorted(self.sorted_doc[low:high], new)
                hit = row < high
                hit[hit] = self.sorted_doc[row[hit]] == new[hit]
                at = self.by_doc[row[hit]]
                total[hit] += weight * self.impact[at]
                seen[i][at - low] = True
                rest = seen[i][best[i] :]
                gap = int(np.argmin(rest)) if len(rest) else 0
                best[i] += len(rest) if len(rest) and rest[gap] else gap
                if low + best[i] < high:
                    bound += weight * int(self.impact[low + best[i]])
            scores, places = np.concatenate((scores, total)), np.concatenate((places, new))
            top = np.lexsort((places, -scores))[:k]
            scores, places = scores[top], places[top]
            least = max(floor, int(scores[-1]) if len(scores) == k else 0)
            if bound == 0 or bound < least:
                break
            step *= 2
        return [(s, p) for s, p in zip(scores.tolist(), places.tolist(), strict=True) if s > 0]


def _batches(items: DataFrame, most: int) -> Iterator[list]:
    """Rows of (item_id, text), in batches of about ``most`` bytes of text by their hash."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / most))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for i in range(parts):
        if rows := items.where(part == i).collect():
            yield rows


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, size, term, count): terms of ``vocabulary`` in each text, and its size in terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, starts, found, counts = [], [0], [], []
            for value in batch.column(1):
                words = terms(value.as_py())
                sizes.append(len(words))
                hits = [t for t in map(vocabulary.get, words) if t is not None]
                term, count = np.unique(np.array(hits, np.int32), return_counts=True)
                found.append(term)
                counts.append(count.astype(np.int32))
                starts.append(starts[-1] + len(term))
            offsets = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found), pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts), pa.int32())),
                ],
                names=["doc_id", "size", "term", "count"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return slim.mapInArrow(run, "doc_id long, size long, term array<int>, count array<int>")


def statistics(index: DataFrame, n_terms: int) -> Collection:
    """Counts of the whole collection; at most one row per term of the batch is gathered."""
    whole = index.agg(F.count_if(F.col("size") > 0), F.sum("size")).first()
    holding = [0] * n_terms
    for row in index.select(F.explode("term").alias("t")).groupBy("t").count().collect():
        holding[row["t"]] = row["count"]
    return Collection(whole[0], whole[1] or 0, holding)


def _block(ids: list, sizes: list, term: list, count: list, stats: Collection) -> Lists:
    start = np.cumsum([0, *map(len, term)])
    flat = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (term, count)]
    return Lists(ids, np.array(sizes, np.int64), start, *flat, stats)


def _answers(
    index: DataFrame, queries: list[list[tuple[int, int]]], stats: Collection, k: int, block_docs: int
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer() -> pa.RecordBatch:
            lists = _block(ids, sizes, term, count, stats)
            rows = []
            for number, query in enumerate(queries):
                found = lists.search(query, k, floors[number])
                rows += [(number, lists.ids[place], score) for score, place in found]
                if len(found) == k:
                    floors[number] = max(floors[number], found[-1][0])
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in columns], names=["number", "doc_id", "score"]
            )

        ids, sizes, term, count = [], [], [], []
        floors = [0] * len(queries)
        for batch in batches:
            ids += batch.column(0).to_pylist()
            sizes += batch.column(1).to_pylist()
            for column, into in ((batch.column(2), term), (batch.column(3), count)):
                into += [x.values.to_numpy() for x in column]
            if len(ids) >= block_docs:
                yield answer()
                ids, sizes, term, count = [], [], [], []
        if ids:
            yield answer()

    return index.mapInArrow(run, "number long, doc_id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    block_docs: int = 50_000,
    batch_bytes: int = 4_000_000,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for each row of ``items``.

    A document scores the sum, over the query's terms with repeats, of the term's weight times
    its impact in the document; see ``Collection`` and ``Lists``. Only scores above 0 count,
    ties go to the smaller doc_id, null ids last. Equal rows of ``docs`` are separate
    documents; equal rows of ``items`` are separate queries. Null and empty texts hold no
    term, so they are never found and find nothing. Empty tables give no rows, further columns
    are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for rows in _batches(asked, batch_bytes):
        split = [terms(r["text"]) for r in rows]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for x in split for t in x))}
        queries = []
        for words in split:
            term, times = np.unique([vocabulary[w] for w in words], return_counts=True)
            queries.append([(int(t), int(n)) for t, n in zip(term, times, strict=True)])
        index = kept(forward_index(docs, vocabulary))
        stats = statistics(index, len(vocabulary))
        found = _answers(index, queries, stats, k, block_docs)
        best = W.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ids = F.array(*[F.lit(r["item_id"]).cast("long") for r in rows])
        named = ranked.withColumn("item_id", F.get(ids, F.col("number").cast("int")))
        out = out.unionByName(named.select("item_id", "rank", "doc_id", "score"))
    return out
