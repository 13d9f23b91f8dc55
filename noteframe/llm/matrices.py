"""Token-id matrices by best-fit-decreasing packing with a segment tree over capacities.

A task tokenises its documents in groups of about ``group_tokens`` tokens. Documents longer
than a row are split without loss into full rows and a rest. The pieces of a group are placed
by decreasing size into the fullest row that still has room; a segment tree over the free
capacities finds it in ``log2(row)`` steps. Rows come out as padded ids with cumulative segment
lengths and with positions that start anew at each segment. No shuffle is needed: a task packs
what it scans, so a lost executor repeats only its own splits and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import tokenizer

SCHEMA = (
    "sequence_id long, ids binary, positions binary, segment_ends array<int>, "
    "doc_ids array<long>, starts array<long>, doc_tokens array<long>"
)


class CapacityTree:
    """Rows by free capacity: a segment tree that counts the rows below each node."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, free: int, by: int) -> None:
        node = self.leaves + free
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._change(free, 1)

    def take(self, free: int) -> int:
        self._change(free, -1)
        return self.rows[free].pop()

    def fit(self, size: int) -> int | None:
        """The smallest free capacity of at least ``size`` that a row has."""
        node, count = self.leaves + size, self.count
        if count[node]:
            return size
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; pieces by decreasing size, ties in the order given."""
    tree, rows = CapacityTree(capacity), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[piece]
        free = tree.fit(size)
        if free is None:
            row, free = len(rows), capacity
            rows.append([])
        else:
            row = tree.take(free)
        rows[row].append(piece)
        if free > size:
            tree.put(free - size, row)
    return rows


def token_matrices(
    docs: DataFrame,
    tokenizer_path: str,
    row: int = 2048,
    end_id: int = 1,
    pad_id: int = 0,
    group_tokens: int = 4_000_000,
) -> DataFrame:
    """One table row per packed row of ``row`` ids.

    ids and positions (little-endian unsigned 32-bit, padded with ``pad_id`` and 0), segment_ends
    (cumulative lengths; the last is the fill), and per segment its document, its first token
    there and the document's length. A document is its ids and ``end_id``, so null and empty
    texts are one token. Each id lies in one segment. Equal rows are separate documents, a null
    doc_id stays null, an empty table gives no rows, further columns are not read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer(tokenizer_path)
        end = np.array([end_id], np.uint32)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        pieces: list[tuple] = []
        waiting = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc in enumerate(ids):
                tokens = np.concatenate((encode.ids(texts[i].as_py()), end))
                n = len(tokens)
                pieces += [(doc, at, tokens[at : at + row], n) for at in range(0, n, row)]
                waiting += n
                if waiting >= group_tokens:
                    for out in _rows(pieces, row, pad_id, first):
                        yield out
                        first += out.num_rows
                    pieces, waiting = [], 0
        for out in _rows(pieces, row, pad_id, first):
            yield out
            first += out.num_rows

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return slim.mapInArrow(pack, SCHEMA)


def _rows(pieces: list[tuple], row: int, pad_id: int, first: int) -> Iterator[pa.RecordBatch]:
    packed = best_fit([len(p[2]) for p in pieces], row)
    for low in range(0, len(packed), 256):
        part = packed[low : low + 256]
        ids = np.full((len(part), row), pad_id, "<u4")
        positions = np.zeros((len(part), row), "<u4")
        columns: tuple[list, ...] = ([], [], [], [])
        for r, members in enumerate(part):
            at, ends = 0, []
            for m in members:
                n = len(pieces[m][2])
                ids[r, at : at + n] = pieces[m][2]
                positions[r, at : at + n] = np.arange(n)
                at += n
                ends.append(at)
            for column, value in zip(
                columns,
                (ends, *[[pieces[m][k] for m in members] for k in (0, 1, 3)]),
                strict=True,
            ):
                column.append(value)
        numbers = np.arange(first + low, first + low + len(part))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        lists = [pa.array(c, pa.list_(t)) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(numbers),
                pa.array([x.tobytes() for x in ids], pa.binary()),
                pa.array([x.tobytes() for x in positions], pa.binary()),
                *lists,
            ],
            names=["sequence_id", "ids", "positions", "segment_ends", "doc_ids", "starts", "doc_tokens"],
        )


def segments(rows: DataFrame) -> DataFrame:
    """One row per segment, read back from the matrices: doc_id, start, length, ids and
    positions (bytes), doc_tokens, sequence_id, offset."""
    each = rows.select(
        "sequence_id",
        "ids",
        "positions",
        "segment_ends",
        F.posexplode(F.arrays_zip("doc_ids", "starts", "doc_tokens", "segment_ends")),
    ).selectExpr(
        "*", "CASE WHEN pos = 0 THEN 0 ELSE get(segment_ends, pos - 1) END AS offset"
    )
    length = F.col("col.segment_ends") - F.col("offset")
    return each.select(
        F.col("col.doc_ids").alias("doc_id"),
        F.col("col.starts").alias("start"),
        length.cast("long").alias("length"),
        F.expr("substring(ids, 4 * offset + 1, 4 * (col.segment_ends - offset))").alias("ids"),
        F.expr("substring(positions, 4 * offset + 1, 4 * (col.segment_ends - offset))").alias("positions"),
        F.col("col.doc_tokens").alias("doc_tokens"),
        "sequence_id",
        F.col("offset").cast("long").alias("offset"),
    )
