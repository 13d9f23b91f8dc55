"""Training sets folded into cells: rows of equal bins and class, with counts.

A tree that is grown on bins does not tell rows of a cell apart, so sums over a set are sums over
its cells. Each task folds its rows, then the parts of a cell meet in one group. The cells of a
set are few even where its rows are many, as they lie in a small share of the combinations of
bins; a set of more than ``CELLS`` cells is left to fits on rows (``Folded`` says so).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Bins of a feature: five bits of a packed word.
BINS = 32
_PER_WORD = 12
#: The most cells of a set that one task works on.
CELLS = 1 << 17
_SLOTS = 8
_WAITING = 1 << 15


def packed(bins: np.ndarray) -> np.ndarray:
    """(row, word) of columns below 32, twelve to a word."""
    out = np.zeros((len(bins), max(1, -(-bins.shape[1] // _PER_WORD))), np.int64)
    for j in range(bins.shape[1]):
        out[:, j // _PER_WORD] |= bins[:, j].astype(np.int64) << (5 * (j % _PER_WORD))
    return out


def unpacked(words: np.ndarray, width: int) -> np.ndarray:
    """The columns that ``packed`` has put together."""
    out = np.empty((len(words), width), np.uint8)
    for j in range(width):
        out[:, j] = (words[:, j // _PER_WORD] >> (5 * (j % _PER_WORD))) & (BINS - 1)
    return out


def groups(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts of equal rows in it, number of the group of each row) of packed rows."""
    order = np.lexsort(words.T)
    ranked = words[order]
    new = np.ones(len(words), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(1)
    of = np.empty(len(words), np.int64)
    of[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), of


def _summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(words):
        return words, counts
    order, starts, _ = groups(words)
    return words[order][starts], np.add.reduceat(counts[order], starts, 0, np.uint32)


def _slots(words: np.ndarray) -> np.ndarray:
    mixed = words.view(np.uint64).copy()
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return (np.bitwise_xor.reduce(mixed, 1) >> np.uint64(40)) % np.uint64(_SLOTS)


def _narrow(counts: np.ndarray) -> np.ndarray:
    most = int(counts.max(initial=0))
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def binned(matrix: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """(row, feature): how many edges lie below a value."""
    if not len(edges):
        return np.zeros((len(matrix), 0), np.uint8)
    return np.stack([np.searchsorted(e, matrix[:, j]) for j, e in enumerate(edges)], 1).astype(np.uint8)


def arrays(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


@dataclass
class Folded:
    """Parts (pair, n, words, counts) of the cells, and how many there are of the largest pair."""

    table: DataFrame
    pairs: list[tuple[str, str]]
    edges: dict[tuple[str, str], list[np.ndarray]]
    cells: int

    @property
    def few(self) -> bool:
        return self.cells <= CELLS


def fold(rows: DataFrame, y: str, key: str, edges: dict, columns: int, draws: Callable, picked: Callable) -> Folded:
    """The cells of every (features, role) of ``edges``.

    ``picked(draws(ids), role)`` gives ``columns`` numbers per row, which are summed in its cell;
    rows of zeros are left out. The class is the last packed column.
    """
    pairs = list(edges)
    names = list(dict.fromkeys([c for p in pairs for c in p]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {i: [] for i in range(len(pairs))}

        def merged(i: int) -> tuple[np.ndarray, np.ndarray]:
            words, sums = (np.concatenate([part[j] for part in waiting[i]]) for j in (0, 1))
            waiting[i] = [_summed(words, sums)]
            return waiting[i][0]

        for batch in batches:
            ids = batch.column("_id").to_numpy()
            label = batch.column("_y").to_numpy(zero_copy_only=False).astype(np.int64)
            drawn = draws(ids)
            for i, (f, r) in enumerate(pairs):
                role = batch.column(r).to_numpy(zero_copy_only=False)
                use = np.flatnonzero(role > 0)
                told = picked(drawn[use], role[use])
                some = told.any(1)
                use, told = use[some], told[some]
                if len(use):
                    x = binned(arrays(batch, f)[use], edges[f, r])
                    waiting[i].append(_summed(packed(np.column_stack([x, label[use]])), told))
                    if sum(len(part[0]) for part in waiting[i]) > 2 * _WAITING + 2 * len(waiting[i][0][0]):
                        merged(i)
        for i in range(len(pairs)):
            if waiting[i]:
                words, sums = merged(i)
                yield parts(i, words, sums)

    def parts(i: int, words: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        slot = _slots(words)
        found = [(s, words[slot == s], _narrow(sums[slot == s])) for s in np.unique(slot)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i] * len(found), pa.int32()),
                pa.array([int(s) for s, *_ in found], pa.int32()),
                pa.array([len(w) for _, w, _ in found], pa.int64()),
                pa.array([w.tobytes() for _, w, _ in found], pa.binary()),
                pa.array([c.tobytes() for *_, c in found], pa.binary()),
            ],
            names=["pair", "slot", "n", "words", "counts"],
        )

    def summed(table: pa.Table) -> pa.Table:
        words, sums = _summed(*joined(table, columns))
        return pa.table(
            [table["pair"][:1], pa.array([len(words)], pa.int64()), pa.array([words.tobytes()], pa.binary()), pa.array([_narrow(sums).tobytes()], pa.binary())],
            names=["pair", "n", "words", "counts"],
        )

    slim = rows.select(
        F.xxhash64(key).alias("_id"),
        F.col(y).cast("int").alias("_y"),
        *[F.col(c).cast("int").alias(c) if c in {r for _, r in pairs} else F.col(c) for c in names],
    )
    told = slim.mapInArrow(run, "pair int, slot int, n long, words binary, counts binary")
    table = stored(told.groupBy("pair", "slot").applyInArrow(summed, "pair int, n long, words binary, counts binary"))
    most = table.groupBy("pair").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    return Folded(table, pairs, edges, most or 0)


def joined(table: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts) of some parts of a pair."""
    words, sums = [], []
    for n, w, c in zip(*(table[name].to_pylist() for name in ("n", "words", "counts"))):
        words.append(np.frombuffer(w, np.int64).reshape(n, -1))
        kind = {1: "u1", 2: "<u2", 4: "<u4"}[len(c) // (n * columns)]
        sums.append(np.frombuffer(c, kind).reshape(n, columns).astype(np.uint32))
    return np.concatenate(words), np.concatenate(sums)


def sorted_cells(table: pa.Table, columns: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of the cells without the class, their bins, cell, class and counts of each entry).

    In the order of the words, however the parts come.
    """
    words, counts = joined(table, columns)
    order = np.lexsort(words.T)
    words, counts = words[order], counts[order]
    all_ = unpacked(words, width + 1)
    bare = packed(all_[:, :width])
    ranked, starts, of = groups(bare)
    first = ranked[starts]
    return bare[first], all_[first, :width], of, all_[:, width].astype(np.int64), counts


def dealt(table: DataFrame, units: dict[int, list[int]], name: str = "unit") -> DataFrame:
    """The parts of a pair once for every unit of work on it, each unit in a task if possible."""
    of = F.create_map(*[v for p, some in units.items() for v in (F.lit(p), F.array(*[F.lit(u) for u in some]).cast("array<int>"))])
    tasks = 4 * sum(map(len, units.values()))
    return table.select("*", F.explode(F.element_at(of, F.col("pair"))).alias(name)).repartition(tasks, name)
