"""Random forests of a search, grown and judged on cells.

All sets of a search fold into cells (``cells``: equal bins and class) in one pass over the rows.
A task then takes some trees of one set: it draws how often each cell enters a tree (a sum of
Poisson(1) weights of n rows is a Poisson(n) weight), grows the tree level by level, and drops
the cells that the set is judged on through it at once. Draws depend on (seed, tree) alone and not
on how the table is cut, and a tree that ends at a lower depth is the beginning of the deeper one,
so candidates that differ in depth share their growth. Trees never reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import boosting, cells

BINS = cells.BINS
#: The depth of a forest without one, as in ``models.Forest``.
DEEPEST = 30
#: Trees of one task.
TREES = 25
_SHARES = [i / 1024 for i in range(1025)]
#: Shares of a tree are added up in whole parts of this, so that sums do not depend on their order.
_PART = 1 << 40


@dataclass(frozen=True)
class Plan:
    """One forest: feature array column, role column (1 trained on, 2 judged) and its settings."""

    features: str
    role: str
    trees: int
    max_depth: int | None
    min_leaf: int
    seed: int


def strides(values: np.ndarray) -> np.ndarray:
    """At most 31 edges between the distinct of many quantiles, about even in rows.

    After a frequent value every next one gets an edge until the rows are made up for, so a
    feature that is mostly zero is not cut at zero alone.
    """
    distinct, n = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) < BINS:
        return middles
    stride, out = n.sum() / BINS, []
    before, target = float(n[0]), n.sum() / BINS
    for i in range(1, len(distinct)):
        now = before + n[i]
        if abs(before - target) < abs(now - target) and len(out) < BINS - 1:
            out.append(middles[i - 1])
            target += stride
        before = now
    return np.array(out)


def _best(x: np.ndarray, y: np.ndarray, drawn: np.ndarray, at: np.ndarray, total: np.ndarray, weight: np.ndarray, tried: np.ndarray, min_leaf: int):
    """(gain, feature, bin) of the best split of every node; a gain of 0 is none.

    ``x`` (entry, feature), ``at`` the node of each entry, ``total`` (node, class) drawn rows,
    ``tried`` (node, slot) features.
    """
    nodes, slots = tried.shape
    k = total.shape[1]
    code = (((at[:, None] * slots + np.arange(slots)) * BINS + np.take_along_axis(x, tried[at], 1)) * k + y[:, None]).ravel()
    n = np.repeat(drawn, slots)
    if nodes * slots * BINS * k <= 4 * len(code):
        sums = np.bincount(code, n, nodes * slots * BINS * k).reshape(-1, k)
        place = np.flatnonzero(sums.any(1))
        sums = sums[place]
    else:
        order = np.argsort(code)
        ranked = code[order] // k
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        place = ranked[new]
        sums = np.bincount((np.cumsum(new) - 1) * k + code[order] % k, n[order], len(place) * k).reshape(-1, k)
    slot = place // BINS
    last = np.ones(len(slot), bool)
    last[:-1] = slot[1:] != slot[:-1]
    cum = sums.cumsum(0)
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    size = np.diff(np.append(starts, len(slot)))
    left = cum - np.repeat(cum[starts] - sums[starts], size, 0)
    node = slot // slots
    right = total[node] - left
    fine = ~last & (left.sum(1) >= min_leaf) & (right.sum(1) >= min_leaf)
    gain = np.zeros(len(slot))
    if fine.any():
        a, b, whole = left[fine] * weight, right[fine] * weight, (total * weight)[node[fine]]
        purity = lambda v: (v * v).sum(1) / v.sum(1)
        parent = purity(whole)
        found = purity(a) + purity(b) - parent
        gain[fine] = np.where(found > 1e-10 * parent, found, 0.0)
    first = np.flatnonzero(np.diff(node, prepend=-1))
    top = np.zeros(nodes)
    top[node[first]] = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero((gain > 0) & (gain == top[node]))
    feature, bin_ = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    feature[node[hit[::-1]]] = tried[node[hit[::-1]], slot[hit[::-1]] % slots]
    bin_[node[hit[::-1]]] = place[hit[::-1]] % BINS
    return top, feature, bin_


def grow(
    x: np.ndarray, y: np.ndarray, n: np.ndarray, weight: np.ndarray, judged: np.ndarray, min_leaf: int, depths: Sequence[int], rng: np.random.Generator
) -> dict[int, np.ndarray]:
    """Class shares (row of ``judged``, class) that one tree gives when it ends at each depth.

    ``x`` (entry, feature) bins with class ``y`` and ``n`` rows; ``weight`` of each class.
    """
    k, width = len(weight), x.shape[1]
    slots = math.ceil(math.sqrt(width))
    drawn = rng.poisson(n).astype(float)
    used = np.flatnonzero(drawn)
    x, y, drawn, at = x[used].astype(np.int64), y[used], drawn[used], np.zeros(len(used), np.int64)
    shares = {d: np.full((len(judged), k), 1 / k) for d in depths}
    if not len(used):
        return shares
    rows, place, nodes = np.arange(len(judged)), np.zeros(len(judged), np.int64), 1
    for level in range(max(depths) + 1):
        total = np.bincount(at * k + y, drawn, nodes * k).reshape(nodes, k)
        value = total * weight
        value /= value.sum(1, keepdims=True)
        split = np.zeros(nodes, bool)
        if level < max(depths) and width:
            tried = np.argsort(rng.random((nodes, width)), 1)[:, :slots]
            open_ = ((total > 0).sum(1) > 1) & (total.sum(1) >= 2 * min_leaf)
            some = np.flatnonzero(open_[at])
            if len(some):
                top, feature, bin_ = _best(x[some], y[some], drawn[some], at[some], total, weight, tried, min_leaf)
                split = top > 0
        for d in depths:
            if d == level:
                shares[d][rows] = value[place]
            elif d > level:
                ends = ~split[place]
                shares[d][rows[ends]] = value[place[ends]]
        if not split.any():
            break
        low = 2 * (np.cumsum(split) - 1)
        kept = np.flatnonzero(split[at])
        x, y, drawn, at = x[kept], y[kept], drawn[kept], at[kept]
        at = low[at] + (x[np.arange(len(at)), feature[at]] > bin_[at])
        on = np.flatnonzero(split[place])
        rows, place = rows[on], place[on]
        place = low[place] + (judged[rows, feature[place]] > bin_[place])
        nodes = 2 * int(split.sum())
    return shares


@dataclass
class Sets:
    """The folded sets of a search, on which forests are grown and judged."""

    folded: cells.Folded
    n_classes: int

    def judged(self, plans: Sequence[Plan]) -> DataFrame:
        """(plan, cell, p, n): per cell that a plan is judged on, its class shares and its rows by class."""
        k, pairs = self.n_classes, self.folded.pairs
        widths = [len(self.folded.edges[p]) for p in pairs]
        grown: dict[tuple, list[int]] = {}
        for i, p in enumerate(plans):
            grown.setdefault((pairs.index((p.features, p.role)), p.trees, p.min_leaf, p.seed), []).append(i)
        units = [(told, some, low) for told, some in grown.items() for low in range(0, told[1], TREES)]
        depth = {i: p.max_depth if p.max_depth is not None else DEEPEST for i, p in enumerate(plans)}

        def run(table: pa.Table) -> pa.Table:
            (pair, trees, min_leaf, seed), asked, low = units[table["unit"][0].as_py()]
            words, bins, cell, label, counts = cells.sorted_cells(table, 2, widths[pair])
            trained = counts[:, 0] > 0
            x, y, n = bins[cell[trained]], label[trained], counts[trained, 0]
            rows = np.bincount(y, n, k)
            weight = np.where(rows > 0, rows.sum() / (max(1, (rows > 0).sum()) * np.maximum(rows, 1)), 0.0)
            told = np.zeros((len(bins), k), np.int64)
            told[cell, label] = counts[:, 1]
            met = np.flatnonzero(told.any(1))
            votes = {d: np.zeros((len(met), k), np.int64) for d in {depth[i] for i in asked}}
            for t in range(low, min(low + TREES, trees)):
                found = grow(x, y, n, weight, bins[met], min_leaf, list(votes), np.random.default_rng([seed, t]))
                for d, share in found.items():
                    votes[d] += np.rint(share * _PART).astype(np.int64)
            names = pa.array([words[i].tobytes() for i in met], pa.binary())
            parts = [
                pa.table(
                    [
                        pa.array(np.full(len(met), i, np.int32)),
                        names,
                        *[pa.array(votes[depth[i]][:, c]) for c in range(k)],
                        *[pa.array(told[met, c]) for c in range(k)],
                    ],
                    names=["plan", "cell", *[f"p{c}" for c in range(k)], *[f"n{c}" for c in range(k)]],
                )
                for i in asked
            ]
            return pa.concat_tables(parts)

        of: dict[int, list[int]] = {}
        for u, ((pair, *_), _, _) in enumerate(units):
            of.setdefault(pair, []).append(u)
        long = ", ".join(f"{v}{c} long" for v in "pn" for c in range(k))
        votes = cells.dealt(self.folded.table.where(F.col("pair").isin(list(of))), of).groupBy("unit").applyInArrow(run, f"plan int, cell binary, {long}")
        sums = votes.groupBy("plan", "cell").agg(*[F.sum(f"p{c}").alias(f"p{c}") for c in range(k)], *[F.max(f"n{c}").alias(f"n{c}") for c in range(k)])
        whole = sum([F.col(f"p{c}") for c in range(k)], F.lit(0))
        return stored(
            sums.select("plan", "cell", F.array(*[F.col(f"p{c}") / whole for c in range(k)]).alias("p"), F.array(*[F.col(f"n{c}") for c in range(k)]).alias("n"))
        )

    def named(self, rows: DataFrame, columns: Sequence[str], plan: Plan) -> DataFrame:
        """The rows that a plan is judged on: some columns, and the ``cell`` that each lies in."""
        edges = self.folded.edges[plan.features, plan.role]
        some = rows.where(F.col(plan.role) == 2).select(*columns, F.col(plan.features).alias("_x"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields[:-1])

        def run(batches):
            for batch in batches:
                words = cells.packed(cells.binned(cells.arrays(batch, "_x"), edges))
                cell = pa.array([w.tobytes() for w in words], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], cell], names=[*columns, "cell"])

        return some.mapInArrow(run, f"{schema}, cell binary")


def folded_sets(rows: DataFrame, y: str, key: str, n_classes: int, pairs: Sequence[tuple[str, str]]) -> Sets | None:
    """The sets (features, role) of a search as cells, or None where one has too many."""
    if n_classes > BINS:
        return None
    edges = {p: [strides(v) for v in values] for p, values in boosting.quantiles(rows, pairs, _SHARES).items()}
    roles = lambda none, role: np.stack([role == 1, role == 2], 1).astype(np.uint8)
    folded = cells.fold(boosting._spread(rows, key), y, key, edges, 2, lambda ids: ids, roles)
    return Sets(folded, n_classes) if folded.few else None
