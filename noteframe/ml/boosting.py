"""Boosted trees for several classes, with all models of a search grown in one sequence of jobs.

Features are cut into at most ``BINS`` bins once. Rows lie in blocks of binary columns, so a pass
costs no conversion per value. One pass per tree level sums the histogram of gradients over
(feature, bin, node, class) for every model at once; each model's partial histograms meet in
one group, which picks the splits. So a search costs rounds x depth jobs, however many folds
and candidates it has: folds are role columns (1: a training row of the model).

Where the rows of each model fold into few cells (``cells``: equal bins and class), each model is
grown on its cells by one task instead, from how many rows of a cell each round draws: the same
sums in the same order of steps, and two passes over the rows in all.

Margins are cached from round to round and written to the checkpoint folder every few rounds,
so a lost executor repeats few rounds. Nothing but splits and leaf values reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import cells

BINS = cells.BINS
BLOCK = 2048
NEVER = 255
#: Rounds between two checkpoints of the margins.
REFRESH = 10


@dataclass(frozen=True)
class Plan:
    """One model of a joint fit: feature array column, role column, tree depth and seed."""

    features: str
    role: str
    max_depth: int
    seed: int = 0


@dataclass(frozen=True)
class Settings:
    rounds: int = 150
    step: float = 0.05
    rows: float = 0.85
    columns: float = 0.85
    penalty: float = 1.0
    min_weight: float = 1.0


@dataclass
class Ensemble:
    """Trees of one model in heap order: (round, class, node).

    A row goes right where its value is above ``threshold``; ``value`` is that of the leaves,
    ``cover`` the training weight (second derivatives) of every node.
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        rounds, classes, nodes = self.feature.shape
        depth = (nodes + 1).bit_length() - 1
        out = np.zeros((len(x), classes))
        rows = np.arange(len(x))[:, None]
        tree = np.arange(classes)[None, :]
        for r in range(rounds):
            at = np.zeros((len(x), classes), np.int64)
            for _ in range(depth):
                above = x[rows, self.feature[r][tree, at]] > self.threshold[r][tree, at]
                at = 2 * at + 1 + above
            out += self.value[r][tree, at - nodes]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(x))


def softmax(margins: np.ndarray) -> np.ndarray:
    """Over the last axis."""
    e = np.exp(margins - margins.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def quantiles(rows: DataFrame, pairs: Sequence[tuple[str, str]], shares: Sequence[float]) -> dict[tuple[str, str], list[np.ndarray]]:
    """Quantiles of every feature of each (features, role), from one pass over the rows."""
    sizes = rows.select(*[F.max(F.size(f)).alias(f) for f in {f for f, _ in pairs}]).first().asDict()
    told = F.lit(np.array(shares, float))  # one literal, not a call for every share of every column
    names, columns = [], []
    for f, role in pairs:
        for j in range(sizes[f] or 0):
            value = F.when(F.col(role) == 1, F.get(f, F.lit(j)))
            columns.append(F.percentile_approx(value, told, 2000).alias(f"q{len(names)}"))
            names.append((f, role))
    found = rows.agg(*columns).first() if columns else []
    out: dict[tuple[str, str], list[np.ndarray]] = {p: [] for p in pairs}
    for name, values in zip(names, found, strict=True):
        out[name].append(np.array(values or [], float))
    return out


def _edges(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], list[np.ndarray]]:
    """Bin edges of every feature of each (features, role)."""
    found = quantiles(rows, pairs, [i / BINS for i in range(1, BINS)])
    return {p: [np.unique(v) for v in values] for p, values in found.items()}


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A draw in [0, 1) from a mix of 64-bit ids and a salt."""
    mixed = ids.view(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows over all cores, a block for each task at least.

    A small table lies in one partition, where a pass would have one task. A fit does not
    depend on how the table is cut.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = min(-(-rows.count() // BLOCK), max(cores, rows.rdd.getNumPartitions()))
    return rows.repartition(max(1, tasks), F.xxhash64(key))


def _blocks(
    rows: DataFrame, y: str, key: str, plans: Sequence[Plan], edges: dict, n_classes: int
) -> DataFrame:
    """Blocks of rows: ids, classes, roles per model, bins per (features, role), margins."""
    pairs = list(edges)
    features = list(dict.fromkeys(f for f, _ in pairs))
    roles = [p.role for p in plans]
    names = list(dict.fromkeys(roles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                n = part.num_rows
                column = {c: part.column(c) for c in part.schema.names}
                matrix = {f: column[f].flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for f in features}
                bins = [
                    np.stack([np.searchsorted(e, matrix[f][:, j]) for j, e in enumerate(edges[f, r])], 1)
                    if edges[f, r] else np.zeros((n, 0))
                    for f, r in pairs
                ]
                role = {r: column[r].to_numpy(zero_copy_only=False).astype(np.int8) for r in names}
                cells = [
                    column["_id"].to_numpy().tobytes(),
                    column["_y"].to_numpy(zero_copy_only=False).astype(np.int8).tobytes(),
                    np.stack([role[r] for r in roles]).tobytes(),
                    b"".join(b.astype(np.uint8).tobytes() for b in bins),
                    np.zeros(n * len(plans) * n_classes).tobytes(),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n]), *[pa.array([c], pa.binary()) for c in cells]],
                    names=["n", "id", "y", "role", "bins", "margin"],
                )

    slim = rows.select(
        F.xxhash64(key).alias("_id"),
        F.col(y).cast("int").alias("_y"),
        *[F.col(r).cast("int").alias(r) for r in names],
        *features,
    )
    return slim.mapInArrow(run, "n long, id binary, y binary, role binary, bins binary, margin binary")


class _Block:
    """The arrays of one block, and what a pass computes from them."""

    def __init__(self, row: dict, plans: Sequence[Plan], widths: list[int], which: list[int], n_classes: int):
        n = self.n = row["n"]
        self.plans, self.which, self.k = plans, which, n_classes
        self.id = np.frombuffer(row["id"], np.int64)
        self.y = np.frombuffer(row["y"], np.int8).astype(np.int64)
        self.role = np.frombuffer(row["role"], np.int8).reshape(len(plans), n)
        flat, low, self.bins = np.frombuffer(row["bins"], np.uint8), 0, []
        for width in widths:
            self.bins.append(flat[low : low + n * width].reshape(n, width))
            low += n * width
        self.margin = np.frombuffer(row["margin"], float).reshape(len(plans), n, n_classes)

    def nodes(self, m: int, feature: np.ndarray, threshold: np.ndarray, depth: int) -> np.ndarray:
        """Heap node (n, class) after ``depth`` steps down the trees of model ``m``."""
        at = np.zeros((self.n, self.k), np.int64)
        x = self.bins[self.which[m]]
        if not x.shape[1]:
            return (1 << depth) - 1 + at
        flat, first = x.ravel(), np.arange(self.n)[:, None] * x.shape[1]
        tree = np.arange(self.k)[None, :] * feature.shape[1]
        for _ in range(depth):
            cell = tree + at
            at = 2 * at + 1 + (flat.take(first + feature.take(cell)) > threshold.take(cell))
        return at

    def histogram(self, m: int, at: np.ndarray, level: int, draw: float, salt: int) -> np.ndarray:
        """(class, node, feature, bin, 2): sums of first and second derivatives."""
        use = self.role[m] == 1
        if draw < 1:
            use = use & (_uniform(self.id, salt) < draw)
        x = self.bins[self.which[m]][use].astype(np.int64)
        width, nodes = x.shape[1], 1 << level
        out = np.zeros((self.k, nodes, width, BINS, 2))
        if not len(x) or not width:
            return out
        p = softmax(self.margin[m][use])
        cell = np.arange(width)[None, :] * BINS + x
        for k in range(self.k):
            index = ((at[use, k] - nodes + 1)[:, None] * (width * BINS) + cell).ravel()
            for i, value in enumerate((p[:, k] - (self.y[use] == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-16))):
                sums = np.bincount(index, np.repeat(value, width), nodes * width * BINS)
                out[k, ..., i] = sums.reshape(nodes, width, BINS)
        return out


def best_splits(hist: np.ndarray, allowed: np.ndarray, settings: Settings) -> dict[str, np.ndarray]:
    """Best split of every (class, node), with values and covers of its two sides.

    ``allowed`` (class, feature) are the columns each tree may use. A node without a split
    sends all rows left and keeps its own value.
    """
    left = hist.cumsum(3)
    total = left[:, :, :1, -1:, :] if hist.shape[2] else np.zeros((*hist.shape[:2], 1, 1, 2))
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + settings.penalty)
    gain = score(left) + score(right) - score(total)
    fine = (left[..., 1] >= settings.min_weight) & (right[..., 1] >= settings.min_weight)
    gain = np.where(fine & allowed[:, None, :, None], gain, -1.0)
    k, nodes = hist.shape[:2]
    flat = gain.reshape(k, nodes, -1)
    at = flat.argmax(-1) if flat.shape[-1] else np.zeros((k, nodes), np.int64)
    split = np.take_along_axis(flat, at[..., None], -1)[..., 0] > 1e-9 if flat.shape[-1] else at < 0
    feature, bin_ = np.where(split, at // BINS, 0), np.where(split, at % BINS, NEVER)
    i, j = np.indices((k, nodes))
    whole = total[:, :, 0, 0, :]
    low = np.where(split[..., None], left[i, j, feature, np.minimum(bin_, BINS - 1)], whole) if hist.shape[2] else whole
    high = whole - low
    value = lambda s: -settings.step * s[..., 0] / (s[..., 1] + settings.penalty)
    own = value(whole)
    return {
        "feature": feature,
        "bin": bin_,
        "left": np.where(split, value(low), own),
        "right": np.where(split, value(high), own),
        "cover_left": low[..., 1],
        "cover_right": high[..., 1],
        "cover": whole[..., 1],
    }


def _columns(seed: int, round_: int, n_classes: int, width: int, share: float) -> np.ndarray:
    """Columns that each tree of a round may use, the same wherever it is asked."""
    rng = np.random.default_rng([seed, round_])
    allowed = np.zeros((n_classes, width), bool)
    for k in range(n_classes):
        allowed[k, rng.permutation(width)[: max(1, round(share * width))]] = True
    return allowed


def fit_boosted(
    rows: DataFrame, y: str, key: str, n_classes: int, plans: Sequence[Plan], settings: Settings
) -> list[Ensemble]:
    """One ensemble per plan, each by a task on its cells, or all together on rows.

    A plan's role column is 1 on its training rows; other rows leave it as it is. ``key``
    names a row for the draws of rows, so a fit does not depend on how the table is cut.
    """
    pairs = list(dict.fromkeys((p.features, p.role) for p in plans))
    edges = _edges(rows, pairs)
    widths = [len(edges[p]) for p in pairs]
    which = [pairs.index((p.features, p.role)) for p in plans]
    spread = _spread(rows, key)
    grown = _grown_on_cells(spread, y, key, n_classes, plans, settings, edges, which)
    if grown is None:
        grown = _grown_on_rows(spread, y, key, n_classes, plans, settings, edges, widths, which)
    return [_ensemble(g, edges[p.features, p.role]) for g, p in zip(grown, plans, strict=True)]


def _cell_trees(
    x: np.ndarray, cell: np.ndarray, label: np.ndarray, drawn: np.ndarray, n_classes: int, plan: Plan, settings: Settings
) -> list[dict]:
    """The trees of one model, by bins ``x`` (cell, feature) and entries (cell, class, rows of each round)."""
    size, width = x.shape
    inner, columns = (1 << plan.max_depth) - 1, np.arange(n_classes)[None, :]
    margin, place, trees = np.zeros((size, n_classes)), np.arange(width)[None, :] * BINS + x.astype(np.int64), []
    for round_ in range(settings.rounds):
        n = np.zeros((size, n_classes))
        n[cell, label] = drawn[:, round_]
        total, p = n.sum(1, keepdims=True), softmax(margin)
        first, second = total * p - n, total * np.maximum(p * (1 - p), 1e-16)
        allowed = _columns(plan.seed, round_, n_classes, width, settings.columns)
        tree = {
            "feature": np.zeros((n_classes, inner), np.int64),
            "bin": np.full((n_classes, inner), NEVER, np.int64),
            "value": np.zeros((n_classes, inner + 1)),
            "cover": np.zeros((n_classes, 2 * inner + 1)),
        }
        at = np.zeros((size, n_classes), np.int64)
        for level in range(plan.max_depth):
            nodes = 1 << level
            hist = np.zeros((n_classes, nodes, width, BINS, 2))
            if size and width:
                for k in range(n_classes):
                    index = (at[:, k, None] * (width * BINS) + place).ravel()
                    for i, value in enumerate((first[:, k], second[:, k])):
                        hist[k, ..., i] = np.bincount(index, np.repeat(value, width), nodes * width * BINS).reshape(nodes, width, BINS)
            found = best_splits(hist, allowed, settings)
            _written(tree, found, level, plan.max_depth)
            if width:
                at = 2 * at + (np.take_along_axis(x, found["feature"][columns, at], 1) > found["bin"][columns, at])
            else:
                at = 2 * at
        margin += tree["value"][columns, at]
        trees.append(tree)
    return trees


def _written(tree: dict, found: dict, level: int, depth: int) -> None:
    """Put the splits of a level into the heap arrays of a tree."""
    low, n = (1 << level) - 1, 1 << level
    tree["feature"][:, low : low + n] = found["feature"]
    tree["bin"][:, low : low + n] = found["bin"]
    tree["cover"][:, low : low + n] = found["cover"]
    k = len(tree["value"])
    both = np.stack([found["cover_left"], found["cover_right"]], -1).reshape(k, -1)
    tree["cover"][:, 2 * low + 1 : 2 * low + 1 + 2 * n] = both
    leaves = np.stack([found["left"], found["right"]], -1).reshape(k, -1)
    tree["value"] = np.repeat(leaves, 1 << (depth - level - 1), 1)


def _grown_on_cells(
    rows: DataFrame, y: str, key: str, n_classes: int, plans: Sequence[Plan], settings: Settings, edges: dict, which: list[int]
) -> list[list[dict]] | None:
    """The trees of every plan, each grown by one task on the cells of its rows.

    None where a model's rows do not fold into few cells.
    """
    if n_classes > BINS or not edges:
        return None
    seeds, rounds = sorted({p.seed for p in plans}), settings.rounds

    def draws(ids: np.ndarray) -> np.ndarray:
        out = np.ones((len(ids), len(seeds) * rounds), np.uint8)
        if settings.rows < 1:
            for i, seed in enumerate(seeds):
                for r in range(rounds):
                    out[:, i * rounds + r] = _uniform(ids, (seed << 20) + r + 1) < settings.rows
        return out

    folded = cells.fold(rows, y, key, edges, len(seeds) * rounds, draws, lambda drawn, role: drawn * (role == 1)[:, None])
    if not folded.few:
        return None
    names = ["feature", "bin", "value", "cover"]
    widths = [len(edges[p]) for p in edges]

    def grow(table: pa.Table) -> pa.Table:
        m = table["unit"][0].as_py()
        _, x, cell, label, drawn = cells.sorted_cells(table, len(seeds) * rounds, widths[which[m]])
        at = seeds.index(plans[m].seed) * rounds
        trees = _cell_trees(x, cell, label, drawn[:, at : at + rounds], n_classes, plans[m], settings)
        told = [pa.array([np.stack([t[n] for t in trees]).astype(float).tobytes()], pa.binary()) for n in names]
        return pa.table([pa.array([m], pa.int32()), *told], names=["model", *names])

    units = {p: [m for m, w in enumerate(which) if w == p] for p in range(len(widths))}
    schema = "model int, " + ", ".join(f"{n} binary" for n in names)
    grown: dict[int, list[dict]] = {}
    for row in cells.dealt(folded.table, units).groupBy("unit").applyInArrow(grow, schema).collect():
        told = {n: np.frombuffer(row[n], float).reshape(rounds, n_classes, -1) for n in names}
        whole = {n: v.astype(np.int64) if n in ("feature", "bin") else v for n, v in told.items()}
        grown[row["model"]] = [{n: whole[n][r] for n in names} for r in range(rounds)]
    for m, p in enumerate(plans):
        if m not in grown:  # no training row
            none = np.zeros(0, np.int64)
            grown[m] = _cell_trees(np.zeros((0, widths[which[m]]), np.uint8), none, none, np.zeros((0, rounds)), n_classes, p, settings)
    return [grown[m] for m in range(len(plans))]


def _grown_on_rows(
    spread: DataFrame,
    y: str,
    key: str,
    n_classes: int,
    plans: Sequence[Plan],
    settings: Settings,
    edges: dict,
    widths: list[int],
    which: list[int],
) -> list[list[dict]]:
    """The trees of every plan, grown together: ``rounds`` x the largest depth jobs in all."""
    blocks = stored(_blocks(spread, y, key, plans, edges, n_classes))
    deepest = max(p.max_depth for p in plans)
    inner = (1 << deepest) - 1
    grown: list[list[dict]] = [[] for _ in plans]
    names = ["feature", "bin", "left", "right", "cover_left", "cover_right", "cover"]

    def grow(blocks: DataFrame, trees: list[dict], level: int, round_: int) -> list:
        active = [m for m, p in enumerate(plans) if p.max_depth > level]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    block = _Block(row, plans, widths, which, n_classes)
                    for m in active:
                        at = block.nodes(m, trees[m]["feature"], trees[m]["bin"], level)
                        salt = (plans[m].seed << 20) + round_ + 1
                        hist = block.histogram(m, at, level, settings.rows, salt)
                        total[m] = total[m] + hist if m in total else hist
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([h.tobytes() for h in total.values()], pa.binary())],
                names=["model", "hist"],
            )

        def splits(table: pa.Table) -> pa.Table:
            m = table["model"][0].as_py()
            width = widths[which[m]]
            shape = (n_classes, 1 << level, width, BINS, 2)
            hist = np.zeros(shape)
            for part in table["hist"]:
                hist += np.frombuffer(part.as_py(), float).reshape(shape)
            allowed = _columns(plans[m].seed, round_, n_classes, width, settings.columns)
            found = best_splits(hist, allowed, settings)
            cells = [pa.array([found[n].astype(float).tobytes()], pa.binary()) for n in names]
            return pa.table([pa.array([m], pa.int32()), *cells], names=["model", *names])

        schema = "model int, " + ", ".join(f"{n} binary" for n in names)
        partial = blocks.mapInArrow(sums, "model int, hist binary")
        return partial.groupBy("model").applyInArrow(splits, schema).collect()

    def moved(blocks: DataFrame, trees: list[dict]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    block = _Block(row, plans, widths, which, n_classes)
                    margin = block.margin.copy()
                    for m, tree in enumerate(trees):
                        at = block.nodes(m, tree["feature"], tree["bin"], deepest)
                        margin[m] += tree["value"][np.arange(n_classes)[None, :], at - inner]
                    out.append(margin.tobytes())
                yield batch.set_column(5, "margin", pa.array(out, pa.binary()))

        return blocks.mapInArrow(run, blocks.schema)

    cached = None
    for round_ in range(settings.rounds):
        trees = [
            {
                "feature": np.zeros((n_classes, inner), np.int64),
                "bin": np.full((n_classes, inner), NEVER, np.int64),
                "value": np.zeros((n_classes, inner + 1)),
                "cover": np.zeros((n_classes, 2 * inner + 1)),
            }
            for _ in plans
        ]
        for level in range(deepest):
            for row in grow(blocks, trees, level, round_):
                found = {c: np.frombuffer(row[c], float).reshape(n_classes, -1) for c in names}
                _written(trees[row["model"]], found, level, deepest)
        for m, tree in enumerate(trees):
            grown[m].append(_cut(tree, plans[m].max_depth))
        if round_ + 1 < settings.rounds:
            blocks = moved(blocks, trees)
            if (round_ + 1) % REFRESH == 0:
                blocks = stored(blocks)
                if cached is not None:
                    cached.unpersist()
                cached = None
            else:
                blocks, before, cached = blocks.persist(StorageLevel.MEMORY_AND_DISK), cached, blocks
    if cached is not None:
        cached.unpersist()
    return grown


def _cut(tree: dict, depth: int) -> dict:
    """The tree in a heap of its own depth."""
    inner = (1 << depth) - 1
    span = tree["value"].shape[1] >> depth
    return {
        "feature": tree["feature"][:, :inner],
        "bin": tree["bin"][:, :inner],
        "value": tree["value"][:, ::span],
        "cover": tree["cover"][:, : 2 * inner + 1],
    }


def _ensemble(trees: list[dict], edges: list[np.ndarray]) -> Ensemble:
    feature = np.stack([t["feature"] for t in trees])
    bin_ = np.stack([t["bin"] for t in trees])
    table = np.full((len(edges) or 1, NEVER + 1), np.inf)
    for j, e in enumerate(edges):
        table[j, : len(e)] = e
    return Ensemble(
        feature,
        table[feature, bin_],
        np.stack([t["value"] for t in trees]),
        np.stack([t["cover"] for t in trees]),
    )
