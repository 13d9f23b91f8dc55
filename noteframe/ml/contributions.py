"""Additive contributions of features to the margins of tree ensembles.

A leaf is kept as the box of feature values that leads to it, with the share of training
weight that each feature's splits pass on. Its part in a prediction when only some features
are known is the value times 1 or 0 for each known feature and times the share for the others.
The average over all orders of features is an integral over [0, 1] of a product with one factor
per feature of the leaf, a polynomial, so a few Gauss points give it exactly: time grows
with the square of a leaf's features, not with the number of their subsets.

Rows are worked on in Arrow batches; a row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Ensemble


@dataclass
class Leaf:
    """Value per class of a leaf, and per feature on its path (low, high, share): low < x <= high."""

    value: np.ndarray
    path: dict[int, tuple[float, float, float]]


def _below(path: dict, feature: int, low: float, high: float, share: float) -> dict:
    a, b, s = path.get(feature, (-np.inf, np.inf, 1.0))
    return path | {feature: (max(a, low), min(b, high), s * share)}


def ensemble_leaves(model: Ensemble) -> Iterator[Leaf]:
    """Leaves of boosted trees; each counts for the class of its tree."""
    rounds, classes, nodes = model.feature.shape
    for r in range(rounds):
        for k in range(classes):
            feature, cut = model.feature[r, k], model.threshold[r, k]
            value, cover = model.value[r, k], model.cover[r, k]
            waiting = [(0, {})]
            while waiting:
                at, path = waiting.pop()
                if at >= nodes:
                    out = np.zeros(classes)
                    out[k] = value[at - nodes]
                    yield Leaf(out, path)
                    continue
                if not np.isfinite(cut[at]):  # all rows go left
                    waiting.append((2 * at + 1, path))
                    continue
                whole = max(cover[at], 1e-300)
                j, t = int(feature[at]), float(cut[at])
                waiting.append((2 * at + 1, _below(path, j, -np.inf, t, cover[2 * at + 1] / whole)))
                waiting.append((2 * at + 2, _below(path, j, t, np.inf, cover[2 * at + 2] / whole)))


def forest_leaves(nodes: DataFrame, n_classes: int) -> list[Leaf]:
    """Leaves of a saved forest, from its node table (``<path>/data`` of a saved MLlib model).

    Values are class shares over the number of trees, so contributions add up to the forest's
    class probabilities. A forest is as large as its settings allow, not as its rows.
    """
    trees: dict[int, dict] = {}
    for row in nodes.select("treeID", "nodeData.*").collect():
        trees.setdefault(row["treeID"], {})[row["id"]] = row
    out = []
    for tree in trees.values():
        waiting = [(tree[0], {})]
        while waiting:
            node, path = waiting.pop()
            stats = np.array(node["impurityStats"])
            if node["leftChild"] < 0:
                value = np.zeros(n_classes)
                value[: len(stats)] = stats[:n_classes] / max(stats.sum(), 1e-300) / len(trees)
                out.append(Leaf(value, path))
                continue
            j, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            whole = max(stats.sum(), 1e-300)
            for child, low, high in ((node["leftChild"], -np.inf, cut), (node["rightChild"], cut, np.inf)):
                share = sum(tree[child]["impurityStats"]) / whole
                waiting.append((tree[child], _below(path, j, low, high, share)))
    return out


def expected(leaves: Sequence[Leaf]) -> np.ndarray:
    """Margin per class when no feature is known."""
    return sum((leaf.value * np.prod([s for *_, s in leaf.path.values()]) for leaf in leaves), 0.0)


def contributions(leaves: Sequence[Leaf], x: np.ndarray, n_classes: int) -> np.ndarray:
    """(row, feature, class); the sum over features and ``expected`` is the margin."""
    out = np.zeros((*x.shape, n_classes))
    points: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    seen: dict[tuple, np.ndarray] = {}
    for leaf in leaves:
        d = len(leaf.path)
        if not d:
            continue
        if d not in points:
            t, w = np.polynomial.legendre.leggauss((d + 1) // 2 + 1)
            points[d] = ((t + 1) / 2, w / 2)
        t, w = points[d]
        features = list(leaf.path)
        ones, factors = [], []
        for j in features:
            low, high, share = leaf.path[j]
            if (j, low, high) not in seen:
                seen[j, low, high] = ((x[:, j] > low) & (x[:, j] <= high)).astype(float)
            one = seen[j, low, high]
            ones.append(one - share)
            factors.append(share * (1 - t)[None, :] + one[:, None] * t[None, :])
        before = [np.ones((len(x), len(t)))]
        for f in factors[:-1]:
            before.append(before[-1] * f)
        after = np.broadcast_to(w[None, :], before[0].shape)
        for i in range(d - 1, -1, -1):
            weight = ones[i] * (before[i] * after).sum(1)
            out[:, features[i], :] += weight[:, None] * leaf.value[None, :]
            after = after * factors[i]
        if len(seen) > 4096:
            seen.clear()
    return out


def with_contributions(
    df: DataFrame, features: str, leaves: Sequence[Leaf], n_classes: int, out: str = "contributions"
) -> DataFrame:
    """Add per row an array (feature) of arrays (class) of contributions; rows stay single."""
    spread = df.sparkSession.sparkContext.broadcast(list(leaves))
    kind = "array<array<double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_x"))
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            values = contributions(spread.value, x, n_classes)
            inner = pa.ListArray.from_arrays(
                pa.array(np.arange(0, values.size + 1, n_classes), pa.int32()), pa.array(values.ravel())
            )
            per = pa.array(np.arange(batch.num_rows + 1) * x.shape[1], pa.int32())
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "_x"]
            names = [n for n in batch.schema.names if n != "_x"]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(per, inner)], names=[*names, out])

    kept = df.drop(features)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return df.withColumn("_x", F.col(features)).drop(features).mapInArrow(run, f"{schema}, `{out}` {kind}")
