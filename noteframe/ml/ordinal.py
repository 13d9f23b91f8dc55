"""Proportional odds on the joint likelihood, for all models of a search at once.

P(y <= k) = sigmoid(theta_k - x.beta). Newton steps on slopes and thresholds: a step is one
aggregation that sums the loss, the gradient and the Hessian of every model over its training
rows (role column 1). A step that raises a model's loss or crosses its thresholds is halved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: How far beyond the others the threshold of a class at the ends lies that does not occur.
FAR = 40.0


@dataclass(frozen=True)
class Plan:
    """One model of a joint fit: feature array column, role column and penalty."""

    features: str
    role: str
    alpha: float = 1.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def likelihood(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray, theta: np.ndarray):
    """Weighted (loss, gradient, Hessian) in (beta, theta) of the negative log-likelihood."""
    n, steps = len(y), len(theta)
    eta = x @ beta
    cut = _sigmoid(theta[None, :] - eta[:, None])
    cdf = np.column_stack([np.zeros(n), cut, np.ones(n)])
    rows = np.arange(n)
    up, low = cdf[rows, y + 1], cdf[rows, y]
    p = np.maximum(up - low, 1e-12)
    d_up, d_low = up * (1 - up), low * (1 - low)
    # The end thresholds are fixed at infinity; their derivatives are zero.
    at = np.zeros((n, steps + 2))
    at[rows, y + 1] = d_up / p
    at[rows, y] -= d_low / p
    d_eta = 1 - up - low
    grad = np.concatenate([x.T @ (weight * d_eta), -(weight[:, None] * at[:, 1:-1]).sum(0)])
    curve = weight * (d_up + d_low)
    hess = np.zeros((len(beta) + steps,) * 2)
    f = len(beta)
    hess[:f, :f] = x.T @ (x * curve[:, None])
    cross = np.zeros((n, steps + 2))
    cross[rows, y + 1] = d_up
    cross[rows, y] += d_low
    hess[:f, f:] = -(x.T @ (weight[:, None] * cross[:, 1:-1]))
    hess[f:, :f] = hess[:f, f:].T
    own = np.zeros((n, steps + 2))
    own[rows, y + 1] = (d_up / p) ** 2 - d_up * (1 - 2 * up) / p
    own[rows, y] += (d_low / p) ** 2 + d_low * (1 - 2 * low) / p
    hess[f:, f:] += np.diag((weight[:, None] * own[:, 1:-1]).sum(0))
    between = -weight * d_up * d_low / p**2
    for k in range(steps - 1):
        both = between[y == k + 1].sum()
        hess[f + k, f + k + 1] += both
        hess[f + k + 1, f + k] += both
    return float(-(weight * np.log(p)).sum()), grad, hess


def fit_ordinal(
    rows: DataFrame, y: str, n_classes: int, plans: Sequence[Plan], max_iter: int = 300, tolerance: float = 1e-9
) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slopes, thresholds) per plan; balanced class weights, mean loss plus alpha |beta|^2 / 2F.

    Thresholds grow by construction. A class without a training row has no likelihood of its own:
    the model is fitted to the classes that occur, and the thresholds around it are the same (at
    the ends, far out). Models that have converged take no further part; the loop ends with the
    last of them or after ``max_iter`` steps.
    """
    pairs = list(dict.fromkeys((p.features, p.role) for p in plans))
    sizes = rows.select(
        *[F.max(F.size(f)).alias(f) for f in {f for f, _ in pairs}],
        *[F.count_if((F.col(r) == 1) & (F.col(y) == k)).alias(f"{r}_{k}") for _, r in pairs for k in range(n_classes)],
    ).first()
    weights, models, occurs = {}, [], {}
    for f, r in pairs:
        counts = np.array([sizes[f"{r}_{k}"] for k in range(n_classes)], float)
        weights[f, r] = counts.sum() / (max(1, (counts > 0).sum()) * np.maximum(counts, 1))
        occurs[f, r] = counts > 0 if counts.any() else np.ones(n_classes, bool)
    for p in plans:
        width, some = sizes[p.features] or 0, occurs[p.features, p.role]
        share = np.arange(1, some.sum()) / some.sum()
        start = np.concatenate([np.zeros(width), np.log(share / (1 - share))])
        models.append({"at": start, "try": start, "loss": np.inf, "step": None, "done": False, "width": width, "steps": len(share)})
    names = list(dict.fromkeys([*[f for f, _ in pairs], *[r for _, r in pairs]]))
    slim = rows.select(F.col(y).cast("int").alias("_y"), *names)

    def sums(asked: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                columns = {c: batch.column(c) for c in names}
                for m, params in asked.items():
                    p = plans[m]
                    use = columns[p.role].to_numpy(zero_copy_only=False) == 1
                    x = columns[p.features].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[use]
                    seen, width = label[use], models[m]["width"]
                    w = weights[p.features, p.role][seen]
                    seen = (np.cumsum(occurs[p.features, p.role]) - 1)[seen]
                    loss, grad, hess = likelihood(x, seen, w, params[:width], params[width:])
                    part = np.concatenate([[loss, w.sum()], grad, hess.ravel()])
                    total[m] = total[m] + part if m in total else part
            for m, part in total.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m], pa.int32()), pa.array([part], pa.list_(pa.float64()))], names=["model", "part"]
                )

        long = slim.mapInArrow(run, "model int, part array<double>")
        cells = long.select("model", F.posexplode("part").alias("i", "v")).groupBy("model", "i").agg(F.sum("v").alias("v"))
        whole = cells.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"))
        out = {}
        for row in whole.select("model", "s.v").collect():
            part, size = np.array(row["v"]), models[row["model"]]["width"] + models[row["model"]]["steps"]
            scale = max(part[1], 1e-12)
            out[row["model"]] = (part[0] / scale, part[2 : 2 + size] / scale, part[2 + size :].reshape(size, size) / scale)
        return out

    for _ in range(max_iter):
        asked = {m: s["try"] for m, s in enumerate(models) if not s["done"]}
        if not asked:
            break
        told = sums(asked)
        for m in asked:
            s, width = models[m], models[m]["width"]
            if m not in told:  # no training row
                s["done"] = True
                continue
            loss, grad, hess = told[m]
            ridge = plans[m].alpha / max(width, 1)
            beta = s["try"][:width]
            loss += 0.5 * ridge * float(beta @ beta)
            if s["step"] is not None and loss > s["loss"] + 1e-14:
                s["step"] = s["step"] / 2
                s["done"] = float(np.abs(s["step"]).max()) < tolerance
            else:
                s["at"], s["loss"] = s["try"], loss
                grad[:width] += ridge * beta
                hess[:width, :width] += ridge * np.eye(width)
                step = np.linalg.solve(hess + 1e-9 * np.eye(len(grad)), -grad)
                s["step"] = step
                s["done"] = float(np.abs(step).max()) < tolerance
            while s["steps"] > 1 and np.diff((s["at"] + s["step"])[width:]).min() <= 0:
                s["step"] = s["step"] / 2
            s["try"] = s["at"] + s["step"]
    return [
        (s["at"][: s["width"]], _all_thresholds(s["at"][s["width"] :], occurs[p.features, p.role])) for p, s in zip(plans, models, strict=True)
    ]


def _all_thresholds(theta: np.ndarray, occurs: np.ndarray) -> np.ndarray:
    """Thresholds of all classes from those of the classes that occur."""
    if occurs.all():
        return theta
    low, high = (theta[0], theta[-1]) if len(theta) else (0.0, 0.0)
    ends = np.concatenate([[low - FAR], theta, [high + FAR]])
    return ends[np.cumsum(occurs)[:-1]]


def probabilities(x: np.ndarray, beta: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Class probabilities (row, class)."""
    cut = _sigmoid(theta[None, :] - (x @ beta)[:, None])
    cdf = np.column_stack([np.zeros(len(x)), cut, np.ones(len(x))])
    return np.diff(cdf, axis=1)
