"""Published confusion matrices, and metrics against brute force on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteframe.operators import class_eval as ce
from noteframe.operators.ordered import positions, running_totals

MATRICES = [
    # rows y = 0..3, columns prediction; macro F1, weighted kappa, MAE
    ([[25, 4, 0, 0], [1, 48, 1, 0], [0, 8, 64, 0], [0, 0, 4, 5]], 0.8509763286359031, 0.9149288119572281, 0.1125),
    ([[29, 0, 0, 0], [10, 40, 0, 0], [0, 14, 58, 0], [0, 0, 4, 5]], 0.8005323254445291, 0.8797444569710635, 0.175),
]
RECALLS = {"recall_alta": 2, "recall_urgente": 3}
PROBS = ["p0", "p1", "p2", "p3"]


@pytest.mark.parametrize("matrix, f1, kappa, mae", MATRICES)
def test_published_matrices(spark, matrix, f1, kappa, mae):
    rows = [(i, j) for i in range(4) for j in range(4) for _ in range(matrix[i][j])]
    df = spark.createDataFrame(rows, "y int, q int")
    counts = ce.label_counts(df, "y", "q")
    got = {r["metric"]: r["value"] for r in ce.label_metrics(counts, 4, RECALLS).collect()}
    assert got["f1_macro"] == pytest.approx(f1, abs=1e-12)
    assert got["weighted_kappa"] == pytest.approx(kappa, abs=1e-12)
    assert got["ordinal_mae"] == pytest.approx(mae, abs=1e-12)
    dense = {(r["y"], r["yhat"]): r["n"] for r in ce.dense_confusion(counts, 4).collect()}
    assert dense == {(i, j): matrix[i][j] for i in range(4) for j in range(4)}


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        y = rng.choice([0, 1, 1, 1, 2, 3])
        # A third of the rows share one score vector (a hot group of ties).
        raw = [1, 2, 3, 4] if i % 3 == 0 else [rng.randint(1, 9) + (5 if k == y else 0) for k in range(4)]
        p = [v / sum(raw) for v in raw]
        rows.append((i, y, int(np.argmax(p)), *p))
    return rows, spark.createDataFrame(rows, "id long, y int, q int, p0 double, p1 double, p2 double, p3 double")


def _brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a]
    neg = [b for a, b in zip(y, s) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def _brute_ap(y, s):
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        chosen = [a for a, b in zip(y, s) if b >= t]
        recall = sum(chosen) / sum(y)
        total += (recall - last) * sum(chosen) / len(chosen)
        last = recall
    return total


def test_ranking_against_brute_force(scored):
    rows, df = scored
    for buckets in (2, 7):
        got = {r["class_code"]: r for r in ce.ranking_metrics(ce.score_table(df, "y", PROBS), buckets=buckets).collect()}
        for k in range(4):
            y = [int(r[1] == k) for r in rows]
            s = [r[3 + k] for r in rows]
            assert got[k]["auc"] == pytest.approx(_brute_auc(y, s), abs=1e-12)
            assert got[k]["average_precision"] == pytest.approx(_brute_ap(y, s), abs=1e-12)


def test_undefined_ranking_is_null(spark):
    df = spark.createDataFrame([(0, 0.5, 0.5), (0, 0.4, 0.6)], "y int, p0 double, p1 double")
    ranking = ce.ranking_metrics(ce.score_table(df, "y", ["p0", "p1"]))
    assert [r["auc"] for r in ranking.collect()] == [None, None]
    assert ce.macro_auc(ranking, 2).first()[0] is None


def test_probability_scores_and_curve(scored):
    rows, df = scored
    got = ce.probability_scores(df, "y", PROBS, 2).first()
    brier = np.mean([sum(((r[1] == k) - r[3 + k]) ** 2 for k in range(4)) for r in rows])
    loss = np.mean([-math.log(r[3 + r[1]]) for r in rows])
    high = [(float(r[1] >= 2), r[5] + r[6]) for r in rows]
    assert got["multiclass_brier"] == pytest.approx(brier)
    assert got["multiclass_log_loss"] == pytest.approx(loss)
    assert got["brier_highurgent"] == pytest.approx(np.mean([(a - b) ** 2 for a, b in high]))
    curve = ce.calibration_curve(df, "y", PROBS, 2).collect()
    edges = np.linspace(0, 1, 11)[1:-1]
    bins = np.clip(np.digitize([b for _, b in high], edges, right=True), 0, 9)
    expected = {int(b): int((bins == b).sum()) for b in set(bins)}
    assert {r["bin"]: r["n"] for r in curve if r["target"] == "high_or_urgent"} == expected


def test_calibration_fit_against_newton(scored):
    rows, df = scored
    y = np.array([float(r[1] >= 2) for r in rows])
    p = np.clip([r[5] + r[6] for r in rows], 1e-6, 1 - 1e-6)
    x = np.column_stack([np.ones(len(y)), np.log(p / (1 - p))])
    beta = np.zeros(2)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x.T * (mu * (1 - mu))) @ x, x.T @ (y - mu))
    got = ce.calibration_fit(df, "y", PROBS, 2).first()
    assert got["calibration_intercept"] == pytest.approx(beta[0], abs=2e-3)
    assert got["calibration_slope"] == pytest.approx(beta[1], abs=2e-3)
    one = df.where("y >= 2")
    assert ce.calibration_fit(one, "y", PROBS, 2).first()["calibration_slope"] is None


def test_running_totals_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", (i * 37) % 101 + i / 1000) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = running_totals(df, F.struct("v", "id"), {"t": F.col("v"), "n": F.lit(1).cast("bigint")}, by=["g"], buckets=9)
    for r in got.collect():
        before = [v for _, g, v in rows if g == r["g"] and v <= r["v"]]
        assert r["n"] == len(before)
        assert r["t"] == pytest.approx(sum(before))
    order = [r["id"] for r in positions(df, F.struct("v", "id")).orderBy("position").collect()]
    assert order == [i for i, _, _ in sorted(rows, key=lambda r: (r[2], r[0]))]
    kept = positions(df, F.struct("v", "id"), buckets=3, store=True).orderBy("position")
    assert kept.columns == ["id", "g", "v", "position"] and [r["id"] for r in kept.collect()] == order


def test_stratified_draws_keep_class_sizes(scored):
    rows, df = scored
    drawn = ce.stratified_draws(df, "id", "y", 6, 3).groupBy("repetition", "y").agg(F.sum("w").alias("n")).collect()
    sizes = {k: sum(r[1] == k for r in rows) for k in range(4)}
    assert len(drawn) == 24 and all(r["n"] == sizes[r["y"]] for r in drawn)


def test_stratified_draws_are_draws_with_replacement(spark):
    n, repetitions = 600, 40
    df = spark.range(n).selectExpr("id", "int(id % 2) AS y", "'x' AS w1")
    rows = ce.stratified_draws(df, "id", "y", repetitions, 5, block=32).collect()
    count = {(r["id"], r["repetition"]): r["w"] for r in rows}
    assert len(count) == len(rows)
    cells = [count.get((i, k), 0) for i in range(n) for k in range(repetitions)]
    mean = sum(cells) / len(cells)
    variance = sum((c - mean) ** 2 for c in cells) / len(cells)
    assert mean == 1 and variance == pytest.approx(1, abs=0.06)
    assert sum(c == 0 for c in cells) / len(cells) == pytest.approx(0.3679, abs=0.015)
    for parity in (0, 1):  # blocks take as many draws as chance gives them, not a fixed number
        first = [sum(count.get((i, k), 0) for i in range(parity, 64, 2)) for k in range(repetitions)]
        assert len(set(first)) > 5
    assert ce.stratified_draws(df.limit(0), "id", "y", 3, 5).count() == 0


def test_report_over_replicates_contains_the_point(scored):
    _, df = scored
    report = {r["metric"]: r["value"] for r in ce.classification_report(df, "y", "q", 4, RECALLS, PROBS, {"auprc_alta": 2}).collect()}
    for method in ("poisson", "exact"):
        intervals = ce.bootstrap_intervals(df, "id", "y", "q", 4, RECALLS, 40, 1, PROBS, {"auprc_alta": 2}, method=method)
        for r in intervals.collect():
            assert r["ci_2_5"] - 0.02 <= report[r["metric"]] <= r["ci_97_5"] + 0.02


def test_digests_equal_md5():
    import hashlib

    import pyarrow as pa
    from noteframe.functions.digests import Texts

    texts = ["", "a", "é" * 30, "x" * 44, "x" * 45, "x" * 200]
    firsts = ["7|draw/0/", "", "beginning"]
    which = np.array([0, 1, 2, 0, 0, 2])
    found = Texts(pa.array(texts)).md5(firsts, which)
    assert [bytes(d).hex() for d in found] == [hashlib.md5((firsts[w] + t).encode()).hexdigest() for w, t in zip(which, texts)]


def test_stratified_weights_are_not_joined_with_rows(spark):
    df = spark.range(900).selectExpr("concat('k', id) AS id", "int(id % 3) AS y")
    out = ce.stratified_weights(df, "id", "y", 7, 11, block=100)
    totals = out.selectExpr("y", "posexplode(weights)").groupBy("y", "pos").agg(F.sum("col").alias("n")).collect()
    assert len(totals) == 21 and {r["n"] for r in totals} == {300}
    # rows meet their draws in one group; only the running totals of the numbers are joined
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_equal_rows_fold_before_replicates_unfold(spark):
    df = spark.range(50).selectExpr("int(id % 2) AS y", "0.5D AS p", "array(1, 0, int(id % 2)) AS weights")
    rows = ce.folded_replicates(df, ["y", "p"], 3).orderBy("y", "repetition").collect()
    assert [(r["y"], r["p"], r["repetition"], r["w"]) for r in rows] == [(0, 0.5, 0, 25), (1, 0.5, 0, 25), (1, 0.5, 2, 25)]
