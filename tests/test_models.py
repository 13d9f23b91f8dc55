"""Models on a small separable table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteframe.ml import models as mm
from noteframe.ml import validation as mv

TASK = mv.Task(key="id", y="y", n_classes=3, seed=1, outer_folds=2, inner_folds=2, test_size=0.25)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    signal = rng.normal(size=240)
    noise = rng.normal(size=240)
    y = np.digitize(signal + 0.4 * rng.normal(size=240), [-0.5, 0.6])
    data = [
        (i, int(y[i]), float(signal[i]) if i % 9 else None, float(noise[i]), "a" if i % 2 else "b") for i in range(240)
    ]
    return spark.createDataFrame(data, "id long, y int, signal double, noise double, kind string").cache()


def test_feature_types(rows):
    assert mm.feature_types(rows, ("id", "y")) == (["signal", "noise"], ["kind"])


@pytest.fixture(scope="module")
def ordinal(rows):
    dev, test = mv.split_rows(rows, TASK)
    return mv.final_model(dev, test, [mm.OrdinalLogit(alpha=0.01, max_iter=60)], TASK), dev, test


def test_ordinal_probabilities(ordinal):
    final, _, test = ordinal
    assert final.predictions.count() == test.count()
    worst = final.predictions.agg(F.max(F.abs(F.expr("proba_0 + proba_1 + proba_2 - 1")))).first()[0]
    assert worst < 1e-9
    assert final.fitted.thresholds == sorted(final.fitted.thresholds)
    assert mv.macro_f1(final.predictions, "y", 3) > 0.55


def test_ordinal_is_close_to_the_joint_likelihood(ordinal):
    """Stacked fit against a small gradient fit of the cumulative-link likelihood."""
    final, dev, _ = ordinal
    ready = final.prepared.transform(dev).select("features", "y").collect()
    x = np.array([r["features"].toArray() for r in ready])
    y = np.array([r["y"] for r in ready])
    weight = (len(y) / (3 * np.bincount(y)))[y]
    beta, theta = np.zeros(x.shape[1]), np.array([-0.5, 0.5])
    for _ in range(20000):
        eta = x @ beta
        cdf = np.column_stack([np.zeros(len(y)), 1 / (1 + np.exp(-(theta[None, :] - eta[:, None]))), np.ones(len(y))])
        p = cdf[np.arange(len(y)), y + 1] - cdf[np.arange(len(y)), y]
        pdf = cdf * (1 - cdf)
        up, low = pdf[np.arange(len(y)), y + 1], pdf[np.arange(len(y)), y]
        d_eta = weight * (up - low) / p / weight.sum()
        beta -= 0.5 * ((x * d_eta[:, None]).sum(0) + 0.01 * beta / x.shape[1])
        for k in range(2):
            theta[k] += 0.5 * (weight / p / weight.sum() * ((y == k) * up - (y == k + 1) * low)).sum()
    fitted = np.array(final.fitted.coefficients)
    cosine = fitted @ beta / (np.linalg.norm(fitted) * np.linalg.norm(beta))
    assert cosine > 0.9999
    assert fitted == pytest.approx(beta, abs=1e-4)
    assert final.fitted.thresholds == pytest.approx(theta, abs=1e-4)
    assert np.argmax(np.abs(fitted)) == np.argmax(np.abs(beta))


def test_explanations(spark, ordinal, tmp_path):
    final, _, test = ordinal
    top = mv.ordinal_coefficients(final, spark).first()
    assert top["feature"] == "numeric__signal"
    importance = mv.permutation_importance(final, test, TASK, 2).collect()
    assert importance[0]["feature"] == "numeric__signal"
    long = mv.contributions(final, test, TASK, high_from=1)
    assert mv.mean_contributions(long).first()["feature"] == "numeric__signal"
    local = mv.local_examples(long, "id", 4)
    assert {r["test_row_index"] for r in local.collect()} == {0, 1, 2, 3}
    final.save(str(tmp_path / "m"), spark)
    assert (tmp_path / "m" / "preprocessing").exists()


def test_trees_and_summary(rows):
    registry = {
        "random_forest": [mm.Forest(trees=5, max_depth=4, seed=1)],
        "boosted_trees": [mm.Boosted(rounds=3, max_depth=2, step=0.5, seed=1)],
    }
    summary = mv.model_summary(rows, registry, TASK, "toy").collect()
    assert [r["model"] for r in summary] == ["random_forest", "boosted_trees"]
    assert all(0.4 < r["development_f1_macro"] <= 1 and 0.4 < r["final_test_f1_macro"] <= 1 for r in summary)


def test_first_rows_are_found_before_they_are_explained(spark):
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(20)] + [(None, 0.0)], "id int, v double")
    got = mv.rows_of_first(df, "id", 3).collect()
    # a null key is among the first three and has no rows to show
    assert sorted((r["id"], r["v"]) for r in got) == sorted((i % 7, float(i)) for i in range(20) if i % 7 < 2)


def test_boosted_blocks_lie_on_all_cores(spark):
    from noteframe.ml import boosting

    one = spark.range(3 * boosting.BLOCK + 1, numPartitions=1)
    assert boosting._spread(one, "id").rdd.getNumPartitions() == min(4, spark.sparkContext.defaultParallelism)
    assert boosting._spread(one.limit(5), "id").rdd.getNumPartitions() == 1


def test_deep_forests_are_not_sent_with_every_task(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(60).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") % 2).cast("int").alias("y"))
    fitted = mm.Forest(trees=2, seed=1).fit(df, "y", 2)
    assert fitted.model.getOrDefault("cacheNodeIds") is True


def test_agreement_reads_its_texts_once(spark):
    from noteframe.operators.extraction_eval import agreement_of_columns

    cell = "array(named_struct('marker', 'm', 'present', int(id % 2)))"
    df = spark.range(10).selectExpr(f"{cell} AS a", f"{cell} AS b")
    out = agreement_of_columns(df, "a", "b", ["present"])
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first()["n"] == 10 and out.first()["agreement"] == 1.0


def test_final_report_has_an_interval_for_every_metric(spark, monkeypatch):
    from types import SimpleNamespace

    from noteframe.plans import models as plans

    shares = "transform(array(0, 1, 2, 3), k -> CASE WHEN k = (y + int(id % 5 = 0)) % 4 THEN 0.4 + id % 9 / 60 ELSE 0.2 - id % 9 / 180 END)"
    rows = spark.range(240).selectExpr("id AS doc_id", "id", "int(id div 2 % 4) AS y").selectExpr("*", f"{shares} AS p")
    rows = rows.select("doc_id", "y", F.expr("(y + int(id % 5 = 0)) % 4").alias("predicted_code"), *[F.get("p", F.lit(k)).alias(f"proba_{k}") for k in range(4)])
    asked = []
    measured = plans.bootstrap_intervals
    monkeypatch.setattr(plans, "_final", lambda *_: (SimpleNamespace(predictions=rows), None))
    monkeypatch.setattr(plans, "bootstrap_intervals", lambda *a, **b: asked.append(a[6]) or measured(*a, **b))
    out = {r["metric"]: r for r in plans.final_report(spark, "").collect()}
    assert {"calibration_intercept", "calibration_slope", "f1_macro", "auc_roc_ovr_macro"} <= set(out)
    assert all(r["ci_2_5"] is not None and r["ci_2_5"] <= r["value"] + 0.2 for r in out.values())
    assert asked == [100]  # as the reference's modelling does
