"""Nested validation, isolated test, summaries and explanations."""

from __future__ import annotations

import json
from collections.abc import Sequence
from copy import copy
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as x
from ..functions.hashing import uniform
from ..operators.class_eval import label_counts, label_metrics, per_class
from ..operators.ordered import positions_by_draw
from ..operators.quality import require_class_counts
from ..operators.sampling import stratified_folds, train_test_split, union_all
from ..sources.tables import stored
from .models import Preprocessor, feature_types, fit_preprocessor


@dataclass(frozen=True)
class Task:
    """What is modelled: key, ordinal target with its number of classes, excluded columns."""

    key: str
    y: str
    n_classes: int
    excluded: tuple[str, ...] = ()
    seed: int = 0
    outer_folds: int = 3
    inner_folds: int = 2
    test_size: float = 0.2


def settings(model) -> dict:
    """Plain hyperparameters of a candidate."""
    return {k: v for k, v in vars(model).items() if isinstance(v, (int, float, str, type(None))) and k != "model"}


def macro_f1(predicted: DataFrame, y: str, n_classes: int, yhat: str = "predicted_code") -> float:
    """Macro F1 over the fixed classes (one aggregation, one number back)."""
    classes = per_class(label_counts(predicted, y, yhat), n_classes)
    return float(classes.agg(F.avg("f1")).first()[0] or 0.0)


def fit_and_predict(train: DataFrame, valid: DataFrame, candidate, task: Task):
    """(predictions of valid, preprocessing, fitted model); everything fitted on train only."""
    numeric, categorical = feature_types(train, (task.key, task.y, *task.excluded))
    prepared = fit_preprocessor(train, numeric, categorical)
    # Every fit passes over its rows many times: keep the assembled vectors for that long.
    ready = prepared.transform(train).select("features", task.y).persist(StorageLevel.MEMORY_AND_DISK)
    fitted = copy(candidate).fit(ready, task.y, task.n_classes)
    ready.unpersist()
    return fitted.predict(prepared.transform(valid), task.n_classes), prepared, fitted


def best_candidate(rows: DataFrame, candidates: Sequence, task: Task, seed: int):
    """(candidate, score) with the highest mean macro F1 over the inner folds."""
    if len(candidates) == 1:
        return candidates[0], None
    folded = stratified_folds(rows, task.key, task.y, task.inner_folds, seed, "_inner", "inner")
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    scores = []
    for candidate in candidates:
        parts = []
        for fold in range(task.inner_folds):
            train = folded.where(F.col("_inner") != fold).drop("_inner")
            valid = folded.where(F.col("_inner") == fold).drop("_inner")
            parts.append(macro_f1(fit_and_predict(train, valid, candidate, task)[0], task.y, task.n_classes))
        scores.append(sum(parts) / len(parts))
    folded.unpersist()
    best = max(range(len(candidates)), key=lambda i: scores[i])
    return candidates[best], scores[best]


def _slim(predicted: DataFrame, task: Task, extra: Sequence = ()) -> DataFrame:
    probs = [f"proba_{k}" for k in range(task.n_classes)]
    return predicted.select(*extra, task.key, task.y, "predicted_code", *probs)


def nested_predictions(rows: DataFrame, candidates: Sequence, task: Task) -> tuple[DataFrame, list[dict]]:
    """(stored out-of-fold predictions with ``outer_fold``, chosen settings per fold).

    The driver loops over folds and candidates; every fit and prediction is a Spark job.
    """
    checked = require_class_counts(rows, task.y, max(task.outer_folds, task.inner_folds))
    folded = stratified_folds(checked, task.key, task.y, task.outer_folds, task.seed, "_outer", "outer")
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    parts, chosen = [], []
    for fold in range(task.outer_folds):
        train = folded.where(F.col("_outer") != fold).drop("_outer")
        valid = folded.where(F.col("_outer") == fold).drop("_outer")
        candidate, _ = best_candidate(train, candidates, task, task.seed + fold + 1)
        predicted, _, _ = fit_and_predict(train, valid, candidate, task)
        parts.append(_slim(predicted, task, [F.lit(fold + 1).alias("outer_fold")]))
        chosen.append({"outer_fold": fold + 1, **settings(candidate)})
    predictions = stored(union_all(parts))
    folded.unpersist()
    return predictions, chosen


@dataclass
class FinalModel:
    """Final refit: its predictions on the isolated test rows, and the parts to save."""

    predictions: DataFrame
    prepared: Preprocessor
    fitted: object
    params: dict

    def save(self, path: str, spark) -> None:
        """Pipeline, model and a one-row metadata table."""
        self.prepared.model.write().overwrite().save(f"{path}/preprocessing")
        self.fitted.save(f"{path}/model", spark)
        row = spark.range(1).select(
            F.lit(type(self.fitted).__name__).alias("model"), F.lit(json.dumps(self.params)).alias("params")
        )
        row.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def final_model(dev: DataFrame, test: DataFrame, candidates: Sequence, task: Task) -> FinalModel:
    """Search and refit on all development rows; the test rows are only predicted."""
    candidate, _ = best_candidate(dev, candidates, task, task.seed + 999)
    predicted, prepared, fitted = fit_and_predict(dev, test, candidate, task)
    return FinalModel(predicted, prepared, fitted, settings(candidate))


def split_rows(rows: DataFrame, task: Task) -> tuple[DataFrame, DataFrame]:
    """(development rows, isolated test rows) by a stored split column."""
    marked = train_test_split(rows, task.key, task.y, task.test_size, task.seed, "_test")
    return marked.where("_test = 0").drop("_test"), marked.where("_test = 1").drop("_test")


def model_summary(rows: DataFrame, registry: dict[str, list], task: Task, dataset: str) -> DataFrame:
    """(dataset, model, development_f1_macro, final_test_f1_macro, final_best_params), one row per model."""
    dev, test = split_rows(rows, task)
    dev, test = dev.persist(StorageLevel.MEMORY_AND_DISK), test.persist(StorageLevel.MEMORY_AND_DISK)
    out = []
    for name, candidates in registry.items():
        outer, _ = nested_predictions(dev, candidates, task)
        final = final_model(dev, test, candidates, task)
        out.append(
            (
                dataset,
                name,
                macro_f1(outer, task.y, task.n_classes),
                macro_f1(final.predictions, task.y, task.n_classes),
                json.dumps(final.params, sort_keys=True),
            )
        )
    dev.unpersist()
    test.unpersist()
    schema = "dataset string, model string, development_f1_macro double, final_test_f1_macro double, final_best_params string"
    return rows.sparkSession.createDataFrame(out, schema)


def baseline_row(dev: DataFrame, test: DataFrame, y: str, yhat: str, n_classes: int, dataset: str) -> DataFrame:
    """Summary row of a rule baseline that needs no training."""
    return dev.sparkSession.createDataFrame(
        [(dataset, "rule_baseline", macro_f1(dev, y, n_classes, yhat), macro_f1(test, y, n_classes, yhat), "{}")],
        "dataset string, model string, development_f1_macro double, final_test_f1_macro double, final_best_params string",
    )


def ordinal_coefficients(final: FinalModel, spark) -> DataFrame:
    """(feature, coefficient, abs_coefficient), largest first."""
    rows = [(n, c, abs(c)) for n, c in zip(final.prepared.names, final.fitted.coefficients)]
    df = spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double")
    return df.orderBy(F.desc("abs_coefficient"), "feature")


def _permuted(final: FinalModel, test: DataFrame, task: Task, seed: int) -> DataFrame:
    """Each test row once per feature, with that feature taken from a randomly paired row.

    Rows are numbered in two independent hash orders; equal numbers make the pairs, so the
    permutation is one equi-join. All features share it and are scored in one job.
    """
    ready = final.prepared.transform(test).select(
        task.key, task.y, vector_to_array("features").alias("f"), uniform(seed, task.key, "a").alias("ua"), uniform(seed, task.key, "b").alias("ub")
    )
    left = positions_by_draw(ready, "ua", task.key, "no").select("no", task.key, task.y, "f")
    right = positions_by_draw(ready, "ub", task.key, "no").select("no", F.col("f").alias("g"))
    names = ", ".join(x.lit(n) for n in final.prepared.names)
    long = left.join(right, "no").select(
        task.key, task.y, "f", "g", F.posexplode(F.expr(f"array({names})")).alias("j", "feature")
    )
    return long.select(
        task.key,
        task.y,
        "feature",
        array_to_vector(F.expr("transform(f, (v, i) -> CASE WHEN i = j THEN get(g, i) ELSE v END)")).alias("features"),
    )


def permutation_importance(final: FinalModel, test: DataFrame, task: Task, seed: int) -> DataFrame:
    """(feature, importance): macro-F1 drop when the feature is permuted over the test rows."""
    base = macro_f1(final.predictions, task.y, task.n_classes)
    scored = final.fitted.predict(_permuted(final, test, task, seed), task.n_classes)
    counts = label_counts(scored, task.y, "predicted_code", ["feature"])
    scores = label_metrics(counts, task.n_classes, {}, ["feature"]).where("metric = 'f1_macro'")
    return scores.select("feature", (F.lit(base) - F.col("value")).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


def feature_contributions(
    ready: DataFrame, fitted, names: Sequence[str], task: Task, high_from: int = 2
) -> DataFrame:
    """(key, feature, contribution): what each feature adds to the upper classes, signs left out.

    ``ready`` is (key, features). Contributions of a row sum to its margins less the expected
    ones, class by class; here those to the classes from ``high_from`` on are added up. Rows
    unfold after the model.
    """
    told = fitted.with_contributions(ready, task.n_classes)
    labels = ", ".join(x.lit(n) for n in names)
    upper = f"aggregate(slice(c, {high_from + 1}, {task.n_classes - high_from}), 0D, (a, v) -> a + abs(v))"
    cells = f"zip_with(array({labels}), contributions, (n, c) -> named_struct('feature', n, 'contribution', {upper}))"
    return told.select(task.key, F.expr(f"inline({cells})"))


def contributions(final: FinalModel, test: DataFrame, task: Task, high_from: int = 2) -> DataFrame:
    """``feature_contributions`` of a final model on the test rows."""
    ready = final.prepared.transform(test).select(task.key, "features")
    return feature_contributions(ready, final.fitted, final.prepared.names, task, high_from)


def mean_contributions(long: DataFrame) -> DataFrame:
    """(feature, mean_abs_contribution), largest first."""
    out = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    return out.orderBy(F.desc("mean_abs_contribution"), "feature")


def rows_of_first(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The rows of the first n keys: what ``local_examples`` shows, found before it is explained."""
    return df.join(F.broadcast(df.select(key).distinct().orderBy(key).limit(n)), key, "left_semi")


def local_examples(long: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Contributions of the first n test keys, with a row index 0..n-1.

    Where contributions cost time, ``rows_of_first`` picks the rows to explain.
    """
    first = long.select(key).distinct().orderBy(key).limit(n)
    listed = first.agg(F.sort_array(F.collect_list(key)).alias("keys")).scalar()
    indexed = first.withColumn("test_row_index", (F.array_position(listed, F.col(key)) - 1).cast("int"))
    return long.join(F.broadcast(indexed), key).select("test_row_index", "feature", "contribution")
