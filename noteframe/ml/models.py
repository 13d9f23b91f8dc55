"""Ordinal classifiers on Spark: preprocessing, three model families, probabilities.

Every fit is a sequence of distributed jobs. Class probabilities come out as columns
``proba_0..proba_{K-1}`` in class order, so evaluation is the same for all models.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as x
from ..functions.scalar import aligned_probabilities, argmax
from ..operators.class_eval import class_weights
from ..sources.tables import work_dir
from . import boosting, ordinal
from . import contributions as paths


def feature_types(df: DataFrame, excluded: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns by data type."""
    features = [f for f in df.schema.fields if f.name not in excluded]
    categorical = [f.name for f in features if isinstance(f.dataType, T.StringType)]
    return [f.name for f in features if f.name not in categorical], categorical


@dataclass(frozen=True)
class Preprocessor:
    """Fitted preprocessing and the names of the features it puts out."""

    model: PipelineModel
    names: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def fit_preprocessor(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], median_error: float = 0.001
) -> Preprocessor:
    """Median + missing indicator + standardisation; mode + one-hot (unknown values give zeros).

    Fitted on the given rows only, so each fold has its own. Modes come from grouped counts
    (ties: the smallest value), so no task holds all values of a column; the encoder itself
    keeps one entry per value, so free text is no category.
    """
    stats = train.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in numeric]).first()
    gaps = [c for c in numeric if stats[f"n_{c}"] > 0]
    modes: dict[str, str] = {}
    if categorical:
        cells = [F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in categorical]
        counts = train.select(F.inline(F.array(*cells))).where("value IS NOT NULL").groupBy("name", "value").count()
        top = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode"))
        modes = {r["name"]: r["mode"] for r in top.collect()}
    parts = ["*"]
    parts += [f"CAST({x.col(c)} AS DOUBLE) AS {x.col('num_' + c)}" for c in numeric]
    parts += [f"CAST({x.col(c)} IS NULL AS DOUBLE) AS {x.col('gap_' + c)}" for c in gaps]
    parts += [
        f"coalesce({x.col(c)}, {x.lit(modes.get(c, ''))}) AS {x.col('cat_' + c)}" for c in categorical
    ]
    stages = [SQLTransformer(statement=f"SELECT {', '.join(parts)} FROM __THIS__")]
    values = [f"num_{c}" for c in numeric] + [f"gap_{c}" for c in gaps]
    blocks = []
    if numeric:
        filled = [f"num_{c}" for c in numeric]
        stages.append(Imputer(strategy="median", inputCols=filled, outputCols=filled, relativeError=median_error))
        stages.append(VectorAssembler(inputCols=values, outputCol="_numeric"))
        stages.append(StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True))
        blocks.append("_scaled")
    if categorical:
        indexed = [f"idx_{c}" for c in categorical]
        coded = [f"hot_{c}" for c in categorical]
        stages.append(
            StringIndexer(
                inputCols=[f"cat_{c}" for c in categorical], outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
            )
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True))
        blocks += coded
    stages.append(VectorAssembler(inputCols=blocks, outputCol="features"))
    model = Pipeline(stages=stages).fit(train)
    names = [f"numeric__{c}" for c in numeric] + [f"numeric__missing_{c}" for c in gaps]
    if categorical:
        indexer = next(s for s in model.stages if s.__class__.__name__ == "StringIndexerModel")
        for c, labels in zip(categorical, indexer.labelsArray):
            names += [f"categorical__{c}_{label}" for label in labels]
    return Preprocessor(model, names)


def with_probabilities(df: DataFrame, probabilities: dict, n_classes: int, floor: float) -> DataFrame:
    """Add ``proba_k`` (floored, normalised) and the first-wins argmax ``predicted_code``."""
    aligned = aligned_probabilities(probabilities, n_classes, floor)
    out = df.withColumns({f"proba_{k}": p for k, p in enumerate(aligned)})
    return out.withColumn("predicted_code", argmax([f"proba_{k}" for k in range(n_classes)]))


def _as_rows(train: DataFrame, y: str) -> DataFrame:
    """Feature arrays, class, a training role, and a key that tells rows apart by content."""
    arrays = train.select(vector_to_array("features").alias("x"), F.col(y).cast("int").alias("y"), F.lit(1).alias("role"))
    return arrays.withColumn("key", F.xxhash64("x", "y"))


@dataclass
class OrdinalLogit:
    """Proportional odds: P(y <= k) = sigmoid(theta_k - x.beta), balanced class weights, L2 on beta.

    Newton steps on the joint likelihood; all candidates and folds of a search share them.
    """

    alpha: float = 1.0
    max_iter: int = 300
    coefficients: list[float] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def fit(self, train: DataFrame, y: str, n_classes: int) -> "OrdinalLogit":
        return self.fit_many(_as_rows(train, y), "y", "key", n_classes, [(self, "x", "role")])[0]

    @staticmethod
    def fit_many(rows: DataFrame, y: str, key: str, n_classes: int, jobs: Sequence[tuple]) -> list["OrdinalLogit"]:
        """Fitted copies of (candidate, feature column, role column), all in the same jobs."""
        plans = [ordinal.Plan(f, r, c.alpha) for c, f, r in jobs]
        found = ordinal.fit_ordinal(rows, y, n_classes, plans, max(c.max_iter for c, *_ in jobs))
        return [
            OrdinalLogit(c.alpha, c.max_iter, beta.tolist(), theta.tolist())
            for (c, *_), (beta, theta) in zip(jobs, found, strict=True)
        ]

    def predict(self, df: DataFrame, n_classes: int) -> DataFrame:
        beta = ", ".join(x.lit(v) for v in self.coefficients)
        scored = df.withColumn("_f", vector_to_array("features")).withColumn(
            "_eta", F.expr(f"aggregate(zip_with(_f, array({beta}), (a, b) -> a * b), 0D, (s, v) -> s + v)")
        )
        below = [f"(1D / (1D + exp(_eta - ({t!r}D))))" for t in self.thresholds]
        parts = {0: F.expr(below[0])}
        for k in range(1, n_classes - 1):
            parts[k] = F.expr(f"{below[k]} - {below[k - 1]}")
        parts[n_classes - 1] = F.expr(f"1D - {below[-1]}")
        return with_probabilities(scored, parts, n_classes, 1e-12).drop("_f", "_eta")

    def with_contributions(self, df: DataFrame, n_classes: int) -> DataFrame:
        """Add ``contributions`` (feature, class): slope times value, the same for every class."""
        beta = ", ".join(x.lit(v) for v in self.coefficients)
        f = vector_to_array("features")
        return df.withColumn("_f", f).withColumn(
            "contributions",
            F.expr(f"transform(zip_with(_f, array({beta}), (a, b) -> a * b), v -> array_repeat(v, {n_classes}))"),
        ).drop("_f", "features")

    def save(self, path: str, spark: SparkSession) -> None:
        row = spark.createDataFrame(
            [(self.alpha, self.max_iter, self.coefficients, self.thresholds)],
            "alpha double, max_iter int, coefficients array<double>, thresholds array<double>",
        )
        row.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str, spark: SparkSession) -> "OrdinalLogit":
        return OrdinalLogit(**spark.read.parquet(path).first().asDict())


@dataclass
class Forest:
    """Random forest with balanced weights."""

    trees: int = 200
    max_depth: int | None = None
    min_leaf: int = 1
    seed: int = 0
    model: RandomForestClassificationModel | None = None

    def fit(self, train: DataFrame, y: str, n_classes: int) -> "Forest":
        weighted = class_weights(train.select("features", y), y)
        # nodes are met by their cached ids: deep trees are not sent with every task
        fit = RandomForestClassifier(
            labelCol=y,
            weightCol="class_weight",
            numTrees=self.trees,
            maxDepth=self.max_depth if self.max_depth is not None else 30,
            minInstancesPerNode=self.min_leaf,
            featureSubsetStrategy="sqrt",
            seed=self.seed,
            cacheNodeIds=True,
            checkpointInterval=10,
        )
        self.model = fit.fit(weighted)
        return self

    def predict(self, df: DataFrame, n_classes: int) -> DataFrame:
        scored = self.model.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y").transform(df)
        shares = vector_to_array("_p")
        width = self.model.numClasses
        parts = {k: F.get(shares, F.lit(k)) for k in range(min(width, n_classes))}
        return with_probabilities(scored, parts, n_classes, 1e-9).drop("_p", "_r", "_y")

    def with_contributions(self, df: DataFrame, n_classes: int) -> DataFrame:
        """Add ``contributions`` (feature, class) to the class probabilities, by the trees' paths."""
        path = f"{work_dir(df.sparkSession)}/forest-{uuid.uuid4().hex}"
        self.save(path, df.sparkSession)
        leaves = paths.forest_leaves(df.sparkSession.read.parquet(f"{path}/data"), n_classes)
        return paths.with_contributions(df.withColumn("features", vector_to_array("features")), "features", leaves, n_classes)

    def save(self, path: str, spark: SparkSession) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str, spark: SparkSession) -> "Forest":
        model = RandomForestClassificationModel.load(path)
        return Forest(trees=model.getNumTrees, model=model)


@dataclass
class Boosted:
    """Boosted trees with one tree per class and round on the joint softmax loss."""

    rounds: int = 150
    max_depth: int = 5
    step: float = 0.05
    rows: float = 0.85
    columns: float = 0.85
    seed: int = 0
    model: boosting.Ensemble | None = None

    def fit(self, train: DataFrame, y: str, n_classes: int) -> "Boosted":
        return self.fit_many(_as_rows(train, y), "y", "key", n_classes, [(self, "x", "role")])[0]

    @staticmethod
    def fit_many(rows: DataFrame, y: str, key: str, n_classes: int, jobs: Sequence[tuple]) -> list["Boosted"]:
        """Fitted copies of (candidate, feature column, role column).

        Candidates that share rounds, step and draws grow in the same jobs, whatever their
        depth, fold and seed.
        """
        groups: dict[boosting.Settings, list[int]] = {}
        for i, (c, *_) in enumerate(jobs):
            groups.setdefault(boosting.Settings(c.rounds, c.step, c.rows, c.columns), []).append(i)
        out: dict[int, Boosted] = {}
        for told, members in groups.items():
            plans = [boosting.Plan(f, r, c.max_depth, c.seed) for c, f, r in (jobs[i] for i in members)]
            for i, model in zip(members, boosting.fit_boosted(rows, y, key, n_classes, plans, told), strict=True):
                out[i] = replace(jobs[i][0], model=model)
        return [out[i] for i in range(len(jobs))]

    def predict(self, df: DataFrame, n_classes: int) -> DataFrame:
        model = self.model

        @F.pandas_udf("array<double>")
        def shares(values: pd.Series) -> pd.Series:
            return pd.Series(list(model.probabilities(np.stack(values.to_numpy())))) if len(values) else pd.Series([])

        scored = df.withColumn("_p", shares(vector_to_array("features")))
        return with_probabilities(scored, {k: F.get("_p", F.lit(k)) for k in range(n_classes)}, n_classes, 1e-9).drop("_p")

    def with_contributions(self, df: DataFrame, n_classes: int) -> DataFrame:
        """Add ``contributions`` (feature, class) to the margins, by the trees' paths."""
        leaves = list(paths.ensemble_leaves(self.model))
        return paths.with_contributions(df.withColumn("features", vector_to_array("features")), "features", leaves, n_classes)

    def save(self, path: str, spark: SparkSession) -> None:
        """One row per round and class with the heap arrays of its tree."""
        m, told = self.model, {k: v for k, v in vars(self).items() if k != "model"}
        rows = [
            (r, k, *[a[r, k].astype(float).tolist() for a in (m.feature, m.threshold, m.value, m.cover)], json.dumps(told))
            for r in range(len(m.feature)) for k in range(m.feature.shape[1])
        ]
        arrays = ", ".join(f"{n} array<double>" for n in ("feature", "threshold", "value", "cover"))
        table = spark.createDataFrame(rows, f"round int, class int, {arrays}, settings string")
        table.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str, spark: SparkSession) -> "Boosted":
        rows = spark.read.parquet(path).orderBy("round", "class").collect()
        classes = max(r["class"] for r in rows) + 1
        cells = [np.array([r[n] for r in rows]).reshape(-1, classes, len(rows[0][n])) for n in ("feature", "threshold", "value", "cover")]
        model = boosting.Ensemble(cells[0].astype(np.int64), *cells[1:])
        return Boosted(**json.loads(rows[0]["settings"]), model=model)


def model_registry(seed: int, trees: int = 200, rounds: int = 150) -> dict[str, list]:
    """Model families with the candidate settings of the inner search."""
    return {
        "ordinal_logit": [OrdinalLogit(alpha=a) for a in (0.5, 1.0)],
        "random_forest": [
            Forest(trees=trees, max_depth=d, min_leaf=m, seed=seed) for d in (None, 12) for m in (1, 5)
        ],
        "boosted_trees": [Boosted(rounds=rounds, max_depth=d, seed=seed) for d in (3, 5)],
    }
