"""Nested search over one stored table whose folds are columns.

Every training set of the search (outer folds, their inner folds, all development rows and
their inner folds) is a role column of one table: 1 for its training rows, 2 for the rows it is
judged on, 0 for others. Preprocessing is fitted for all of them in three aggregations, each
on its own training rows. Candidates with a joint fit (ordinal, boosted trees) run as one
sequence of jobs for all sets. Forests are grown and judged on the cells of the sets (``forests``),
a job for the search and one for the refits; where a set does not fold into few cells they run
as concurrent jobs, each in a scheduler pool of its own, which share the cluster evenly where
``spark.scheduler.mode`` is FAIR.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as x
from ..operators.class_eval import label_counts, per_class
from ..operators.quality import require_class_counts
from ..operators.sampling import stratified_folds, train_test_split, union_all
from ..sources.tables import stored
from . import forests
from .models import Forest, feature_types, with_probabilities
from .validation import Task, baseline_row, macro_f1, settings

FINAL = "final"


def concurrently(tasks: Sequence[Callable], spark, workers: int | None = None) -> list:
    """Results of Spark jobs that run at the same time, in order."""

    def pooled(i: int, task: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"search-{i}")
        return task()

    with ThreadPoolExecutor(workers or min(8, os.cpu_count() or 1)) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(pooled), i, t) for i, t in enumerate(tasks)]
        return [f.result() for f in futures]


def with_roles(rows: DataFrame, task: Task) -> tuple[DataFrame, dict[str, list[str]]]:
    """(rows with a role column per training set, names of the inner sets per outer set).

    Sets are ``outer1``.. and ``final``; inner ones add ``_inner1``... Test rows are judged by
    ``final`` alone. Folds keep the class shares of the set they are cut from. Every cut reads
    its rows twice, so they are stored between cuts: a plan of all would read them 64 times.
    """
    out = stored(train_test_split(rows, task.key, task.y, task.test_size, task.seed, "_test"))
    y = F.col(task.y).cast("int")

    def folded(df: DataFrame, inside: Column, folds: int, seed: int, name: str, salt: str) -> DataFrame:
        """Fold numbers inside a set of rows; rows outside are dealt as classes of their own."""
        class_ = y + F.when(inside, 0).otherwise(task.n_classes)
        return stored(stratified_folds(df.withColumn("_class", class_), task.key, "_class", folds, seed, name, salt).drop("_class"))

    dev = F.col("_test") == 0
    out = folded(out, dev, task.outer_folds, task.seed, "_outer", "outer")
    roles: dict[str, Column] = {}
    sets: dict[str, list[str]] = {}
    for fold in range(task.outer_folds + 1):
        last = fold == task.outer_folds
        name = FINAL if last else f"outer{fold + 1}"
        train = dev if last else dev & (F.col("_outer") != fold)
        judged = ~dev if last else dev & (F.col("_outer") == fold)
        seed = task.seed + (999 if last else fold + 1)
        out = folded(out, train, task.inner_folds, seed, f"_{name}", "inner")
        roles[name] = F.when(train, 1).when(judged, 2).otherwise(0)
        sets[name] = []
        for part in range(task.inner_folds):
            held = F.col(f"_{name}") == part
            inner = f"{name}_inner{part + 1}"
            roles[inner] = F.when(train & ~held, 1).when(train & held, 2).otherwise(0)
            sets[name].append(inner)
    marked = out.withColumns({f"role_{n}": c.cast("tinyint") for n, c in roles.items()})
    return marked.drop("_test", "_outer", *[f"_{n}" for n in sets]), sets


def designed(rows: DataFrame, names: Sequence[str], numeric: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """(rows with a feature array ``x_<set>`` per training set, feature names per set).

    Medians, missing indicators, standardisation, modes and one-hot columns are those of the
    set's training rows; unknown values give zeros. Three aggregations serve all sets.
    """
    trains = {n: F.col(f"role_{n}") == 1 for n in names}
    middles = rows.agg(
        *[F.percentile_approx(F.when(t, F.col(c).cast("double")), 0.5, 1000).alias(f"{n}|{c}") for n, t in trains.items() for c in numeric],
        *[F.count_if(t & F.col(c).isNull()).alias(f"{n}|{c}|gap") for n, t in trains.items() for c in numeric],
        F.lit(0).alias("_"),
    ).first().asDict()
    levels: dict[str, dict[str, dict[str, int]]] = {n: {c: {} for c in categorical} for n in names}
    if categorical:
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in categorical])
        long = rows.select(F.inline(cells), *[f"role_{n}" for n in names]).where("value IS NOT NULL")
        for row in long.groupBy("name", "value").agg(*[F.count_if(t).alias(n) for n, t in trains.items()]).collect():
            for n in names:
                if row[n]:
                    levels[n][row["name"]][row["value"]] = row[n]

    def filled(n: str, c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(float(middles[f"{n}|{c}"] or 0.0)))

    def gaps(n: str) -> list[str]:
        return [c for c in numeric if middles[f"{n}|{c}|gap"]]

    values = {
        (n, label): column
        for n in names
        for label, column in [
            *[(c, filled(n, c)) for c in numeric],
            *[(f"missing_{c}", F.col(c).isNull().cast("double")) for c in gaps(n)],
        ]
    }
    spread = rows.agg(
        *[f(F.when(trains[n], v)).alias(f"{n}|{label}|{f.__name__}") for (n, label), v in values.items() for f in (F.avg, F.stddev)],
        F.lit(0).alias("_"),
    ).first().asDict()
    columns, labels = {}, {}
    for n in names:
        parts, told = [], []
        for (of, label), value in values.items():
            if of == n:
                width = spread[f"{n}|{label}|stddev"] or 0.0
                mean = F.lit(float(spread[f"{n}|{label}|avg"] or 0.0))
                parts.append((value - mean) / F.lit(float(width)) if width > 0 else F.lit(0.0))
                told.append(f"numeric__{label}")
        for c in categorical:
            found = levels[n][c]
            mode = min(found, key=lambda v: (-found[v], v)) if found else None
            for v in sorted(found):
                parts.append((F.coalesce(F.col(c), F.lit(mode)) == v).cast("double"))
                told.append(f"categorical__{c}_{v}")
        columns[f"x_{n}"] = F.array(*parts).cast("array<double>")
        labels[n] = told
    return rows.withColumns(columns), labels


@dataclass
class Found:
    """What a search gives per family: chosen settings, fitted models and stored predictions.

    A forest that was grown on cells leaves no fitted model; ``fit`` of the settings gives one.
    """

    summary: DataFrame
    outer: dict[str, DataFrame] = field(default_factory=dict)
    final: dict[str, DataFrame] = field(default_factory=dict)
    chosen: dict[str, list[dict]] = field(default_factory=dict)
    models: dict[str, object] = field(default_factory=dict)


def _judged(table: DataFrame, name: str, model, task: Task) -> DataFrame:
    rows = table.where(F.col(f"role_{name}") == 2)
    ready = rows.select(task.key, task.y, array_to_vector(f"x_{name}").alias("features"))
    probs = [f"proba_{k}" for k in range(task.n_classes)]
    return model.predict(ready, task.n_classes).select(task.key, task.y, "predicted_code", *probs)


@dataclass
class _Forests:
    """Forests of a search on the cells of its sets."""

    table: DataFrame
    task: Task
    sets: forests.Sets

    def _judged(self, jobs: Sequence[tuple]) -> tuple[list[forests.Plan], DataFrame]:
        plans = [forests.Plan(f"x_{n}", f"role_{n}", c.trees, c.max_depth, c.min_leaf, c.seed) for c, n in jobs]
        shares = {k: F.get("p", F.lit(k)) for k in range(self.task.n_classes)}
        return plans, with_probabilities(self.sets.judged(plans), shares, self.task.n_classes, 1e-9)

    def scores(self, jobs: Sequence[tuple]) -> list[float]:
        """Macro F1 of (candidate, set) pairs."""
        if not jobs:
            return []
        plans, cells = self._judged(jobs)
        long = cells.select("plan", "predicted_code", F.posexplode("n").alias("y", "n")).where("n > 0")
        classes = per_class(label_counts(long, "y", "predicted_code", ["plan"], "n"), self.task.n_classes, ["plan"])
        found = {r["plan"]: float(r["f1"] or 0.0) for r in classes.groupBy("plan").agg(F.avg("f1").alias("f1")).collect()}
        return [found.get(i, 0.0) for i in range(len(plans))]

    def predictions(self, jobs: Sequence[tuple]) -> list[DataFrame]:
        """Predicted rows of the set of each (candidate, set)."""
        plans, cells = self._judged(jobs)
        told = ["predicted_code", *[f"proba_{k}" for k in range(self.task.n_classes)]]
        columns = [self.task.key, self.task.y]
        return [
            self.sets.named(self.table, columns, p).join(cells.where(F.col("plan") == i).select("cell", *told), "cell").select(*columns, *told)
            for i, p in enumerate(plans)
        ]


def _forests(table: DataFrame, names: Sequence[str], candidates: Sequence, task: Task) -> _Forests | None:
    if not all(type(c) is Forest for c in candidates):
        return None
    sets = forests.folded_sets(table, task.y, task.key, task.n_classes, [(f"x_{n}", f"role_{n}") for n in names])
    return sets and _Forests(table, task, sets)


def _fit(table: DataFrame, jobs: list[tuple], task: Task) -> list:
    """Fitted models of (candidate, set) pairs."""
    kind = type(jobs[0][0])
    if hasattr(kind, "fit_many"):
        asked = [(c, f"x_{n}", f"role_{n}") for c, n in jobs]
        return kind.fit_many(table, task.y, task.key, task.n_classes, asked)

    def one(candidate, name: str):
        rows = table.where(F.col(f"role_{name}") == 1)
        ready = rows.select(array_to_vector(f"x_{name}").alias("features"), task.y).persist()
        fitted = copy(candidate).fit(ready, task.y, task.n_classes)
        ready.unpersist()
        return fitted

    return concurrently([lambda c=c, n=n: one(c, n) for c, n in jobs], table.sparkSession)


def nested_search(rows: DataFrame, registry: dict[str, list], task: Task, dataset: str, rule: str | None = None) -> Found:
    """Nested search of every family, refits on all development rows, and the isolated test.

    ``rule`` names a column of codes that is judged beside the models. Candidates of a family
    are compared by macro F1, averaged over the inner folds; ties go to the first.
    """
    spark = rows.sparkSession
    numeric, categorical = feature_types(rows, (task.key, task.y, *task.excluded, *([rule] if rule else [])))
    checked = require_class_counts(rows, task.y, max(task.outer_folds, task.inner_folds))
    marked, sets = with_roles(checked, task)
    marked = stored(marked)
    names = [*sets, *[n for inner in sets.values() for n in inner]]
    table, _ = designed(marked, names, numeric, categorical)
    table = stored(table)
    found = Found(summary=None)
    summary = []
    for family, candidates in registry.items():
        joint = hasattr(type(candidates[0]), "fit_many")
        inner = [(c, n) for parts in sets.values() for n in parts for c in candidates]
        whole = [(c, n) for n in sets for c in candidates] if joint else []
        search = inner if len(candidates) > 1 else []
        grown = _forests(table, names if search else list(sets), candidates, task)
        models = {}
        if grown is not None:
            scores = grown.scores(search)
        else:
            if search + whole:
                models = dict(zip([(id(c), n) for c, n in search + whole], _fit(table, search + whole, task), strict=True))
            scores = concurrently(
                [lambda c=c, n=n: macro_f1(_judged(table, n, models[id(c), n], task), task.y, task.n_classes) for c, n in search], spark
            )
        score = dict(zip([(id(c), n) for c, n in search], scores, strict=True))
        best = {n: max(candidates, key=lambda c: sum(score.get((id(c), i), 0.0) for i in parts)) for n, parts in sets.items()}
        refits = [(best[n], n) for n in sets]
        if grown is not None:
            judged = dict(zip(sets, grown.predictions(refits), strict=True))
        else:
            if not joint:
                models |= dict(zip([(id(c), n) for c, n in refits], _fit(table, refits, task), strict=True))
            judged = {n: _judged(table, n, models[id(c), n], task) for c, n in refits}
        outer = union_all([judged[n].withColumn("outer_fold", F.lit(i + 1)) for i, n in enumerate(sets) if n != FINAL])
        found.outer[family], found.final[family] = concurrently([lambda d=d: stored(d) for d in (outer, judged[FINAL])], spark)
        found.chosen[family] = [{"set": n, **settings(c)} for c, n in refits]
        if grown is None:
            found.models[family] = models[id(best[FINAL]), FINAL]
        f1 = [macro_f1(d, task.y, task.n_classes) for d in (found.outer[family], found.final[family])]
        summary.append((dataset, family, *f1, json.dumps(settings(best[FINAL]), sort_keys=True)))
    schema = "dataset string, model string, development_f1_macro double, final_test_f1_macro double, final_best_params string"
    found.summary = spark.createDataFrame(summary, schema)
    if rule:
        dev, test = (marked.where(F.col(f"role_{FINAL}") == r) for r in (1, 2))
        found.summary = found.summary.unionByName(baseline_row(dev, test, task.y, rule, task.n_classes, dataset))
    return found
