"""Model queries over labelled documents; iterative fits have no SQL form (rows-only check)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..ml import models as mm
from ..ml import search as ms
from ..ml import validation as mv
from ..operators.class_eval import bootstrap_intervals, classification_report, label_counts, label_metrics
from ..operators.ranking import best_per_group
from ..sources.tables import stored
from . import sql
from .common import rounded, table

QUERIES: dict = {}
ORACLES: dict = {}
TASK = mv.Task(key="doc_id", y="y", n_classes=4, seed=5, outer_folds=3, inner_folds=2)
#: Replicates behind the intervals of a report.
REPLICATES = 100


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def labelled(spark, folder) -> DataFrame:
    """Labelled documents with text features and an ordinal target 0..3, stored.

    Fits pass over their rows many times; the texts are read for them once.
    """
    docs = table(spark, folder, "documents")
    features = docs.select(
        "doc_id",
        "lang",
        "n_chars",
        F.size(sentences("text")).alias("n_sentences"),
        F.expr("size(regexp_extract_all(lower(text), '(idiot|clown|loser|trash|moron)', 1))").alias("n_insults"),
        F.expr("size(regexp_extract_all(text, '([#%$*&]{3})', 1))").alias("n_symbols"),
        F.expr("CASE WHEN doc_id % 10 <> 0 THEN size(split(text, ' ')) END").alias("n_words"),
    )
    labels = table(spark, folder, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("y"))
    return stored(features.join(labels, "doc_id"))


def _final(spark, folder, candidates):
    dev, test = mv.split_rows(labelled(spark, folder), TASK)
    return mv.final_model(dev, test, candidates, TASK), test


def _shown(final: mv.FinalModel) -> DataFrame:
    probs = [f"proba_{k}" for k in range(TASK.n_classes)]
    return rounded(final.predictions.select("doc_id", "y", "predicted_code", *probs), probs)


@query()
def ordinal_fit(spark, folder):
    return _shown(_final(spark, folder, [mm.OrdinalLogit(alpha=0.5, max_iter=100)])[0])


@query()
def forest_fit(spark, folder):
    return _shown(_final(spark, folder, [mm.Forest(seed=1)])[0])


@query()
def boosted_fit(spark, folder):
    """Boosted trees of 150 rounds at step 0.05, depth 3 or 5 by the inner folds, on the test rows."""
    registry = {"boosted_trees": mm.model_registry(TASK.seed)["boosted_trees"]}
    final = ms.nested_search(labelled(spark, folder), registry, TASK, "documents").final["boosted_trees"]
    return rounded(final, [f"proba_{k}" for k in range(TASK.n_classes)])


@query()
def nested_validation(spark, folder):
    """Out-of-fold predictions of the forest, its settings chosen by the inner folds."""
    registry = {"random_forest": mm.model_registry(TASK.seed)["random_forest"]}
    outer = ms.nested_search(labelled(spark, folder), registry, TASK, "documents").outer["random_forest"]
    return outer.select("outer_fold", "doc_id", "y", "predicted_code")


#: A rule that needs no training: insults make a text toxic, symbol noise makes it poor.
_RULE = "int(CASE WHEN n_insults > 0 THEN 2 ELSE 0 END + CASE WHEN n_symbols > 0 THEN 0 ELSE 1 END)"


@query()
def final_report(spark, folder):
    """Every metric of the forest on the isolated test rows, with bootstrap intervals."""
    final, _ = _final(spark, folder, [mm.Forest(seed=1)])
    probs = [f"proba_{k}" for k in range(TASK.n_classes)]
    rows = stored(final.predictions.select("doc_id", "y", "predicted_code", *probs))
    recalls, precisions = {"recall_toxic": 2, "recall_both": 3}, {"auprc_toxic": 2, "auprc_both": 3}
    told = ("y", "predicted_code", TASK.n_classes, recalls)
    report = classification_report(rows, *told, probs, precisions, calibration=True)
    spans = bootstrap_intervals(rows, "doc_id", *told, REPLICATES, TASK.seed, probs, precisions, calibration=True)
    return rounded(report.join(spans, "metric", "left"), ["value", "ci_2_5", "ci_97_5"], 4)


@query()
def model_comparison(spark, folder):
    """Development and test macro F1 of three families, each with its whole grid, and of a rule.

    The best by development score is marked.
    """
    rows = labelled(spark, folder).withColumn("rule", F.expr(_RULE))
    summary = ms.nested_search(rows, mm.model_registry(TASK.seed), TASK, "documents", "rule").summary
    best = best_per_group(summary, "dataset", "development_f1_macro", "model").select("dataset", F.col("model").alias("best"))
    marked = summary.join(best, "dataset").withColumn("selected", F.col("model") == F.col("best")).drop("best")
    return rounded(marked, ["development_f1_macro", "final_test_f1_macro"])


# --- what a search does around its fits, in SQL --------------------------------------------------

def _place(by: str, salt: str, seed: int) -> str:
    draw = sql.draw(seed, f"'{salt}'", "doc_id::VARCHAR")
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {draw}, doc_id)"


_NAMES = [*[f"outer{i + 1}" for i in range(TASK.outer_folds)], ms.FINAL]
_TRAIN = [*[f"NOT test AND o <> {i}" for i in range(TASK.outer_folds)], "NOT test"]
_JUDGED = [*[f"NOT test AND o = {i}" for i in range(TASK.outer_folds)], "test"]
_SEEDS = [*[TASK.seed + i + 1 for i in range(TASK.outer_folds)], TASK.seed + 999]
_SETS_SQL = f"""lab AS (
  SELECT doc_id, d.lang, d.n_chars, text, (quality + 2 * toxic)::INT AS y FROM documents d JOIN labels USING (doc_id)),
split AS (SELECT *, {_place('y', 'split', TASK.seed)} <= round_even({TASK.test_size} * count(*) OVER (PARTITION BY y), 0) AS test FROM lab),
folded AS (SELECT *, ({_place('y, test', 'outer', TASK.seed)} - 1) % {TASK.outer_folds} AS o FROM split),
dealt AS (SELECT *, {', '.join(f"({_place(f'y, ({t})', 'inner', s)} - 1) % {TASK.inner_folds} AS f_{n}" for n, t, s in zip(_NAMES, _TRAIN, _SEEDS))} FROM folded)"""
_ROLES_SQL = ", ".join(
    [f"CASE WHEN {t} THEN 1 WHEN {v} THEN 2 ELSE 0 END::INT AS role_{n}" for n, t, v in zip(_NAMES, _TRAIN, _JUDGED)]
    + [
        f"CASE WHEN {t} AND f_{n} <> {i} THEN 1 WHEN {t} THEN 2 ELSE 0 END::INT AS role_{n}_inner{i + 1}"
        for n, t in zip(_NAMES, _TRAIN)
        for i in range(TASK.inner_folds)
    ]
)


def _search_table(spark, folder) -> tuple[DataFrame, list[str]]:
    marked, sets = ms.with_roles(labelled(spark, folder).withColumn("rule", F.expr(_RULE)), TASK)
    return stored(marked), [*sets, *[n for inner in sets.values() for n in inner]]


@query(f"WITH {_SETS_SQL} SELECT doc_id, y, {_ROLES_SQL} FROM dealt")
def search_roles(spark, folder):
    """Which rows every training set of the search trains on (1) and is judged on (2)."""
    marked, names = _search_table(spark, folder)
    return marked.select("doc_id", "y", *[F.col(f"role_{n}").cast("int").alias(f"role_{n}") for n in names])


_FEATURES_SQL = """feat AS (
  SELECT doc_id, y, test, lang, n_chars::DOUBLE AS n_chars,
    len(regexp_extract_all(lower(text), 'idiot|clown|loser|trash|moron'))::DOUBLE AS n_insults,
    len(regexp_extract_all(text, '[#%$*&]{3}'))::DOUBLE AS n_symbols,
    CASE WHEN doc_id % 10 <> 0 THEN len(string_split(text, ' ')) END::DOUBLE AS n_words FROM dealt),
mid AS (SELECT quantile_disc(n_words, 0.5) AS m FROM feat WHERE NOT test),
filled AS (SELECT * REPLACE (coalesce(n_words, m) AS n_words), (n_words IS NULL)::INT::DOUBLE AS missing_n_words FROM feat, mid),
long AS (UNPIVOT filled ON n_chars, n_insults, n_symbols, n_words, missing_n_words INTO NAME name VALUE v),
spread AS (SELECT name, avg(v) AS mean, stddev_samp(v) AS width FROM long WHERE NOT test GROUP BY name),
prep AS (SELECT doc_id, test, 'numeric__' || name AS feature, (v - mean) / width AS value FROM long JOIN spread USING (name)
  UNION ALL SELECT doc_id, test, 'categorical__lang_' || l, (lang = l)::INT::DOUBLE
  FROM feat CROSS JOIN (SELECT DISTINCT lang AS l FROM feat WHERE NOT test))"""
_NUMERIC = ["n_chars", "n_insults", "n_symbols", "n_words"]


def _prepared(spark, folder) -> tuple[DataFrame, list[str]]:
    marked, _ = _search_table(spark, folder)
    table_, labels = ms.designed(marked, [ms.FINAL], _NUMERIC, ["lang"])
    return table_.select("doc_id", f"role_{ms.FINAL}", f"x_{ms.FINAL}"), labels[ms.FINAL]


@query(f"WITH {_SETS_SQL}, {_FEATURES_SQL} SELECT doc_id, feature, round(value, 6) AS value FROM prep")
def prepared_features(spark, folder):
    """Imputed, standardised and one-hot features by the statistics of the development rows."""
    rows, labels = _prepared(spark, folder)
    names = F.array(*[F.lit(n) for n in labels])
    cells = F.arrays_zip(names.alias("feature"), F.col(f"x_{ms.FINAL}").alias("value"))
    return rounded(rows.select("doc_id", F.inline(cells)), ["value"])


#: A scorecard with fixed slopes for the prepared features.
_CARD = {"numeric__n_insults": 1.5, "numeric__n_symbols": -0.4, "numeric__n_chars": 0.1, "numeric__missing_n_words": 0.05}
_CARD_SQL = f"""card AS (SELECT doc_id, prep.feature, 2 * abs(value * coalesce(slope, 0)) AS contribution
  FROM prep LEFT JOIN (VALUES {', '.join(f"('{n}', {v}::DOUBLE)" for n, v in _CARD.items())}) c(feature, slope) ON c.feature = prep.feature WHERE test)"""


def _card_contributions(spark, folder) -> DataFrame:
    rows, labels = _prepared(spark, folder)
    card = mm.OrdinalLogit(coefficients=[_CARD.get(n, 0.0) for n in labels], thresholds=[-1.0, 0.0, 1.0])
    test = rows.where(F.col(f"role_{ms.FINAL}") == 2)
    ready = test.select("doc_id", array_to_vector(f"x_{ms.FINAL}").alias("features"))
    return mv.feature_contributions(ready, card, labels, TASK)


@query(f"WITH {_SETS_SQL}, {_FEATURES_SQL}, {_CARD_SQL} SELECT feature, round(avg(contribution), 6) AS mean_abs_contribution FROM card GROUP BY feature")
def scorecard_contributions(spark, folder):
    """Mean absolute contribution per feature of a scorecard on the test rows."""
    return rounded(mv.mean_contributions(_card_contributions(spark, folder)), ["mean_abs_contribution"])


@query(
    f"""WITH {_SETS_SQL}, {_FEATURES_SQL}, {_CARD_SQL},
ids AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS test_row_index FROM (SELECT DISTINCT doc_id FROM card))
SELECT test_row_index, feature, round(contribution, 6) AS contribution FROM card JOIN ids USING (doc_id) WHERE test_row_index < 10"""
)
def scorecard_examples(spark, folder):
    """Contributions of the first ten test rows, with their row index."""
    return rounded(mv.local_examples(_card_contributions(spark, folder), "doc_id"), ["contribution"])


_RULE_SQL = """pred AS (SELECT test, y, CASE WHEN regexp_matches(lower(text), 'idiot|clown|loser|trash|moron') THEN 2 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#%$*&]{3}') THEN 0 ELSE 1 END AS yhat FROM split),
lbl AS (SELECT test, v, dense_rank() OVER (PARTITION BY test ORDER BY v) AS i FROM (SELECT DISTINCT test, unnest([y, yhat]) AS v FROM pred)),
kp AS (SELECT pred.test, a.i AS y, b.i AS yhat FROM pred JOIN lbl a ON a.test = pred.test AND a.v = y JOIN lbl b ON b.test = pred.test AND b.v = yhat),
pc AS (SELECT test, k, count(*) FILTER (WHERE y = k AND yhat = k) AS tp, count(*) FILTER (WHERE y = k) AS s, count(*) FILTER (WHERE yhat = k) AS f
  FROM pred CROSS JOIN (SELECT unnest(range(4)) AS k) GROUP BY test, k),
m AS (SELECT test, 'f1_macro' AS metric, avg(coalesce(2.0 * tp / nullif(s + f, 0), 0)) AS value FROM pc GROUP BY test
  UNION ALL SELECT test, 'recall_toxic', max(coalesce(tp::DOUBLE / nullif(s, 0), 0)) FROM pc WHERE k = 2 GROUP BY test
  UNION ALL SELECT test, 'ordinal_mae', avg(abs(y - yhat)) FROM pred GROUP BY test
  UNION ALL SELECT test, 'weighted_kappa', 1 - sum(power(y - yhat, 2)) / (sum(y * y) + sum(yhat * yhat) - 2.0 * sum(y) * sum(yhat) / count(*)) FROM kp GROUP BY test)"""


@query(f"WITH {_SETS_SQL}, {_RULE_SQL} SELECT CASE WHEN test THEN 'final_test' ELSE 'development' END AS part, metric, round(value, 6) AS value FROM m")
def rule_scores(spark, folder):
    """Label metrics of the rule on the development rows and on the isolated test rows."""
    marked, _ = _search_table(spark, folder)
    part = F.when(F.col(f"role_{ms.FINAL}") == 2, "final_test").otherwise("development").alias("part")
    counts = label_counts(marked.select("y", "rule", part), "y", "rule", ["part"])
    return rounded(label_metrics(counts, TASK.n_classes, {"recall_toxic": 2}, ["part"]), ["value"])


# --- explanations --------------------------------------------------------------------------------


@query()
def ordinal_coefficients(spark, folder):
    final, _ = _final(spark, folder, [mm.OrdinalLogit(alpha=0.5, max_iter=100)])
    return rounded(mv.ordinal_coefficients(final, spark), ["coefficient", "abs_coefficient"], 4)


@query()
def permutation_importance(spark, folder):
    final, test = _final(spark, folder, [mm.Forest(trees=10, max_depth=6, seed=1)])
    return rounded(mv.permutation_importance(final, test, TASK, 9), ["importance"])


@query()
def mean_contributions(spark, folder):
    """Mean contribution of each feature to the upper classes, by the paths of the forest's trees."""
    final, test = _final(spark, folder, [mm.Forest(trees=50, max_depth=12, seed=1)])
    return rounded(mv.mean_contributions(mv.contributions(final, test, TASK)), ["mean_abs_contribution"])


@query()
def local_examples(spark, folder):
    final, test = _final(spark, folder, [mm.Forest(trees=50, max_depth=12, seed=1)])
    return rounded(mv.local_examples(mv.contributions(final, mv.rows_of_first(test, "doc_id"), TASK), "doc_id"), ["contribution"])
