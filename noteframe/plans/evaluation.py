"""Evaluation of extractors on the documents: lexicons, flipped copies, runs and scenarios.

The wide lexicon is the reference. All extractors, runs and scenarios of a query are columns
of one row from one scan and one sentence split (``extract_variants``); none is joined by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stage_seed, uniform
from ..operators import extraction_eval as xe
from ..operators.extraction import Variant, extract_variants
from ..operators.markers import FEATURE_FIELDS, FIELDS, marker_comparison, markers_long, paired_columns
from ..presets import clinical as c
from ..presets import web
from . import sql
from .common import BASE_SEED, dealt, rounded, table

QUERIES: dict = {}
ORACLES: dict = {}
REPETITIONS = 50
FLIP_RATE = 0.10
WIDE = web.ONTOLOGY

REFERENCE = Variant("reference", WIDE)
NARROW = Variant("narrow", web.NARROW)
FLIPPED = Variant("flipped", WIDE, FLIP_RATE, 21)
RUNS = tuple(Variant(f"run_{i}", WIDE, FLIP_RATE, 10 + i) for i in (1, 2, 3))
SCENARIOS = (
    Variant("wide_flip_0", WIDE),
    Variant("wide_flip_5", WIDE, 0.05, 32),
    Variant("wide_flip_20", WIDE, 0.20, 33),
    Variant("narrow_flip_0", web.NARROW),
    Variant("narrow_flip_10", web.NARROW, 0.10, 35),
)


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def variants(spark: SparkSession, folder: str, *found: Variant) -> DataFrame:
    docs = dealt(table(spark, folder, "documents").select("doc_id", "text"))
    return extract_variants(docs, "doc_id", "text", found, document_prefilter=True)


def pairs(
    spark: SparkSession,
    folder: str,
    *found: Variant,
    fields: Sequence[str] = FEATURE_FIELDS,
    name: str = "extractor",
) -> DataFrame:
    """Reference and prediction of each extractor per document and marker."""
    rows = variants(spark, folder, REFERENCE, *found)
    return paired_columns(rows, "doc_id", REFERENCE.name, [v.name for v in found], fields, name)


# --- SQL twins -----------------------------------------------------------------------------


def _ctes(*found: Variant) -> str:
    return ",".join(
        sql.extraction_ctes(v.name, "documents", "doc_id", "text", v.ontology, v.flip_rate, v.seed) for v in found
    )


def _pairs_sql(*found: Variant, name: str = "extractor") -> str:
    """WITH ... pairs: what ``pairs`` gives."""
    fields = ", ".join(f"r.{f} AS ref_{f}, p.{f} AS pred_{f}" for f in FIELDS)
    parts = " UNION ALL ".join(
        f"SELECT '{v.name}' AS {name}, r.doc_id, r.i, r.marker, {fields} FROM {REFERENCE.name} r JOIN {v.name} p USING (doc_id, i)"
        for v in found
    )
    return f"WITH {_ctes(REFERENCE, *found)}, pairs AS ({parts})"


def _cells_sql() -> str:
    parts = []
    for f in xe.DIMENSIONS:
        where = "" if f in xe.BINARY_FIELDS else " WHERE ref_present + ref_negated + ref_remote_present > 0"
        parts.append(
            f"SELECT extractor, marker, '{f}' AS dimension, ref_{f}::VARCHAR AS reference, pred_{f}::VARCHAR AS predicted FROM pairs{where}"
        )
    return (
        "cells AS (SELECT extractor, marker, dimension, reference, predicted, count(*)::BIGINT AS n FROM ("
        + " UNION ALL ".join(parts)
        + ") GROUP BY ALL)"
    )


_BOTH = _pairs_sql(NARROW, FLIPPED)
_CELL_CHAIN = f"{_BOTH}, {_cells_sql()}"


# --- queries -------------------------------------------------------------------------------


@query(
    f"""WITH {_ctes(REFERENCE, NARROW)}
SELECT 'web' AS extractor_id, marker, sum(present)::BIGINT AS present, sum(negated)::BIGINT AS negated, sum(remote_present)::BIGINT AS remote FROM reference GROUP BY marker
UNION ALL SELECT 'narrow', marker, sum(present)::BIGINT, sum(negated)::BIGINT, sum(remote_present)::BIGINT FROM narrow GROUP BY marker"""
)
def second_extractor(spark, folder):
    """A second extractor kept beside the first, same schema."""
    rows = variants(spark, folder, REFERENCE, NARROW)
    both = [
        F.struct(F.lit(shown).alias("extractor_id"), F.col(v.name).alias("markers"))
        for shown, v in (("web", REFERENCE), ("narrow", NARROW))
    ]
    return (
        markers_long(rows.select("doc_id", F.inline(F.array(*both))))
        .groupBy("extractor_id", "marker")
        .agg(
            F.sum("present").alias("present"),
            F.sum("negated").alias("negated"),
            F.sum("remote_present").alias("remote"),
        )
    )


@query(
    f"""{_pairs_sql(NARROW)}, p AS (SELECT marker, ref_present AS r, pred_present AS f FROM pairs),
k AS (SELECT marker, count(*) AS n, sum(r * f)::DOUBLE AS tp, sum((1 - r) * f)::DOUBLE AS fp, sum(r * (1 - f))::DOUBLE AS fn FROM p GROUP BY marker)
SELECT 'narrow' AS extractor, marker, n::BIGINT AS n, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM k"""
)
def lexicon_agreement(spark, folder):
    """Presence scores of the narrow lexicon against the wide one, from presence alone."""
    counts = xe.presence_scores(pairs(spark, folder, NARROW, fields=("present",)))
    return rounded(counts, ["precision", "recall", "f1"])


def _status_sql(p: str) -> str:
    present, denied, remote, silent = (sql.quoted(t) for t in c.STATUS_TITLES)
    return (
        f"CASE WHEN {p}present = 1 AND {p}negated = 0 THEN {present} WHEN {p}negated = 1 THEN {denied} "
        f"WHEN {p}remote_present = 1 THEN {remote} ELSE {silent} END"
    )


@query(
    f"""{_BOTH} SELECT extractor, doc_id, marker, {_status_sql('ref_')} AS origin_status, {_status_sql('pred_')} AS extracted_status,
    CASE WHEN {_status_sql('ref_')} = {_status_sql('pred_')} THEN 'Sim' ELSE 'Não' END AS agreement,
    pred_temporality AS temporality, pred_severity AS severity, pred_certainty AS certainty, pred_experiencer AS experiencer,
    pred_evidence AS evidence FROM pairs"""
)
def marker_compare(spark, folder):
    both = pairs(spark, folder, NARROW, FLIPPED, fields=FIELDS)
    return marker_comparison(both, "doc_id", c.STATUS_TITLES, c.YES, c.NO, keep=["extractor"])


@query(f"{_CELL_CHAIN} SELECT extractor, marker, dimension, reference, predicted, n AS count FROM cells")
def marker_confusion(spark, folder):
    return xe.confusion_long(xe.qualifier_cube(pairs(spark, folder, NARROW, FLIPPED)))


_G3 = "extractor, marker, dimension"
_METRICS = ["precision", "recall", "f1", "accuracy", "kappa", "mae"]


@query(
    f"""{_CELL_CHAIN}, k AS ({sql.kappa_sql("(SELECT * FROM cells WHERE dimension <> 'severity_code')", _G3, 'reference', 'predicted', 'n')}
  UNION ALL {sql.quadratic_kappa_sql("(SELECT * FROM cells WHERE dimension = 'severity_code')", _G3, 'reference', 'predicted', 'n')}),
m AS (SELECT {_G3}, sum(n)::BIGINT AS n, dimension IN ('present','negated','remote_present') AS b,
  sum(n) FILTER (WHERE reference = '1' AND predicted = '1') AS tp, sum(n) FILTER (WHERE predicted = '1') AS fo,
  sum(n) FILTER (WHERE reference = '1') AS ac, sum(n) FILTER (WHERE reference = predicted) AS sa,
  CASE WHEN dimension = 'severity_code' THEN sum(n * abs(try_cast(reference AS DOUBLE) - try_cast(predicted AS DOUBLE))) / sum(n) END AS mae
  FROM cells GROUP BY {_G3})
SELECT {_G3}, n, round(CASE WHEN b THEN coalesce(coalesce(tp, 0)::DOUBLE / nullif(coalesce(fo, 0), 0), 0) END, 6) AS precision,
  round(CASE WHEN b THEN coalesce(coalesce(tp, 0)::DOUBLE / nullif(coalesce(ac, 0), 0), 0) END, 6) AS recall,
  round(CASE WHEN b THEN coalesce(2.0 * coalesce(tp, 0) / nullif(coalesce(fo, 0) + coalesce(ac, 0), 0), 0) END, 6) AS f1,
  round(coalesce(sa, 0)::DOUBLE / n, 6) AS accuracy, round(kappa, 6) AS kappa, round(mae, 6) AS mae
FROM m LEFT JOIN k USING ({_G3})"""
)
def marker_prf(spark, folder):
    return rounded(xe.marker_metrics(xe.qualifier_cube(pairs(spark, folder, NARROW, FLIPPED))), _METRICS)


_SUMMARY = [
    "macro_precision",
    "macro_recall",
    "macro_f1",
    "micro_precision",
    "micro_recall",
    "micro_f1",
    "omission_rate",
    "hallucination_rate",
    "qualification_error_rate",
]
_WRONG = " + ".join(
    f"(ref_{f} <> pred_{f})::INT" for f in ("temporality", "severity", "certainty", "experiencer", "severity_code")
)


def _summary_sql(by: str) -> str:
    return f"""pm AS (SELECT {by}, marker, count(*) AS n,
  sum(ref_present * pred_present)::DOUBLE AS tp, sum((1 - ref_present) * pred_present)::DOUBLE AS fp,
  sum(ref_present * (1 - pred_present))::DOUBLE AS fn, sum((1 - ref_present) * (1 - pred_present))::DOUBLE AS tn
  FROM pairs GROUP BY {by}, marker),
qe AS (SELECT {by}, sum({_WRONG})::DOUBLE / (5 * count(*)) AS q FROM pairs
  WHERE ref_present + ref_negated + ref_remote_present > 0 GROUP BY {by}),
s AS (SELECT {by}, max(n)::BIGINT AS n, avg(coalesce(tp / nullif(tp + fp, 0), 0)) AS macro_precision,
  avg(coalesce(tp / nullif(tp + fn, 0), 0)) AS macro_recall, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro_f1,
  sum(tp) / (sum(tp) + sum(fp)) AS micro_precision, sum(tp) / (sum(tp) + sum(fn)) AS micro_recall,
  2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1, sum(fn) / (sum(tp) + sum(fn)) AS omission_rate,
  sum(fp) / (sum(fp) + sum(tn)) AS hallucination_rate FROM pm GROUP BY {by})
SELECT {by}, n, {sql.rounded(_SUMMARY[:-1])}, round(q, 6) AS qualification_error_rate FROM s JOIN qe USING ({by})"""


@query(
    f"SELECT *, 0::BIGINT AS failed_extractions, 0::BIGINT AS retry_count FROM ({_BOTH}, {_summary_sql('extractor')})"
)
def extraction_report(spark, folder):
    """Scores of both extractors; rules neither fail nor retry (replies: ``reply_status_counts``)."""
    cube = xe.qualifier_cube(pairs(spark, folder, NARROW, FLIPPED))
    return rounded(xe.extraction_summary(cube, absent=WIDE.absent), _SUMMARY)


@query(f"{_pairs_sql(*SCENARIOS, name='scenario')}, {_summary_sql('scenario')}")
def scenario_extraction(spark, folder):
    """Scenarios of lexicon and error rate through extraction and evaluation, in one pass."""
    cube = xe.qualifier_cube(pairs(spark, folder, *SCENARIOS, name="scenario"), ["scenario"])
    out = xe.extraction_summary(cube, ["scenario"], absent=WIDE.absent)
    return rounded(out.drop("failed_extractions", "retry_count"), _SUMMARY)


_RUN_CTES = _ctes(*RUNS)
_RUN_UNION = " UNION ALL ".join(f"SELECT '{v.name}' AS run, * FROM {v.name}" for v in RUNS)
_STABLE = " UNION ALL ".join(
    f"SELECT run_a, run_b, marker, '{f}' AS dimension, (a.{f} = b.{f})::INT AS same FROM rp" for f in FEATURE_FIELDS
)


@query(
    f"WITH {_RUN_CTES}, runs AS ({_RUN_UNION}), "
    "rp AS (SELECT a.run AS run_a, b.run AS run_b, a.marker, a, b FROM runs a JOIN runs b USING (doc_id, i) WHERE a.run < b.run) "
    f"SELECT run_a, run_b, marker, count(*)::BIGINT AS n, dimension, round(avg(same), 6) AS agreement FROM ({_STABLE}) GROUP BY ALL"
)
def stability_runs(spark, folder):
    return rounded(xe.stability(variants(spark, folder, *RUNS), [v.name for v in RUNS]), ["agreement"])


def _blanked(name: str, seed: int) -> Column:
    """An annotator's form: a tenth of the presence values left blank."""
    return F.transform(
        name,
        lambda m: F.struct(
            m["marker"].alias("marker"),
            F.when(uniform(seed, F.col("doc_id"), m["marker"]) >= 0.1, m["present"]).alias("present"),
            *[m[f].alias(f) for f in FEATURE_FIELDS if f != "present"],
        ),
    ).alias(name)


def _annotated(name: str, src: str, seed: int) -> str:
    rest = ", ".join(f for f in FEATURE_FIELDS if f != "present")
    u = sql.draw(seed, "marker", "doc_id::VARCHAR")
    return f"{name} AS (SELECT doc_id, i, marker, CASE WHEN {u} >= 0.1 THEN present END AS present, {rest} FROM {src})"


_ANNOTATED_CELLS = " UNION ALL ".join(
    f"SELECT marker, '{f}' AS dimension, a.{f}::VARCHAR AS l, b.{f}::VARCHAR AS r FROM ab" for f in FEATURE_FIELDS
)


@query(
    f"WITH {_ctes(*RUNS[:2])}, {_annotated('aa', 'run_1', 31)}, {_annotated('bb', 'run_2', 32)}, "
    "ab AS (SELECT a.marker, a, b FROM aa a JOIN bb b USING (doc_id, i)), "
    f"cc AS (SELECT marker, dimension, l, r, count(*) AS n FROM ({_ANNOTATED_CELLS}) GROUP BY ALL), "
    "ok AS (SELECT * FROM cc WHERE l IS NOT NULL AND r IS NOT NULL), "
    f"k AS ({sql.kappa_sql('ok', 'marker, dimension', 'l', 'r', 'n')}) "
    "SELECT marker, dimension, coalesce(n, 0)::BIGINT AS n, round(agr, 6) AS agreement, round(kappa, 6) AS kappa "
    "FROM (SELECT DISTINCT marker, dimension FROM cc) LEFT JOIN (SELECT marker, dimension, sum(n) AS n, "
    "coalesce(sum(n) FILTER (WHERE l = r), 0)::DOUBLE / sum(n) AS agr FROM ok GROUP BY ALL) USING (marker, dimension) "
    "LEFT JOIN k USING (marker, dimension)"
)
def annotator_agreement(spark, folder):
    left, right = RUNS[:2]
    forms = variants(spark, folder, left, right).select("doc_id", _blanked(left.name, 31), _blanked(right.name, 32))
    return rounded(xe.agreement_of_columns(forms, left.name, right.name), ["agreement", "kappa"])


_BOOT_SEED = stage_seed(BASE_SEED, "bootstrap")
_BOOT = f"""boot AS (
  SELECT repetition, marker, sum(w * ref_present * pred_present)::DOUBLE AS tp, sum(w * (1 - ref_present) * pred_present)::DOUBLE AS fp,
    sum(w * ref_present * (1 - pred_present))::DOUBLE AS fn
  FROM (SELECT *, {sql.poisson_case('u')} AS w FROM (
    SELECT p.marker, ref_present, pred_present, r.repetition,
      {sql.poisson_digits(_BOOT_SEED, 'doc_id::VARCHAR', 'r.repetition')} AS u
    FROM pairs p CROSS JOIN (SELECT unnest(range({REPETITIONS})) AS repetition) r))
  GROUP BY repetition, marker),
samples AS (SELECT repetition, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro_f1,
  2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1 FROM boot GROUP BY repetition)"""


def _samples(spark, folder) -> DataFrame:
    rows = variants(spark, folder, REFERENCE, FLIPPED)
    present = lambda m: F.struct(m["present"].alias("present"))
    slim = rows.select(
        "doc_id",
        F.lit(FLIPPED.name).alias("extractor"),
        F.transform(REFERENCE.name, present).alias("ref"),
        F.transform(FLIPPED.name, present).alias("pred"),
    )
    return xe.extraction_bootstrap(slim, "doc_id", WIDE, REPETITIONS, _BOOT_SEED)


@query(
    f"{_pairs_sql(FLIPPED)}, {_BOOT} SELECT 'flipped' AS extractor, repetition::INT AS repetition, round(macro_f1, 6) AS macro_f1, round(micro_f1, 6) AS micro_f1 FROM samples"
)
def bootstrap_samples(spark, folder):
    return rounded(_samples(spark, folder), ["macro_f1", "micro_f1"])


@query(
    f"""{_pairs_sql(FLIPPED)}, {_BOOT} SELECT 'flipped' AS extractor, metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS ci_2_5,
  round(quantile_cont(v, 0.975), 6) AS ci_97_5 FROM (
  SELECT 'macro_f1' AS metric, macro_f1 AS v FROM samples UNION ALL SELECT 'micro_f1', micro_f1 FROM samples) GROUP BY metric"""
)
def bootstrap_ci(spark, folder):
    out = xe.percentile_intervals(_samples(spark, folder), ["extractor"], ["macro_f1", "micro_f1"])
    return rounded(out, ["mean", "ci_2_5", "ci_97_5"])
