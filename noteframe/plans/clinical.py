"""Queries with the clinical preset over cohorts derived from customers and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as x
from ..functions.hashing import stage_seed, uniform
from ..functions.scalar import min_max, round_half_even
from ..operators.contracts import allowed_only, blank_form, visible_and_audit
from ..operators.extraction import extract_markers
from ..operators.features import AnalyticSpec, analytic_sets
from ..operators.joins import lineage
from ..operators.markers import (
    FEATURE_FIELDS,
    FIELDS,
    marker_column,
    active_sql,
    markers_from_wide,
    markers_long,
    markers_wide,
    normalize_markers,
    parse_replies,
    reference_table,
)
from ..operators.ranking import RankedTableSpec, ranked_table
from ..operators.rendering import NoteSpec, render_notes
from ..operators.rules import apply_rule_matrix, assign_reference, rule_baseline
from ..operators.sampling import (
    flipped,
    random_rows,
    scenario_rows,
    shuffled,
    stratified_sample,
    with_critical_row,
)
from ..presets import clinical as c
from . import sql
from .common import ACCOUNTS_SQL, BASE_SEED, accounts, rounded

ONT = c.ONTOLOGY
KEY = c.KEY
FLIP_RATE, MISSING_RATE, OMISSION_RATE = 0.10, 0.10, 0.10

NOTE = NoteSpec(
    scores=c.SCORES,
    score_steps=c.SCORE_STEPS,
    score_phrases=c.SCORE_PHRASES,
    graded=c.FUNCTIONAL,
    graded_phrases=c.FUNCTIONAL_PHRASES,
    graded_unknown=c.FUNCTIONAL_UNKNOWN,
    support="suporte_social_baixo",
    support_phrases=c.SUPPORT_PHRASES,
    always_past="internacao_previa",
    terms=c.TERMS,
    subjects=c.SUBJECTS,
    tenses=c.TENSES,
    hedge=c.HEDGE,
    verbs=c.VERBS,
    past=c.PAST,
    openings=c.OPENINGS,
    assessment=c.ASSESSMENT,
    generator_id=c.TEMPLATE_ID,
    prompt_version=c.PROMPT_VERSION,
    id_prefix=c.NOTE_PREFIX,
)

ANALYTIC = AnalyticSpec(
    key=KEY,
    scores=c.SCORES,
    targets=c.TARGETS,
    dropped=c.DROPPED_PROFILE_COLUMNS,
    source_prefix=c.SOURCE_PREFIX,
    extracted_prefix=c.EXTRACTED_PREFIX,
    canonical_prefix=c.CANONICAL_PREFIX,
    text_columns=("gender_category", "education"),
)

RANKED = RankedTableSpec(
    key=KEY,
    labels=c.LABELS,
    predicted=("prioridade_prevista", "prioridade_prevista_codigo"),
    reference=("prioridade_referencia", "prioridade_referencia_codigo"),
    probabilities=("proba_2", "proba_3"),
    profile=("age_years", "gender_category", "social_vulnerability"),
    scores=c.SCORES,
    age="age_years",
    category="gender_category",
    index="social_vulnerability",
    functional=marker_column(c.EXTRACTED_PREFIX, c.FUNCTIONAL, "severity_code"),
    signals={marker_column(c.EXTRACTED_PREFIX, m, "present"): t for m, t in c.SIGNAL_TITLES.items()},
    class_titles=c.CLASS_TITLES,
    category_titles=c.GENDER_TITLES,
    functional_titles=c.FUNCTIONAL_TITLES,
    no_signal=c.NO_SIGNAL,
    not_available=c.NOT_AVAILABLE,
    yes=c.YES,
    no=c.NO,
    titles={
        "position": "Posição",
        "key": "ID do perfil sintético",
        "predicted": "Prioridade prevista",
        "reference": "Prioridade de referência simulada",
        "agreement": "Concorda com a referência simulada?",
        "high": "Probabilidade alta/urgente",
        "top": "Probabilidade urgente",
        "age": "Idade",
        "category": "Categoria de gênero",
        "index": "Vulnerabilidade social",
        "phq9_total": "PHQ-9",
        "gad7_total": "GAD-7",
        "idate_estado_total": "IDATE-Estado",
        "functional": "Comprometimento funcional extraído",
        "signals": "Sinais de atenção extraídos",
    },
)


# --- tables derived from customers and orders -------------------------------------------


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes per customer: age, category, education, index in [0, 1], audit column."""
    acc = accounts(spark, folder)
    base = acc.withColumn("social_vulnerability", F.lit(1.0) - min_max(acc, "bal"))
    nk = F.col("nk") % 3
    return base.select(
        KEY,
        F.lit(BASE_SEED).alias("seed"),
        (F.col(KEY) % 63 + 18).cast("int").alias("age_years"),
        F.when(nk == 0, "feminino").when(nk == 1, "masculino").otherwise("outro_ou_nao_informado").alias("gender_category"),
        F.when(F.col("seg") < "F", "medio").otherwise("superior").alias("education"),
        round_half_even("social_vulnerability", 6).alias("social_vulnerability"),
        round_half_even(F.col("total") / 12, 2).alias("income_brl"),
        (F.col("n_open") % 5).cast("double").alias("gravidade_latente_auditoria"),
        "n_orders",
        "n_open",
        "n_urgent",
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    acc = accounts(spark, folder)
    return acc.select(
        KEY,
        F.least(F.lit(27), F.col("n_orders") + F.col("n_urgent")).cast("int").alias("phq9_total"),
        F.least(F.lit(21), F.col("n_open") * 2).cast("int").alias("gad7_total"),
        F.least(F.lit(80), F.col("n_orders") * 3 + 20).cast("int").alias("idate_estado_total"),
    )


def source_markers(df: DataFrame) -> DataFrame:
    """Add nested source markers as a function of the key and the number of orders."""
    k = x.col(KEY)
    names = ", ".join(x.lit(n) for n in ONT.names)
    # One record formula over the marker number i, with its hash h bound first.
    numbered = (
        f"transform(sequence(0, 9), i -> named_struct('i', i, 'marker', get(array({names}), i), "
        f"'h', ({k} * 7 + i * 13 + n_orders * (i + 3)) % 23))"
    )
    said = (
        f"transform({numbered}, r -> named_struct('i', r.i, 'marker', r.marker, 'present', int(r.h <= 3), "
        "'past_denial', r.i = 0 AND r.h = 9, 'negated', int(r.h BETWEEN 4 AND 8 OR (r.i = 0 AND r.h = 9)), "
        f"'code', CASE WHEN r.h > 3 THEN 0 ELSE int(CASE r.i WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 3 "
        f"WHEN 4 THEN 2 + {k} % 2 WHEN 5 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 1 ELSE 1 + {k} % 3 END) END))"
    )
    low, mild, moderate, high = (x.lit(v) for v in c.SEVERITY_BY_CODE)
    record = x.struct(
        [
            ("marker", "m.marker"),
            ("present", "m.present"),
            ("negated", "m.negated"),
            ("remote_present", "CASE WHEN m.i = 6 THEN m.present ELSE int(m.past_denial) END"),
            (
                "temporality",
                f"CASE WHEN m.present + m.negated = 0 THEN {x.lit(ONT.unspecified)} WHEN m.i = 6 THEN {x.lit(ONT.remote)} ELSE {x.lit(ONT.current)} END",
            ),
            (
                "severity",
                f"CASE m.code WHEN 0 THEN {low} WHEN 1 THEN {mild} WHEN 2 THEN {moderate} ELSE CASE WHEN m.i = 9 THEN {x.lit(c.GRADED_TOP_SEVERITY)} ELSE {high} END END",
            ),
            ("severity_code", "m.code"),
            (
                "certainty",
                f"CASE WHEN m.present = 1 AND NOT m.i IN (1, 2, 3) AND ({k} + m.i) % 11 = 0 THEN {x.lit(ONT.uncertain)} ELSE {x.lit(ONT.affirmed)} END",
            ),
            (
                "experiencer",
                f"CASE WHEN m.present = 1 AND m.i IN (4, 5) AND ({k} + m.i) % 7 = 0 THEN {x.lit(ONT.other_experiencer)} ELSE {x.lit(ONT.self_experiencer)} END",
            ),
            ("evidence", "''"),
        ]
    )
    return df.withColumn("markers", F.expr(f"transform({said}, m -> {record})"))


def source(spark: SparkSession, folder: str) -> DataFrame:
    """(key, nested source markers)."""
    return source_markers(accounts(spark, folder)).select(KEY, "markers")


def source_wide(spark: SparkSession, folder: str) -> DataFrame:
    return markers_wide(source(spark, folder), c.SOURCE_PREFIX, ONT)


def notes(spark: SparkSession, folder: str, omission_rate: float = 0.0) -> DataFrame:
    acc = source_markers(accounts(spark, folder))
    ready = acc.select(
        KEY,
        "markers",
        F.least(F.lit(27), F.col("n_orders") + F.col("n_urgent")).cast("int").alias("phq9_total"),
        F.least(F.lit(21), F.col("n_open") * 2).cast("int").alias("gad7_total"),
        F.least(F.lit(80), F.col("n_orders") * 3 + 20).cast("int").alias("idate_estado_total"),
    )
    return render_notes(
        ready, KEY, NOTE, ONT, seed=stage_seed(BASE_SEED, "text"), omission_rate=omission_rate
    )


def extracted(spark: SparkSession, folder: str, flip_rate: float = 0.0, seed: int | None = None, omission: float = 0.0) -> DataFrame:
    allowed = allowed_only(notes(spark, folder, omission), [KEY, "note"])
    return extract_markers(
        allowed,
        KEY,
        "note",
        ONT,
        extractor_id=c.EXTRACTOR_ID,
        flip_rate=flip_rate,
        seed=stage_seed(BASE_SEED, "extraction") if seed is None else seed,
    )


def reference(spark: SparkSession, folder: str) -> DataFrame:
    profile = profiles(spark, folder).select(KEY, "social_vulnerability").join(source_wide(spark, folder), KEY)
    return assign_reference(
        profile, scores(spark, folder), c.RULES, c.SOURCE_PREFIX, ONT, KEY, c.REFERENCE_NAMES, check=()
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Ordinal predictions with four probabilities for every customer, by fixed arithmetic."""
    acc = accounts(spark, folder)
    raw = [
        F.lit(1.0) + (F.col(KEY) * (k + 3) + F.col("n_orders") * 5 + F.col("n_urgent") * k) % 17 for k in range(4)
    ]
    total = reduce(lambda a, b: a + b, raw)
    base = acc.select(KEY, *[(r / total).alias(f"proba_{k}") for k, r in enumerate(raw)])
    probs = F.array(*[F.col(f"proba_{k}") for k in range(4)])
    code = (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
    return base.withColumn("prioridade_prevista_codigo", code)


# --- SQL twins of the derived tables ------------------------------------------------------

_GROUPS = f"""{ACCOUNTS_SQL},
prof AS (
  SELECT patient_id, {BASE_SEED} AS seed, (18 + patient_id % 63)::INT AS age_years,
    CASE nk % 3 WHEN 0 THEN 'feminino' WHEN 1 THEN 'masculino' ELSE 'outro_ou_nao_informado' END AS gender_category,
    CASE WHEN seg < 'F' THEN 'medio' ELSE 'superior' END AS education,
    round_even((1.0 - (bal - lo) / (hi - lo)) * 1000000, 0) / 1000000 AS social_vulnerability,
    round_even(total / 12 * 100, 0) / 100 AS income_brl,
    n_orders, n_open, n_urgent
  FROM acc CROSS JOIN (SELECT min(bal) AS lo, max(bal) AS hi FROM acc)),
sco AS (
  SELECT patient_id, least(27, n_orders + n_urgent)::INT AS phq9_total, least(21, 2 * n_open)::INT AS gad7_total,
    least(80, 20 + 3 * n_orders)::INT AS idate_estado_total FROM acc)"""

_MARKER_VALUES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(ONT.names))
_SOURCE = f"""
src0 AS (
  SELECT patient_id, i, marker, (patient_id * 7 + i * 13 + n_orders * (i + 3)) % 23 AS h
  FROM acc CROSS JOIN (VALUES {_MARKER_VALUES}) AS m(i, marker)),
src1 AS (
  SELECT *, (h <= 3)::INT AS present, (h BETWEEN 4 AND 8 OR (i = 0 AND h = 9))::INT AS negated,
    CASE i WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 2 + patient_id % 2 WHEN 5 THEN 2
      WHEN 6 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 1 ELSE 1 + patient_id % 3 END AS lev FROM src0),
src AS (
  SELECT patient_id, i, marker, present, negated,
    CASE WHEN i = 6 THEN present WHEN i = 0 AND h = 9 THEN 1 ELSE 0 END AS remote_present,
    CASE WHEN present + negated = 0 THEN 'nao_especificado' WHEN i = 6 THEN 'remoto' ELSE 'atual' END AS temporality,
    CASE WHEN present = 0 THEN 'ausente' WHEN lev = 1 THEN 'leve' WHEN lev = 2 THEN 'moderado'
      WHEN i = 9 THEN 'importante' ELSE 'alto' END AS severity,
    (CASE WHEN present = 1 THEN lev ELSE 0 END)::INT AS severity_code,
    CASE WHEN present = 1 AND i NOT IN (1, 2, 3) AND (patient_id + i) % 11 = 0 THEN 'incerto' ELSE 'afirmado' END AS certainty,
    CASE WHEN present = 1 AND i IN (4, 5) AND (patient_id + i) % 7 = 0 THEN 'terceiro' ELSE 'paciente' END AS experiencer,
    '' AS evidence
  FROM src1)"""


def _note_sql(name: str, omission: float = 0.0) -> str:
    seed = stage_seed(BASE_SEED, "text")
    u = sql.draw(seed, "'omit/'||marker", "s.patient_id::VARCHAR")
    terms = " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in c.TERMS.items())
    graded = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(c.FUNCTIONAL_PHRASES))
    subject = "(CASE WHEN experiencer = 'terceiro' THEN 'Um familiar' ELSE 'Paciente' END)"
    tense = "(CASE temporality WHEN 'atual' THEN ' atualmente.' WHEN 'remoto' THEN ' no passado.' ELSE ' .' END)"
    opening = sql.draw(seed, "'opening'", "a.patient_id::VARCHAR")
    return f"""
{name}_sent AS (
  SELECT patient_id, i, CASE
    WHEN i = 9 THEN 'Paciente ' || CASE WHEN negated = 1 THEN '{c.FUNCTIONAL_PHRASES[0]}' ELSE CASE severity_code {graded} END END || '.'
    WHEN i = 8 THEN CASE WHEN present = 1 THEN '{c.SUPPORT_PHRASES[0]}' ELSE '{c.SUPPORT_PHRASES[1]}' END
    ELSE (CASE WHEN remote_present = 1 AND i <> 6 THEN {subject} || ' apresentou ' || term || ' no passado. ' ELSE '' END)
      || {subject} || (CASE WHEN negated = 1 THEN ' nega ' ELSE CASE WHEN certainty = 'incerto' THEN ' possivelmente' ELSE '' END || ' apresenta ' END)
      || term || {tense} END AS s
  FROM (SELECT *, CASE marker {terms} END AS term FROM src s
        WHERE (present = 1 OR negated = 1 OR remote_present = 1) AND {u} >= {omission})),
{name} AS (
  SELECT a.patient_id, 'S - ' || (CASE floor({opening} * 3)::INT WHEN 0 THEN 'Usuário' WHEN 1 THEN 'Pessoa acompanhada' ELSE 'Paciente fictício' END)
    || ': ' || (CASE WHEN phq9_total >= 20 OR gad7_total >= 15 OR idate_estado_total >= 65 THEN '{c.SCORE_PHRASES[0]}'
       WHEN phq9_total >= 10 OR gad7_total >= 10 OR idate_estado_total >= 50 THEN '{c.SCORE_PHRASES[1]}'
       WHEN phq9_total >= 5 OR gad7_total >= 5 THEN '{c.SCORE_PHRASES[2]}' ELSE '{c.SCORE_PHRASES[3]}' END)
    || coalesce(' ' || string_agg(s, ' ' ORDER BY i), '') || chr(10) || 'A - {c.ASSESSMENT}' AS note
  FROM sco a LEFT JOIN {name}_sent t ON t.patient_id = a.patient_id
  GROUP BY a.patient_id, phq9_total, gad7_total, idate_estado_total)"""


def _extracted_sql(name: str, note: str, flip: float = 0.0, seed: int | None = None) -> str:
    seed = stage_seed(BASE_SEED, "extraction") if seed is None else seed
    return sql.extraction_ctes(name, note, KEY, "note", ONT, flip, seed)


_COHORT = f"WITH {_GROUPS},{_SOURCE}"
_CHAIN = f"{_COHORT},{_note_sql('notes')},{_extracted_sql('ext', 'notes')}"
_FLIP_CHAIN = f"{_CHAIN},{_extracted_sql('extf', 'notes', FLIP_RATE)}"

def _rules_sql(markers: str, thresholds: dict | None = None, extra: str = "", name: str = "ruled") -> str:
    """CTE with the six outputs of the rule matrix over long markers and scores."""
    t = {**c.THRESHOLDS, **(thresholds or {})}
    act = sql.active("x", ONT)
    flags = ", ".join(f"max(CASE WHEN i = {i} THEN {act} END) AS a{i}" for i in range(10))
    return f"""
{name}_a AS (
  SELECT x.patient_id, {flags}, max(CASE WHEN i = 9 THEN severity_code * {act} END) AS fs FROM {markers} x GROUP BY x.patient_id),
{name}_e AS (
  SELECT a.patient_id, {extra}
    ((a0 = 1 AND a1 = 1) OR a2 = 1 OR a3 = 1 OR (a4 = 1 AND fs >= 3))::INT AS urgent_rule_triggered,
    ((s.phq9_total >= {t['phq_high']})::INT + (s.gad7_total >= {t['gad_high']})::INT + (s.idate_estado_total >= {t['stai_high']})::INT
      + (fs >= 2)::INT + a5 + a7 + (p.social_vulnerability >= {t['vulnerability_high']})::INT + a8) AS priority_high_evidence,
    ((s.phq9_total >= {t['phq_moderate']})::INT + (s.gad7_total >= {t['gad_moderate']})::INT
      + (s.idate_estado_total >= {t['stai_moderate']})::INT + (fs >= 1)::INT + a7 + a8) AS priority_moderate_evidence
  FROM {name}_a a JOIN sco s USING (patient_id) JOIN prof p USING (patient_id)),
{name}_s AS (
  SELECT *, {t['high_evidence_weight']} * priority_high_evidence + {t['moderate_evidence_weight']} * priority_moderate_evidence AS priority_score FROM {name}_e),
{name} AS (
  SELECT *, CASE WHEN urgent_rule_triggered = 1 THEN 3 WHEN priority_score >= {t['high_priority_cutoff']} THEN 2
    WHEN priority_score >= {t['moderate_priority_cutoff']} THEN 1 ELSE 0 END AS priority_code FROM {name}_s)"""


_LABEL_CASE = "CASE {0} WHEN 0 THEN 'baixa' WHEN 1 THEN 'moderada' WHEN 2 THEN 'alta' ELSE 'urgente' END"

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


# --- text and extraction -------------------------------------------------------------------


@query(f"{_COHORT},{_note_sql('notes')} SELECT patient_id, note FROM notes")
def note_render(spark, folder):
    return notes(spark, folder).select(KEY, "note")


@query(f"{_COHORT},{_note_sql('notes', OMISSION_RATE)} SELECT patient_id, note FROM notes")
def note_render_omission(spark, folder):
    return notes(spark, folder, OMISSION_RATE).select(KEY, "note")


@query(f"{_CHAIN} SELECT patient_id, marker, {', '.join(FIELDS)} FROM ext")
def clinical_extract_long(spark, folder):
    return markers_long(extracted(spark, folder)).select(KEY, "marker", *FIELDS)


@query(f"{_CHAIN} " + sql.wide_select("ext", KEY, c.EXTRACTED_PREFIX, ONT))
def clinical_extract_wide(spark, folder):
    found = extracted(spark, folder).select(KEY, "markers")
    return markers_wide(found, c.EXTRACTED_PREFIX, ONT)


@query(f"{_FLIP_CHAIN} SELECT patient_id, marker, {', '.join(FIELDS)} FROM extf")
def clinical_extract_flipped(spark, folder):
    return markers_long(extracted(spark, folder, FLIP_RATE)).select(KEY, "marker", *FIELDS)


@query(
    f"""{_CHAIN} SELECT marker, sum({sql.active('x', ONT, False)})::BIGINT AS n_active,
    sum({sql.active('x', ONT)})::BIGINT AS n_active_current,
    sum(CASE WHEN {sql.active('x', ONT)} = 1 THEN severity_code ELSE 0 END)::BIGINT AS graded_sum FROM ext x GROUP BY marker"""
)
def marker_activity(spark, folder):
    wide = markers_wide(extracted(spark, folder).select(KEY, "markers"), c.EXTRACTED_PREFIX, ONT)
    cells = []
    for m in ONT.names:
        now = active_sql(wide.columns, c.EXTRACTED_PREFIX, m, ONT, require_current=True)
        code = x.col(marker_column(c.EXTRACTED_PREFIX, m, "severity_code"))
        cells.append(
            x.struct(
                [
                    ("marker", x.lit(m)),
                    ("a", f"int({active_sql(wide.columns, c.EXTRACTED_PREFIX, m, ONT)})"),
                    ("b", f"int({now})"),
                    ("g", f"int({now}) * {code}"),
                ]
            )
        )
    long = wide.select(F.inline(F.expr(f"array({', '.join(cells)})")))
    return long.groupBy("marker").agg(
        F.sum("a").alias("n_active"), F.sum("b").alias("n_active_current"), F.sum("g").alias("graded_sum")
    )


# --- marker contract -----------------------------------------------------------------------


@query(f"{_COHORT} " + sql.wide_select("src", KEY, c.SOURCE_PREFIX, ONT))
def marker_reference_table(spark, folder):
    wide = source_wide(spark, folder)
    dropped = [marker_column(c.SOURCE_PREFIX, m, "evidence") for m in ONT.names]
    return reference_table(wide.drop(*dropped), KEY, c.SOURCE_PREFIX, ONT)


@query(f"{_COHORT} SELECT patient_id, marker, {', '.join(FIELDS)} FROM src")
def marker_round_trip(spark, folder):
    nested = markers_from_wide(source_wide(spark, folder), c.SOURCE_PREFIX, ONT)
    return markers_long(nested.select(KEY, "markers"))


_PROBLEM_ROW = "patient_id % 5"


@query(
    f"""{_COHORT}, raw AS (SELECT patient_id, marker, present,
    CASE WHEN {_PROBLEM_ROW} = 1 AND i = 2 THEN 1 ELSE negated END AS negated,
    CASE WHEN {_PROBLEM_ROW} = 2 AND i = 3 THEN 'amanha' ELSE temporality END AS temporality,
    CASE WHEN {_PROBLEM_ROW} = 3 AND i = 4 THEN '7' ELSE severity_code::VARCHAR END AS severity_code FROM src)
SELECT patient_id, coalesce(string_agg(CASE WHEN present = 1 AND negated = 1 THEN marker || '.present_and_negated'
   WHEN temporality = 'amanha' THEN marker || '.temporality' WHEN severity_code = '7' THEN marker || '.severity_code' END, ';'), '') AS violations
FROM raw GROUP BY patient_id"""
)
def marker_violations(spark, folder):
    def broken(m):
        row = F.col(KEY) % 5
        name = m["marker"]
        fields = {f: m[f].cast("string") for f in FIELDS}
        fields["negated"] = F.when((row == 1) & (name == ONT.names[2]), "1").otherwise(fields["negated"])
        fields["temporality"] = F.when((row == 2) & (name == ONT.names[3]), "amanha").otherwise(fields["temporality"])
        fields["severity_code"] = F.when((row == 3) & (name == ONT.names[4]), "7").otherwise(fields["severity_code"])
        record = F.to_json(F.struct(*[v.alias(f) for f, v in fields.items()]))
        return F.struct(name.alias("key"), record.alias("value"))

    raw = source(spark, folder).select(KEY, F.map_from_entries(F.transform("markers", broken)).alias("raw"))
    checked = normalize_markers(raw, "raw", ONT)
    return checked.select(KEY, F.array_join("violations", ";").alias("violations"))


def _replies(spark, folder) -> DataFrame:
    """JSON replies: fenced, plain, scalar, broken text, missing object, invalid record."""
    kind = F.col(KEY) % 6
    record = F.map_from_entries(
        F.transform(
            "markers",
            lambda m: F.struct(
                m["marker"].alias("key"),
                F.struct(
                    *[
                        (F.when((kind == 5) & (F.lit(f) == "certainty"), "talvez").otherwise(m[f]) if f == "certainty" else m[f]).alias(f)
                        for f in FIELDS
                    ]
                ).alias("value"),
            ),
        )
    )
    body = F.to_json(F.struct(record.alias("markers")))
    scalars = F.map_from_entries(
        F.transform("markers", lambda m: F.struct(m["marker"].alias("key"), m["present"].alias("value")))
    )
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.to_json(F.struct(scalars.alias("markers"))))
        .when(kind == 3, F.lit("not json"))
        .when(kind == 4, F.lit('{"answer": 1}'))
        .otherwise(body)
    )
    return source(spark, folder).select(KEY, reply.alias("reply"), (F.col(KEY) % 3).cast("int").alias("tries"))


@query(
    f"""{_COHORT}, v AS (SELECT patient_id, i, marker, patient_id % 6 AS kind, present, negated, remote_present, temporality, severity, severity_code, certainty, experiencer FROM src)
SELECT patient_id, 'reply-parser' AS extractor_id, CASE WHEN kind IN (0, 1, 2) THEN 'success' ELSE 'failed' END AS extraction_status,
  (patient_id % 3)::INT AS retry_count, marker,
  CASE WHEN kind IN (0, 1, 2) THEN present ELSE 0 END AS present,
  CASE WHEN kind IN (0, 1) THEN negated ELSE 0 END AS negated,
  CASE WHEN kind IN (0, 1) THEN remote_present ELSE 0 END AS remote_present,
  CASE WHEN kind IN (0, 1) THEN temporality ELSE 'nao_especificado' END AS temporality,
  CASE WHEN kind IN (0, 1) THEN severity WHEN kind = 2 AND present = 1 THEN 'leve' ELSE 'ausente' END AS severity,
  CASE WHEN kind IN (0, 1) THEN severity_code WHEN kind = 2 THEN present ELSE 0 END AS severity_code,
  CASE WHEN kind IN (0, 1) THEN certainty ELSE 'afirmado' END AS certainty,
  CASE WHEN kind IN (0, 1) THEN experiencer ELSE 'paciente' END AS experiencer
FROM v"""
)
def json_replies(spark, folder):
    parsed = parse_replies(
        _replies(spark, folder), KEY, "reply", ONT, {"extractor_id": "reply-parser"}, retries="tries"
    )
    return markers_long(parsed.drop("reply_hash")).drop("evidence")


@query(
    f"""{_COHORT} SELECT CASE WHEN patient_id % 6 IN (0, 1, 2) THEN 'success' ELSE 'failed' END AS extraction_status,
  count(*)::BIGINT AS n, sum(patient_id % 3)::BIGINT AS retries FROM acc GROUP BY 1"""
)
def reply_status_counts(spark, folder):
    parsed = parse_replies(
        _replies(spark, folder), KEY, "reply", ONT, {"extractor_id": "reply-parser"}, retries="tries"
    )
    return parsed.groupBy("extraction_status").agg(F.count("*").alias("n"), F.sum("retry_count").alias("retries"))


# --- rules, analytic sets, ranking, sweeps -------------------------------------------------

_RULE_COLUMNS = "urgent_rule_triggered, priority_high_evidence, priority_moderate_evidence, round(priority_score::DOUBLE, 6) AS priority_score"


@query(
    f"{_COHORT},{_rules_sql('src')} SELECT patient_id, {_LABEL_CASE.format('priority_code')} AS prioridade_referencia, priority_code AS prioridade_referencia_codigo, {_RULE_COLUMNS} FROM ruled"
)
def reference_priority(spark, folder):
    return rounded(reference(spark, folder), ["priority_score"])


@query(
    f"{_COHORT},{_rules_sql('src')} SELECT {_LABEL_CASE.format('priority_code')} AS prioridade_referencia, count(*)::BIGINT AS n FROM ruled GROUP BY 1"
)
def priority_distribution(spark, folder):
    from ..operators.quality import class_distribution

    return class_distribution(reference(spark, folder), "prioridade_referencia")


def _rule_input(spark, folder, markers: DataFrame, prefix: str) -> DataFrame:
    wide = markers_wide(markers.select(KEY, "markers"), prefix, ONT)
    base = profiles(spark, folder).select(KEY, "social_vulnerability").join(scores(spark, folder), KEY)
    return base.join(wide, KEY)


@query(
    f"""{_CHAIN},{_rules_sql('src', name='r1')},{_rules_sql('ext', name='r2')}
SELECT patient_id, r1.priority_code AS reference_code, r2.priority_code AS predicted_code FROM r1 JOIN r2 USING (patient_id)"""
)
def rule_baseline_extracted(spark, folder):
    found = _rule_input(spark, folder, extracted(spark, folder), c.EXTRACTED_PREFIX)
    predicted = rule_baseline(
        found, c.RULES, ONT, (c.EXTRACTED_PREFIX, c.SOURCE_PREFIX, c.CANONICAL_PREFIX)
    ).select(KEY, "predicted_code")
    truth = reference(spark, folder).select(KEY, F.col("prioridade_referencia_codigo").alias("reference_code"))
    return truth.join(predicted, KEY)


@query(
    f"""{_COHORT}, none AS (SELECT patient_id, i, marker, 0 AS present, 0 AS negated, 'afirmado' AS certainty, 'paciente' AS experiencer,
  'nao_especificado' AS temporality, 0 AS severity_code FROM src),{_rules_sql('none')} SELECT patient_id, priority_code AS predicted_code FROM ruled"""
)
def rule_baseline_without_markers(spark, folder):
    base = profiles(spark, folder).select(KEY, "social_vulnerability").join(scores(spark, folder), KEY)
    return rule_baseline(base, c.RULES, ONT, (c.EXTRACTED_PREFIX,)).select(KEY, "predicted_code")


@query(
    f"""{_COHORT},{_rules_sql('src')}, z AS (SELECT patient_id, priority_score + 0.5 * (
  sqrt(-2.0 * ln(1.0 - {sql.draw(7, "'label/r'", 'patient_id::VARCHAR')})) * cos(2.0 * pi() * {sql.draw(7, "'label/t'", 'patient_id::VARCHAR')})) AS sc,
  urgent_rule_triggered AS u FROM ruled)
SELECT patient_id, round(sc, 6) AS priority_score, CASE WHEN u = 1 THEN 3 WHEN sc >= 3.0 THEN 2 WHEN sc >= 1.2 THEN 1 ELSE 0 END AS priority_code FROM z"""
)
def noisy_priority(spark, folder):
    from dataclasses import replace

    table = _rule_input(spark, folder, source(spark, folder), c.SOURCE_PREFIX)
    noisy = replace(c.RULES, noise=0.5)
    scored = apply_rule_matrix(table, noisy, c.SOURCE_PREFIX, ONT, key=KEY, seed=7)
    return rounded(scored.select(KEY, "priority_score", "priority_code"), ["priority_score"])


def _sets(spark, folder, rate: float = 0.0) -> dict[str, DataFrame]:
    profile = profiles(spark, folder).join(source_wide(spark, folder), KEY)
    found = markers_wide(extracted(spark, folder).select(KEY, "markers"), c.EXTRACTED_PREFIX, ONT)
    return analytic_sets(
        profile,
        scores(spark, folder),
        reference(spark, folder),
        found,
        ANALYTIC,
        ONT,
        missing_rate=rate,
        seed=stage_seed(BASE_SEED, "missingness"),
        check=(),
    )


_ATTRIBUTES = "age_years, gender_category, education, social_vulnerability, income_brl, n_orders, n_open, n_urgent"
_SET_SQL = f"""SELECT p.patient_id, {_LABEL_CASE.format('r.priority_code')} AS prioridade_referencia,
  r.priority_code AS prioridade_referencia_codigo, r.urgent_rule_triggered, p.age_years, p.gender_category, p.education,
  p.social_vulnerability, p.income_brl, p.n_orders, p.n_open, p.n_urgent, s.phq9_total, s.gad7_total, s.idate_estado_total"""
_SET_JOIN = "FROM prof p JOIN sco s USING (patient_id) JOIN ruled r USING (patient_id)"


@query(
    f"{_CHAIN},{_rules_sql('src')}, w AS ({sql.wide_select('ext', KEY, c.CANONICAL_PREFIX, ONT, FEATURE_FIELDS)}) {_SET_SQL}, w.* EXCLUDE (patient_id) {_SET_JOIN} JOIN w USING (patient_id)"
)
def analytic_set_extracted(spark, folder):
    return _sets(spark, folder)["extracted"]


@query(
    f"{_COHORT},{_rules_sql('src')}, w AS ({sql.wide_select('src', KEY, c.CANONICAL_PREFIX, ONT, FEATURE_FIELDS)}) {_SET_SQL}, w.* EXCLUDE (patient_id) {_SET_JOIN} JOIN w USING (patient_id)"
)
def analytic_set_source(spark, folder):
    return _sets(spark, folder)["source"]


def _mask(column: str) -> str:
    u = sql.draw(stage_seed(BASE_SEED, "missingness"), f"'{column}'", "p.patient_id::VARCHAR")
    return f"CASE WHEN {u} >= {MISSING_RATE} THEN {column} END AS {column}"


_MASKED = ", ".join(
    _mask(x)
    for x in (
        "age_years",
        "gender_category",
        "education",
        "social_vulnerability",
        "income_brl",
        "n_orders",
        "n_open",
        "n_urgent",
        "phq9_total",
        "gad7_total",
        "idate_estado_total",
    )
)


@query(
    f"{_COHORT},{_rules_sql('src')} SELECT p.patient_id, {_LABEL_CASE.format('priority_code')} AS prioridade_referencia, priority_code AS prioridade_referencia_codigo, urgent_rule_triggered, {_MASKED} FROM (SELECT * EXCLUDE (patient_id), p.patient_id FROM prof p JOIN sco s USING (patient_id) JOIN ruled r USING (patient_id)) p"
)
def analytic_set_missing(spark, folder):
    return _sets(spark, folder, MISSING_RATE)["base"]


_PRED_RAW = ", ".join(
    f"1.0::DOUBLE + (patient_id * {k + 3} + n_orders * 5 + n_urgent * {k}) % 17 AS q{k}" for k in range(4)
)
_PRED = f"""pred AS (
  SELECT patient_id, {', '.join(f'q{k} / (q0 + q1 + q2 + q3) AS proba_{k}' for k in range(4))},
    (list_position([q0, q1, q2, q3], greatest(q0, q1, q2, q3)) - 1)::INT AS code
  FROM (SELECT patient_id, {_PRED_RAW} FROM acc))"""
_TITLE = "CASE {0} WHEN 0 THEN 'Baixa' WHEN 1 THEN 'Moderada' WHEN 2 THEN 'Alta' ELSE 'Urgente' END"
_SIGNAL_I = [ONT.names.index(m) for m in c.SIGNAL_TITLES]
_SIGNALS = ", ".join(
    f"max(CASE WHEN i = {i} AND present = 1 THEN '{t}' END) AS t{i}" for i, t in zip(_SIGNAL_I, c.SIGNAL_TITLES.values())
)


@query(
    f"""{_CHAIN},{_rules_sql('src')},{_PRED},
sig AS (SELECT patient_id, max(CASE WHEN i = 9 THEN severity_code END) AS fs, concat_ws('; ', {', '.join(f't{i}' for i in _SIGNAL_I)}) AS sg
  FROM (SELECT patient_id, {_SIGNALS}, max(CASE WHEN i = 9 THEN i END) AS i, max(CASE WHEN i = 9 THEN severity_code END) AS severity_code FROM ext GROUP BY patient_id) GROUP BY ALL)
SELECT row_number() OVER (ORDER BY 3 - code, proba_2 + proba_3 DESC, proba_3 DESC, patient_id)::BIGINT AS "Posição",
  patient_id AS "ID do perfil sintético", {_TITLE.format('code')} AS "Prioridade prevista",
  {_TITLE.format('priority_code')} AS "Prioridade de referência simulada",
  CASE WHEN code = priority_code THEN 'Sim' ELSE 'Não' END AS "Concorda com a referência simulada?",
  printf('%.1f%%', round_even(100.0 * (proba_2 + proba_3) * 10.0, 0) / 10.0) AS "Probabilidade alta/urgente",
  printf('%.1f%%', round_even(100.0 * proba_3 * 10.0, 0) / 10.0) AS "Probabilidade urgente",
  age_years AS "Idade", CASE gender_category WHEN 'feminino' THEN 'Feminino' WHEN 'masculino' THEN 'Masculino' ELSE 'Outro ou não informado' END AS "Categoria de gênero",
  round_even(social_vulnerability * 100, 0) / 100 AS "Vulnerabilidade social", phq9_total AS "PHQ-9", gad7_total AS "GAD-7",
  idate_estado_total AS "IDATE-Estado", CASE fs WHEN 0 THEN 'Ausente' WHEN 1 THEN 'Leve' WHEN 2 THEN 'Moderado' ELSE 'Importante' END AS "Comprometimento funcional extraído",
  CASE WHEN sg = '' THEN '{c.NO_SIGNAL}' ELSE sg END AS "Sinais de atenção extraídos"
FROM pred JOIN prof USING (patient_id) JOIN sco USING (patient_id) JOIN ruled USING (patient_id) JOIN sig USING (patient_id)"""
)
def ranked_classification(spark, folder):
    truth = reference(spark, folder).select(KEY, "prioridade_referencia", "prioridade_referencia_codigo")
    predicted = predictions(spark, folder).join(truth, KEY)
    found = markers_wide(extracted(spark, folder).select(KEY, "markers"), c.EXTRACTED_PREFIX, ONT)
    return ranked_table(
        profiles(spark, folder),
        scores(spark, folder),
        found,
        predicted,
        RANKED,
        include_reference=True,
        check=(),
    )


@query(
    f"""{_CHAIN},{_rules_sql('src')},{_PRED}
SELECT patient_id, code AS prioridade_prevista_codigo, {BASE_SEED} AS seed, '{c.TEMPLATE_ID}' AS generator_id,
  '{c.PROMPT_VERSION}' AS prompt_version_generation, '{c.EXTRACTOR_ID}' AS extractor_id, 'ontology_v2' AS ontology_version,
  'p1' AS prompt_version_extraction, 'success' AS extraction_status, 0 AS retry_count, round(priority_score::DOUBLE, 6) AS priority_score,
  urgent_rule_triggered, 'run-1' AS run_id, '{c.RULES.version}' AS priority_rule_version, 'rules' AS extraction_provider,
  'extracted' AS dataset, 'baseline' AS selected_model FROM pred JOIN ruled USING (patient_id)"""
)
def prediction_lineage(spark, folder):
    found = extracted(spark, folder).withColumn("prompt_version", F.lit("p1"))
    out = lineage(
        predictions(spark, folder).select(KEY, "prioridade_prevista_codigo"),
        [
            (profiles(spark, folder), ["seed"], None),
            (notes(spark, folder), ["generator_id", "prompt_version", "absent_column"], None),
            (
                found,
                ["extractor_id", "ontology_version", "model_id", "prompt_version", "extraction_status", "retry_count"],
                ("_generation", "_extraction"),
            ),
            (reference(spark, folder), ["priority_score", "urgent_rule_triggered"], None),
        ],
        KEY,
        {
            "run_id": "run-1",
            "priority_rule_version": c.RULES.version,
            "extraction_provider": "rules",
            "dataset": "extracted",
            "selected_model": "baseline",
        },
        check=(),
    )
    return rounded(out, ["priority_score"])


_CRITICAL = ", ".join(f"'{m}'" for m in c.CRITICAL_MARKERS)
_ANNOT_SEED = stage_seed(BASE_SEED, "annotation")
_PER_LABEL = 15


def _annotation_sample(spark, folder) -> DataFrame:
    """Key, label and critical flag of the chosen records; notes join only the form."""
    critical = F.exists(
        "markers", lambda m: m["marker"].isin(*c.CRITICAL_MARKERS) & (m["present"] == 1)
    ).cast("int")
    audit = source(spark, folder).select(KEY, critical.alias("critical_case"))
    truth = reference(spark, folder).select(KEY, "prioridade_referencia")
    everything = truth.join(audit, KEY)
    sample = stratified_sample(everything, KEY, "prioridade_referencia", _PER_LABEL, _ANNOT_SEED)
    size = _PER_LABEL * len(c.LABELS)
    return with_critical_row(sample, everything, KEY, "critical_case", _ANNOT_SEED, size)


_SAMPLE = f"""crit AS (SELECT patient_id, max(CASE WHEN marker IN ({_CRITICAL}) THEN present ELSE 0 END)::INT AS critical_case FROM src GROUP BY patient_id),
smp AS (SELECT patient_id, priority_code, critical_case FROM (
  SELECT *, row_number() OVER (PARTITION BY priority_code ORDER BY {sql.draw(_ANNOT_SEED, "'sample'", 'patient_id::VARCHAR')}, patient_id) AS rn
  FROM ruled JOIN crit USING (patient_id)) WHERE rn <= {_PER_LABEL})"""


@query(
    f"{_COHORT},{_rules_sql('src')},{_SAMPLE} SELECT patient_id, {_LABEL_CASE.format('priority_code')} AS prioridade_referencia, critical_case FROM smp"
)
def annotation_audit(spark, folder):
    _, audit = visible_and_audit(
        _annotation_sample(spark, folder), [KEY], [KEY, "prioridade_referencia", "critical_case"]
    )
    return shuffled(audit, KEY, _ANNOT_SEED)


_BLANK_FIELDS = [f"{m}_{f}" for m in ONT.names for f in FIELDS] + ["annotator_id", "notes"]


@query(
    f"{_COHORT},{_note_sql('notes')},{_rules_sql('src')},{_SAMPLE} SELECT patient_id, note, {', '.join(chr(39) * 2 + ' AS ' + f for f in _BLANK_FIELDS)} FROM smp JOIN notes USING (patient_id)"
)
def annotation_form(spark, folder):
    chosen = _annotation_sample(spark, folder).select(KEY)
    shown = notes(spark, folder).select(KEY, "note").join(chosen, KEY)
    return blank_form(shuffled(shown, KEY, _ANNOT_SEED), [KEY, "note"], _BLANK_FIELDS)


_TOPUP_SEED = 41


@query(
    f"""WITH {ACCOUNTS_SQL}, b AS (SELECT patient_id, n_open % 3 AS g, (patient_id % 101 = 7)::INT AS flag FROM acc),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {sql.draw(_TOPUP_SEED, "'sample'", 'patient_id::VARCHAR')}, patient_id) AS rn FROM b WHERE flag = 0) WHERE rn <= 4),
x AS (SELECT * FROM b WHERE flag = 1 ORDER BY {sql.draw(_TOPUP_SEED, "'critical'", 'patient_id::VARCHAR')}, patient_id LIMIT 1)
SELECT patient_id, g, flag FROM s UNION ALL SELECT patient_id, g, flag FROM x"""
)
def critical_topup(spark, folder):
    base = accounts(spark, folder).select(
        KEY, (F.col("n_open") % 3).alias("g"), (F.col(KEY) % 101 == 7).cast("int").alias("flag")
    )
    sample = stratified_sample(base.where("flag = 0"), KEY, "g", 4, _TOPUP_SEED)
    return with_critical_row(sample, base, KEY, "flag", _TOPUP_SEED, 4 * 3)


@query(
    f"WITH {ACCOUNTS_SQL} SELECT patient_id, n_orders FROM acc ORDER BY {sql.draw(5, chr(39) + 'rows' + chr(39), 'patient_id::VARCHAR')}, patient_id LIMIT 50"
)
def random_subset(spark, folder):
    return random_rows(accounts(spark, folder).select(KEY, "n_orders"), KEY, 50, 5)


@query(
    f"{_COHORT} SELECT marker, sum(present)::BIGINT AS n_before, sum(CASE WHEN {sql.draw(9, 'marker', 'patient_id::VARCHAR')} < 0.1 THEN 1 - present ELSE present END)::BIGINT AS n_after FROM src GROUP BY marker"
)
def flip_noise(spark, folder):
    long = markers_long(source(spark, folder))
    noisy = long.withColumn("after", flipped("present", KEY, 0.1, 9, F.col("marker")))
    return noisy.groupBy("marker").agg(F.sum("present").alias("n_before"), F.sum("after").alias("n_after"))


SCENARIOS = [
    {"scenario": "baseline_seed_1", "seed": 1, "flip": 0.0, "missing": 0.0, "omission": 0.0, "high": 3.0, "moderate": 1.2},
    {"scenario": "extraction_error_10pct", "seed": 2, "flip": 0.1, "missing": 0.0, "omission": 0.0, "high": 3.0, "moderate": 1.2},
    {"scenario": "missingness_10pct", "seed": 3, "flip": 0.0, "missing": 0.1, "omission": 0.0, "high": 3.0, "moderate": 1.2},
    {"scenario": "narrative_omission_10pct", "seed": 4, "flip": 0.0, "missing": 0.0, "omission": 0.1, "high": 3.0, "moderate": 1.2},
    {"scenario": "priority_thresholds_stricter", "seed": 5, "flip": 0.0, "missing": 0.0, "omission": 0.0, "high": 3.4, "moderate": 1.5},
]


def _sweep_sql() -> str:
    rows = ", ".join(
        f"('{s['scenario']}', {s['seed']}, {s['flip']}::DOUBLE, {s['missing']}::DOUBLE, {s['omission']}::DOUBLE, {s['high']}::DOUBLE, {s['moderate']}::DOUBLE)"
        for s in SCENARIOS
    )

    def u(salt: str) -> str:
        return f"(('0x'||substr(md5(sc.seed::VARCHAR||'|'||{salt}||'|'||x.patient_id::VARCHAR),1,13))::BIGINT / 4503599627370496.0)"

    act = sql.active("y", ONT)
    flags = ", ".join(f"max(CASE WHEN i = {i} THEN {act} END) AS a{i}" for i in range(10))
    masked = ", ".join(
        f"CASE WHEN {u(chr(39) + col + chr(39))} >= sc.missing THEN {col} ELSE 0 END AS {col}"
        for col in ("phq9_total", "gad7_total", "idate_estado_total", "social_vulnerability")
    )
    t = c.THRESHOLDS
    return f"""{_COHORT}, sc(scenario, seed, flip, missing, omission, high, moderate) AS (VALUES {rows}),
mk0 AS (SELECT sc.scenario, x.patient_id, x.i, x.negated, x.certainty, x.experiencer, x.temporality, x.severity_code,
  CASE WHEN {u("'omit/'||x.marker")} < sc.omission THEN 0 ELSE x.present END AS p0, {u("'flip/'||x.marker")} < sc.flip AS fl FROM src x CROSS JOIN sc),
mk AS (SELECT * EXCLUDE (negated), CASE WHEN fl THEN 1 - p0 ELSE p0 END AS present,
  CASE WHEN fl AND p0 = 0 THEN 0 ELSE negated END AS negated FROM mk0),
sw_a AS (SELECT scenario, patient_id, {flags}, max(CASE WHEN i = 9 THEN severity_code * {act} END) AS fs FROM mk y GROUP BY ALL),
ms AS (SELECT sc.scenario, sc.high, sc.moderate, x.patient_id, {masked} FROM (SELECT * FROM sco JOIN prof USING (patient_id)) x CROSS JOIN sc),
ev AS (SELECT scenario, patient_id, high, moderate, ((a0 = 1 AND a1 = 1) OR a2 = 1 OR a3 = 1 OR (a4 = 1 AND fs >= 3)) AS urg,
  0.85 * ((phq9_total >= {t['phq_high']})::INT + (gad7_total >= {t['gad_high']})::INT + (idate_estado_total >= {t['stai_high']})::INT + (fs >= 2)::INT
    + a5 + a7 + (social_vulnerability >= {t['vulnerability_high']})::INT + a8)
  + 0.35 * ((phq9_total >= {t['phq_moderate']})::INT + (gad7_total >= {t['gad_moderate']})::INT + (idate_estado_total >= {t['stai_moderate']})::INT + (fs >= 1)::INT + a7 + a8) AS score
  FROM sw_a JOIN ms USING (scenario, patient_id))
SELECT scenario, CASE WHEN urg THEN 'urgente' WHEN score >= high THEN 'alta' WHEN score >= moderate THEN 'moderada' ELSE 'baixa' END AS priority_label,
  count(*)::BIGINT AS n, round(sum(score)::DOUBLE, 4) AS score_sum FROM ev GROUP BY ALL"""


@query(_sweep_sql())
def scenario_sweep(spark, folder):
    """All scenarios in one job: parameters are columns, perturbations are row expressions."""
    acc = source_markers(accounts(spark, folder))
    base = (
        profiles(spark, folder)
        .select(KEY, "social_vulnerability")
        .join(scores(spark, folder), KEY)
        .join(acc.select(KEY, "markers"), KEY)
    )
    swept = scenario_rows(base, SCENARIOS)

    def perturbed(m):
        kept = F.when(uniform(F.col("seed"), KEY, F.concat(F.lit("omit/"), m["marker"])) < F.col("omission"), 0).otherwise(
            m["present"]
        )
        flip = uniform(F.col("seed"), KEY, F.concat(F.lit("flip/"), m["marker"])) < F.col("flip")
        fields = {f: m[f] for f in FIELDS}
        fields["present"] = F.when(flip, 1 - kept).otherwise(kept)
        fields["negated"] = F.when(flip & (kept == 0), 0).otherwise(m["negated"])
        return F.struct(m["marker"].alias("marker"), *[v.alias(f) for f, v in fields.items()])

    noisy = swept.withColumn("markers", F.transform("markers", perturbed)).withColumns(
        {
            col: F.when(uniform(F.col("seed"), KEY, col) >= F.col("missing"), F.col(col))
            for col in (*c.SCORES, "social_vulnerability")
        }
    )
    wide = markers_wide(noisy, c.SOURCE_PREFIX, ONT)
    matrix = c.RULES.with_thresholds(
        high_priority_cutoff="high", moderate_priority_cutoff="moderate"
    )
    scored = apply_rule_matrix(wide, matrix, c.SOURCE_PREFIX, ONT)
    out = scored.groupBy("scenario", "priority_label").agg(
        F.count("*").alias("n"), F.sum("priority_score").alias("score_sum")
    )
    return rounded(out, ["score_sum"], 4)

