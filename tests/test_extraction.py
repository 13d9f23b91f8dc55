"""Hand-made extraction cases, perturbation and partition independence."""

import pytest
from pyspark.sql import functions as F

from noteframe.operators.extraction import extract_markers
from noteframe.operators.markers import (
    FIELDS,
    markers_from_wide,
    markers_long,
    markers_wide,
    normalize_markers,
    parse_replies,
    quarantine,
    strict,
)
from noteframe.presets.clinical import ONTOLOGY

NONE = "nao_especificado"
CASES = [
    ("Paciente apresenta ideação suicida atualmente.", "ideacao_suicida", 1, 0, 0, "atual", "leve", 1, "afirmado", "paciente"),
    ("Paciente nega ideação suicida atualmente.", "ideacao_suicida", 0, 1, 0, "atual", "ausente", 0, "afirmado", "paciente"),
    (
        "Paciente apresentou ideação suicida no passado. Paciente nega ideação suicida atualmente.",
        "ideacao_suicida", 0, 1, 1, "atual", "ausente", 0, "afirmado", "paciente",
    ),
    ("Um familiar apresenta sintomas psicóticos atualmente.", "sintomas_psicoticos", 1, 0, 0, "atual", "leve", 1, "afirmado", "terceiro"),
    (
        "Paciente possivelmente apresenta uso problemático de substâncias atualmente.",
        "uso_problematico_substancias", 1, 0, 0, "atual", "leve", 1, "incerto", "paciente",
    ),
    ("Paciente nega internação prévia no passado.", "internacao_previa", 0, 0, 0, NONE, "ausente", 0, "afirmado", "paciente"),
    ("Paciente apresenta internação prévia.", "internacao_previa", 1, 0, 1, "remoto", "leve", 1, "afirmado", "paciente"),
    (
        "Paciente relata dificuldade moderada para manter atividades cotidianas.",
        "comprometimento_funcional", 1, 0, 0, NONE, "moderado", 2, "afirmado", "paciente",
    ),
    ("Paciente apresenta autoagressão iminente atualmente.", "autoagressao_iminente", 1, 0, 0, "atual", "alto", 3, "afirmado", "paciente"),
    ("PACIENTE NEGA IDEAÇÃO SUICIDA.\nApresenta Ideação Suicida hoje.", "ideacao_suicida", 1, 0, 0, NONE, "leve", 1, "afirmado", "paciente"),
    ("Há ideação ſuicida agora.", "ideacao_suicida", 1, 0, 0, NONE, "leve", 1, "afirmado", "paciente"),
    (None, "ideacao_suicida", 0, 0, 0, NONE, "ausente", 0, "afirmado", "paciente"),
]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "patient_id long, note string")


@pytest.fixture(scope="module")
def found(notes):
    return extract_markers(notes, "patient_id", "note", ONTOLOGY)


def test_hand_made_cases(found):
    rows = {(r["patient_id"], r["marker"]): r for r in markers_long(found).collect()}
    names = ("present", "negated", "remote_present", "temporality", "severity", "severity_code", "certainty", "experiencer")
    for i, case in enumerate(CASES):
        row = rows[(i, case[1])]
        assert tuple(row[n] for n in names) == case[2:], case[0]
    assert rows[(2, "ideacao_suicida")]["evidence"] == (
        "paciente nega ideação suicida atualmente. | paciente apresentou ideação suicida no passado."
    )


def test_every_key_has_every_marker(found):
    assert markers_long(found).count() == len(CASES) * len(ONTOLOGY.markers)


def test_prefilter_and_partitions_do_not_matter(notes, found):
    base = {r["patient_id"]: r["markers"] for r in found.collect()}
    for other in (notes.repartition(1), notes.repartition(37)):
        again = extract_markers(other, "patient_id", "note", ONTOLOGY, document_prefilter=True)
        flagged = {r["patient_id"]: r["markers"] for r in again.collect()}
        for key, markers in base.items():
            got = flagged[key]
            assert [m.asDict() for m in got] == [m.asDict() for m in markers]


def test_flip_rate(notes, found):
    same = extract_markers(notes, "patient_id", "note", ONTOLOGY, flip_rate=0.0, seed=3)
    assert same.select("patient_id", "markers").exceptAll(found.select("patient_id", "markers")).count() == 0
    every = markers_long(extract_markers(notes, "patient_id", "note", ONTOLOGY, flip_rate=1.0, seed=3))
    flipped = {(r["patient_id"], r["marker"]): r for r in every.collect()}
    row = flipped[(11, "ideacao_suicida")]
    assert (row["present"], row["severity"], row["severity_code"], row["temporality"], row["evidence"]) == (1, "leve", 1, NONE, "")
    row = flipped[(0, "ideacao_suicida")]
    assert (row["present"], row["severity_code"], row["temporality"]) == (0, 0, "atual")


def test_wide_and_nested_round_trip(found):
    wide = markers_wide(found.select("patient_id", "markers"), "m_", ONTOLOGY)
    assert len(wide.columns) == 1 + len(ONTOLOGY.markers) * len(FIELDS)
    back = markers_from_wide(wide, "m_", ONTOLOGY, problems="wrong")
    assert back.where(F.size("wrong") > 0).count() == 0
    assert back.select("patient_id", "markers").exceptAll(found.select("patient_id", "markers")).count() == 0


def test_contract_violations(spark):
    raw = spark.createDataFrame(
        [
            (1, {"ideacao_suicida": '{"present": 1, "negated": 1}'}),
            (2, {"risco_violencia": '{"temporality": "ontem"}'}),
            (3, {"comprometimento_funcional": "3"}),
            (4, {"risco_violencia": "9"}),
            (5, {}),
        ],
        "k int, raw map<string,string>",
    )
    checked = normalize_markers(raw, "raw", ONTOLOGY)
    wrong = {r["k"]: r["violations"] for r in checked.collect()}
    assert wrong[1] == ["ideacao_suicida.present_and_negated"]
    assert wrong[2] == ["risco_violencia.temporality"]
    assert wrong[3] == [] and wrong[5] == []
    # A marker without grades reads any positive scalar as presence.
    assert wrong[4] == []
    graded = {r["k"]: r["markers"][9] for r in checked.collect()}[3]
    assert (graded["present"], graded["severity"], graded["severity_code"]) == (1, "importante", 3)
    good, bad = quarantine(checked)
    assert (good.count(), bad.count()) == (3, 2)
    with pytest.raises(Exception, match="invalid markers"):
        strict(checked).collect()


def test_replies(spark):
    record = (
        '{"present":0,"negated":1,"remote_present":1,"temporality":"atual","severity":"ausente",'
        '"severity_code":0,"certainty":"afirmado","experiencer":"paciente","evidence":" nega "}'
    )
    replies = spark.createDataFrame(
        [
            ("SYN-1", '```json\n{"markers": {"ideacao_suicida": %s}}\n```' % record),
            ("SYN-2", '{"markers": [1]}'),
            ("SYN-3", None),
            ("SYN-4", '{"markers": {"ideacao_suicida": {"severity_code": 8}}}'),
        ],
        "patient_id string, reply string",
    )
    parsed = {r["patient_id"]: r for r in parse_replies(replies, "patient_id", "reply", ONTOLOGY, {"model_id": "m"}).collect()}
    assert [parsed[f"SYN-{i}"]["extraction_status"] for i in (1, 2, 3, 4)] == ["success", "failed", "failed", "failed"]
    first = parsed["SYN-1"]["markers"][0]
    assert (first["remote_present"], first["negated"], first["evidence"]) == (1, 1, "nega")
    assert parsed["SYN-4"]["markers"][0]["severity_code"] == 0
