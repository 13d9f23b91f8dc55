"""Extractors as columns of one row, section replies, critical top-up, grouped calibration."""

import pytest
from pyspark.sql import functions as F

from noteframe.operators import class_eval as ce
from noteframe.operators import sampling as sm
from noteframe.operators.extraction import Variant, extract_markers, extract_variants
from noteframe.operators.extraction_eval import stability
from noteframe.operators.markers import paired_columns, paired_markers, parse_section_replies
from noteframe.presets import web

TEXTS = [
    (1, "You are an idiot. Licensed under MIT."),
    (2, "he was trash. Call +1 (212) 555-1234 or write a.b@mail.com."),
    (3, None),
    (4, ""),
    (5, "nicht gut. ### der loser ist hier."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


@pytest.mark.parametrize("prefilter", [False, True])
def test_variants_equal_single_extractions(docs, prefilter):
    found = [Variant("wide", web.ONTOLOGY), Variant("narrow", web.NARROW), Variant("noisy", web.ONTOLOGY, 0.5, 9)]
    together = {r["doc_id"]: r for r in extract_variants(docs, "doc_id", "text", found, document_prefilter=prefilter).collect()}
    assert len(together) == len(TEXTS)
    for v in found:
        alone = extract_markers(docs, "doc_id", "text", v.ontology, flip_rate=v.flip_rate, seed=v.seed)
        for row in alone.collect():
            assert together[row["doc_id"]][v.name] == row["markers"]


def test_paired_columns_equal_the_join(docs):
    found = [Variant("wide", web.ONTOLOGY), Variant("narrow", web.NARROW)]
    rows = extract_variants(docs, "doc_id", "text", found)
    got = paired_columns(rows, "doc_id", "wide", ["narrow"]).drop("extractor")
    wide = extract_markers(docs, "doc_id", "text", web.ONTOLOGY)
    narrow = extract_markers(docs, "doc_id", "text", web.NARROW)
    expected = paired_markers(wide, narrow, "doc_id")
    assert sorted(map(repr, got.select(expected.columns).collect())) == sorted(map(repr, expected.collect()))


def test_stability_counts_null_as_equal(docs):
    runs = [Variant("b", web.ONTOLOGY), Variant("a", web.ONTOLOGY, 1.0, 1)]
    rows = {(r["run_a"], r["run_b"], r["marker"], r["dimension"]): r for r in stability(extract_variants(docs, "doc_id", "text", runs), ["b", "a"]).collect()}
    assert {k[:2] for k in rows} == {("a", "b")}
    assert rows["a", "b", "insult", "present"]["agreement"] == 0.0
    assert rows["a", "b", "insult", "remote_present"]["agreement"] == 1.0
    assert rows["a", "b", "insult", "present"]["n"] == len(TEXTS)


def test_section_replies(spark):
    rows = [
        (1, '```json\n{"plan": "Plan:  rest  now", "note": "ok"}\n```'),
        (2, '{"plan": "rest"}'),
        (3, '{"plan": " ", "note": ""}'),
        (4, "[1]"),
        (5, "no json"),
        (6, None),
    ]
    df = spark.createDataFrame(rows, "id long, reply string")
    out = {r["id"]: r for r in parse_section_replies(df, "id", "reply", {"plan": (), "note": ("n",)}).collect()}
    assert (out[1]["status"], out[1]["plan"], out[1]["note"]) == ("success", "rest now", "ok")
    assert (out[2]["status"], out[2]["faults"], out[2]["plan"]) == ("failed", ["note"], "")
    assert out[3]["faults"] == ["plan", "note"]
    assert all(out[i]["faults"] == ["reply"] for i in (4, 5, 6))


@pytest.mark.parametrize("flags, added", [((0, 0, 0, 1, 1), 1), ((1, 0, 0, 1, 1), 0), ((0, 0, 0, 0, 0), 0)])
def test_critical_row_is_added_once(spark, flags, added):
    everything = spark.createDataFrame(list(enumerate(flags)), "k long, flag int")
    sample = everything.where("k < 3")
    got = sorted(r["k"] for r in sm.with_critical_row(sample, everything, "k", "flag", 7, 3).collect())
    assert got[:3] == [0, 1, 2] and len(got) == 3 + added


def test_calibration_by_group_equals_each_group_alone(spark):
    rows = [(i, ("a", "b", "one")[i % 3], 3 if i % 3 == 2 or i % 7 < 2 + i % 3 else 0, 0.05 + (i * 37 % 90) / 100) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, y int, p3 double").select(
        "*", F.lit(0.0).alias("p2"), (1 - F.col("p3")).alias("p0"), F.lit(0.0).alias("p1"), F.lit(2).alias("w")
    )
    probs = ["p0", "p1", "p2", "p3"]
    grouped = {r["g"]: r for r in ce.calibration_fit(df, "y", probs, 2, ["g"], "w").collect()}
    for g in ("a", "b"):
        alone = ce.calibration_fit(df.where(F.col("g") == g), "y", probs, 2).first()
        assert grouped[g]["calibration_slope"] == pytest.approx(alone["calibration_slope"], abs=1e-8)
        assert grouped[g]["calibration_intercept"] == pytest.approx(alone["calibration_intercept"], abs=1e-8)
    assert grouped["one"]["calibration_slope"] is None
