"""Contracts, joins, rules, ranking, quality, sampling and file sources on literal rows."""

import pytest
from pyspark.sql import functions as F

from noteframe.functions import scalar as sc
from noteframe.functions import text as tx
from noteframe.functions.hashing import stage_seed
from noteframe.operators import joins as jn
from noteframe.operators import quality as ql
from noteframe.operators import ranking as rk
from noteframe.operators import sampling as sm
from noteframe.operators.contracts import (
    forbidden_json_paths,
    forbidden_schema_paths,
    lookup,
    refuse_label_columns,
    require_columns,
    require_symmetric,
)
from noteframe.operators.extraction_eval import annotator_agreement
from noteframe.operators.features import analytic_sets
from noteframe.operators.markers import (
    FEATURE_FIELDS,
    FIELDS,
    marker_column,
    markers_from_wide,
    markers_wide,
    normalize_markers,
)
from noteframe.operators.rendering import render_notes
from noteframe.operators.rules import RULE_OUTPUTS, apply_rule_matrix, rule_baseline
from noteframe.plans.clinical import ANALYTIC, NOTE, RANKED
from noteframe.presets import clinical as c
from noteframe.sources import tables as io


def _empty_wide(spark, prefix, changes=None):
    """One row of wide markers with defaults, some fields changed."""
    df = spark.createDataFrame([("SYN-1",)], "patient_id string")
    wide = markers_wide(markers_from_wide(df, "none_", c.ONTOLOGY), prefix, c.ONTOLOGY)
    for (marker, name), value in (changes or {}).items():
        wide = wide.withColumn(marker_column(prefix, marker, name), F.lit(value))
    return wide


def test_column_contracts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match=r"\['c', 'd'\]"):
        require_columns(df, ["a", "c", "d"], "t")
    with pytest.raises(ValueError, match="left missing"):
        require_symmetric(df, ["x"], ["a"])
    with pytest.raises(ValueError, match="Prioridade_x"):
        refuse_label_columns(df.withColumn("Prioridade_x", F.lit(1)))
    nested = df.select(F.struct(F.array(F.struct(F.lit(1).alias(" Label ")))).alias("s"))
    assert forbidden_schema_paths(nested.schema) == ["s.col1[]. Label "]
    text = df.select(F.lit('{"contexto": {"prioridade_referencia": "alta"}, "x": [{"Yhat": 1}]}').alias("t"))
    assert text.select(forbidden_json_paths("t")).first()[0] == ["contexto.prioridade_referencia", "x[0].Yhat"]


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, v string")
    with pytest.raises(Exception, match="right side: repeated values of k: 1"):
        jn.join_one_to_one(a, b, "k").collect()
    with pytest.raises(Exception, match="rows without a match: 1"):
        jn.refuse_orphans(a, b, "k", "a").collect()
    left, right = jn.with_suffixes(a.withColumn("w", F.lit(1)), b, "k", ("_a", "_b"))
    assert left.columns == ["k", "v_a", "w"] and right.columns == ["k", "v_b"]
    assert [r["k"] for r in jn.anti_join(a, b, "k").collect()] == [2]
    assert lookup(a, "k", 2).first()["v"] == "y"
    with pytest.raises(Exception, match="key not found: 7"):
        lookup(a, "k", 7).collect()


def test_bands_and_numbers(spark):
    df = spark.createDataFrame([(-2,), (0,), (4,), (5,), (27,), (28,), (None,)], "v int")
    assert [r[0] for r in df.select(sc.cut_right("v", *c.PHQ_BANDS)).collect()] == [
        None, "minimo", "minimo", "leve", "grave", None, None,
    ]
    assert [r[0] for r in df.select(sc.digitize_left("v", [0, 5])).collect()] == [0, 1, 1, 2, 2, 2, None]
    values = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "t string")
    assert [r[0] for r in values.select(sc.number_or("t", 7)).collect()] == [1.5, 7.0, 7.0, 7.0]
    constant = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r[0] for r in constant.select(sc.min_max(constant, "x")).collect()] == [0.5, 0.5]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in halves.select(sc.round_half_even("x")).collect()] == [0.0, 2.0, 2.0]
    with pytest.raises(ValueError):
        sc.weighted_index([(F.lit(1), 0.5), (F.lit(1), 0.6)])
    assert stage_seed(10, "label", 2) == 3012


def test_sentences(spark):
    df = spark.createDataFrame([("Um. Dois!  Três?\nQuatro\t\n\n fim",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.sentences("t")).collect()] == [["um.", "dois!", "três?", "quatro", "fim"], [], []]


def test_rule_matrix_and_prefixes(spark):
    changes = {
        ("ideacao_suicida", "present"): 1,
        ("ideacao_suicida", "temporality"): "atual",
        ("planejamento_suicida", "present"): 1,
        ("planejamento_suicida", "temporality"): "atual",
    }
    for prefix in (c.SOURCE_PREFIX, c.EXTRACTED_PREFIX):
        df = _empty_wide(spark, prefix, changes).selectExpr(
            "*", "5 AS phq9_total", "4 AS gad7_total", "35 AS idate_estado_total", "0.2D AS social_vulnerability"
        )
        row = apply_rule_matrix(df, c.RULES, prefix, c.ONTOLOGY).select(*RULE_OUTPUTS).first()
        assert row.asDict() == {
            "priority_label": "urgente", "priority_code": 3, "urgent_rule_triggered": 1,
            "priority_high_evidence": 0, "priority_moderate_evidence": 0, "priority_score": 0.0,
        }
    bare = spark.createDataFrame([(22, 16, 70, 0.9)], "phq9_total int, gad7_total int, idate_estado_total int, social_vulnerability double")
    assert rule_baseline(bare, c.RULES, c.ONTOLOGY, (c.EXTRACTED_PREFIX,)).first()["predicted_code"] == 2
    none = bare.select(*[F.lit(None).cast("double").alias(n) for n in bare.columns])
    assert rule_baseline(none, c.RULES, c.ONTOLOGY, ()).first()["predicted_code"] == 0
    from dataclasses import replace

    with pytest.raises(ValueError, match="seed"):
        apply_rule_matrix(bare, replace(c.RULES, noise=0.1), "x_", c.ONTOLOGY)


def test_ranked_table(spark):
    key = "patient_id string, "
    profiles = spark.createDataFrame(
        [("SYN-1", 30, "feminino", 0.2), ("SYN-2", 45, "masculino", 0.8), ("SYN-3", 52, "outro_ou_nao_informado", 0.5)],
        key + "age_years int, gender_category string, social_vulnerability double",
    )
    scores = spark.createDataFrame(
        [("SYN-1", 4, 3, 35), ("SYN-2", 22, 17, 70), ("SYN-3", 14, 11, 56)],
        key + "phq9_total int, gad7_total int, idate_estado_total int",
    )
    flags = {
        "SYN-1": [], "SYN-3": ["agravamento_recente"],
        "SYN-2": ["ideacao_suicida", "planejamento_suicida", "uso_problematico_substancias", "agravamento_recente", "suporte_social_baixo"],
    }
    names = list(c.SIGNAL_TITLES)
    columns = [marker_column(c.EXTRACTED_PREFIX, m, "present") + " int" for m in names]
    functional = marker_column(c.EXTRACTED_PREFIX, c.FUNCTIONAL, "severity_code")
    extracted = spark.createDataFrame(
        [(k, *[int(m in flags[k]) for m in names], f) for k, f in (("SYN-1", 0), ("SYN-2", 3), ("SYN-3", 2))],
        key + ", ".join(columns) + f", {functional} int",
    )
    predictions = spark.createDataFrame(
        [
            ("SYN-1", 0, 0, "baixa", "baixa", 0.80, 0.10, 0.08, 0.02),
            ("SYN-2", 3, 3, "urgente", "urgente", 0.01, 0.01, 0.08, 0.90),
            ("SYN-3", 2, 2, "alta", "alta", 0.02, 0.08, 0.75, 0.15),
        ],
        key + "prioridade_referencia_codigo int, prioridade_prevista_codigo int, prioridade_referencia string, "
        "prioridade_prevista string, proba_0 double, proba_1 double, proba_2 double, proba_3 double",
    )
    table = rk.ranked_table(profiles, scores, extracted, predictions, RANKED, include_reference=True)
    rows = table.collect()
    assert [r["ID do perfil sintético"] for r in rows] == ["SYN-2", "SYN-3", "SYN-1"]
    assert [r["Posição"] for r in rows] == [1, 2, 3]
    assert rows[0]["Prioridade prevista"] == "Urgente"
    assert rows[0]["Concorda com a referência simulada?"] == "Sim"
    assert rows[0]["Probabilidade alta/urgente"] == "98.0%"
    assert rows[0]["Sinais de atenção extraídos"].startswith("Ideação suicida atual; Planejamento")
    assert rows[2]["Sinais de atenção extraídos"] == c.NO_SIGNAL
    assert table.columns[:4] == ["Posição", "ID do perfil sintético", "Prioridade prevista", "Prioridade de referência simulada"]
    with pytest.raises(Exception, match="rows without a match: 1"):
        rk.ranked_table(profiles.where("patient_id <> 'SYN-1'"), scores, extracted, predictions, RANKED).collect()
    with pytest.raises(ValueError):
        rk.first_rows(table, 0)


def test_model_selection(spark):
    summary = spark.createDataFrame(
        [("d", "b", 0.8, 0.1), ("d", "a", 0.8, 0.9), ("e", "a", 0.9, 0.9)],
        "dataset string, model string, development_f1_macro double, final_test_f1_macro double",
    )
    assert rk.select_model(summary, "d")[0] == "a"
    assert rk.select_model(summary, "d", "b")[0] == "b"
    with pytest.raises(ValueError, match="available"):
        rk.select_model(summary, "x")
    with pytest.raises(ValueError, match="available"):
        rk.select_model(summary, "d", "z")


def test_analytic_sets_are_symmetric(spark):
    base = spark.createDataFrame(
        [("SYN-1", 11, 40, 0.4, 0.2)],
        "patient_id string, seed int, age_years int, social_vulnerability double, gravidade_latente_auditoria double",
    )
    profiles = base.join(_empty_wide(spark, c.SOURCE_PREFIX), "patient_id")
    scores = spark.createDataFrame([("SYN-1", 5, 4, 35)], "patient_id string, phq9_total int, gad7_total int, idate_estado_total int")
    labels = spark.createDataFrame(
        [("SYN-1", "baixa", 0, 0)],
        "patient_id string, prioridade_referencia string, prioridade_referencia_codigo int, urgent_rule_triggered int",
    )
    sets = analytic_sets(profiles, scores, labels, _empty_wide(spark, c.EXTRACTED_PREFIX), ANALYTIC, c.ONTOLOGY)
    assert sets["source"].columns == sets["extracted"].columns
    assert not {"seed", "gravidade_latente_auditoria"} & set(sets["source"].columns)
    assert sum(n.startswith("marker_") for n in sets["source"].columns) == 10 * len(FEATURE_FIELDS)
    with pytest.raises(ValueError, match="not symmetric"):
        short = _empty_wide(spark, c.EXTRACTED_PREFIX).drop("marcadores_extraidos_risco_violencia_severity")
        analytic_sets(profiles, scores, labels, short, ANALYTIC, c.ONTOLOGY)


def test_missing_values_share_a_mask(spark):
    df = spark.range(300).selectExpr("id", "id * 2 AS a", "id * 3 AS b", "'t' AS note")
    one = ql.with_missing_values(df, "id", 0.3, 1, ["b"])
    two = ql.with_missing_values(df.withColumn("c", F.lit(1)), "id", 0.3, 1, ["b"]).drop("c")
    assert one.exceptAll(two).count() == 0
    n = one.agg(F.count("a"), F.count("b"), F.count("note")).first()
    assert 180 < n[0] < 240 and n[1] == 300 and n[2] == 300


def test_quality(spark):
    df = spark.createDataFrame([(1, 1, 0, 1), (2, 3, 1, 4)], "k int, a int, b int, t int")
    checks = ql.quality_checks(
        df,
        {"range": (ql.all_in_range(["a", "b"], 0, 3), "0..3"), "sum": (ql.total_matches(["a", "b"], "t"), "sum"), "bad": (ql.at_most("a", "b"), "a <= b")},
        {"unique": ("k", "one row per key")},
    )
    assert {r["check"]: r["passed"] for r in checks.collect()} == {"range": True, "sum": True, "bad": False, "unique": True}
    with pytest.raises(Exception, match="quality checks failed: 1"):
        ql.quality_gate(df, checks).collect()
    with pytest.raises(Exception, match="smallest class has rows: 1"):
        ql.require_class_counts(df, "a", 2).collect()


def test_samples(spark):
    df = spark.range(900).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('c', id % 4) END AS y")
    folds = sm.stratified_folds(df, "id", "y", 4, 1).groupBy("y").pivot("fold", [0, 1, 2, 3]).count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in folds)
    a = sm.train_test_split(df.repartition(3), "id", "y", 0.2, 1)
    b = sm.train_test_split(df.repartition(11), "id", "y", 0.2, 1, buckets=5)
    assert a.exceptAll(b).count() == 0
    sizes = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    tests = {r["y"]: r["n"] for r in a.groupBy("y").agg(F.sum("is_test").alias("n")).collect()}
    assert all(tests[y] == round(0.2 * n) for y, n in sizes.items())
    sample = sm.stratified_sample(df, "id", "y", 5, 2, ["hot", "c1"])
    assert sorted(r["count"] for r in sample.groupBy("y").count().collect()) == [5, 5]
    order = [r["id"] for r in sm.shuffled(df, "id", 1).collect()]
    assert sorted(order) == list(range(900)) and order != sorted(order)


def test_annotators_pending(spark):
    assert annotator_agreement(None, None, "k", spark).first()["status"] == "pending"


def test_rendering_refuses_labels(spark):
    df = markers_from_wide(spark.createDataFrame([("SYN-1", 12, 11, 52)], "patient_id string, phq9_total int, gad7_total int, idate_estado_total int"), "none_", c.ONTOLOGY)
    note = render_notes(df, "patient_id", NOTE, c.ONTOLOGY).first()
    assert note["note"].startswith("S - ") and "\nA - " in note["note"]
    assert note["narrative_id"] == f"NAR-SYN-1-{note['input_hash'][:10]}"
    with pytest.raises(ValueError, match="label columns"):
        render_notes(df.withColumn("priority", F.lit(1)), "patient_id", NOTE, c.ONTOLOGY)
    with pytest.raises(ValueError, match="forbidden keys"):
        render_notes(df.withColumn("ctx", F.struct(F.lit(1).alias("yref"))), "patient_id", NOTE, c.ONTOLOGY)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb, \"c\"", None), (2, None, 1.5)], "k int, t string, v double")
    path = io.write_csv(df, str(tmp_path / "c"))
    assert io.read_csv(spark, path, df.schema).exceptAll(df).count() == 0
    (tmp_path / "n.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert io.read_jsonl(spark, str(tmp_path / "n.jsonl"), "k int").where("k IS NOT NULL").count() == 2
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(Exception, match="JSON object was expected"):
        io.read_json_object(spark, str(tmp_path / "list.json"), "k int").collect()
    with pytest.raises(FileNotFoundError, match="a/x, b/y"):
        io.load_bundle(spark, str(tmp_path), "r", {"one": ("a", "x"), "two": ("b", "y")})


def test_fields_are_stable():
    assert len(FIELDS) == 9 and len(c.ONTOLOGY.names) == 10


def test_many_rows_of_a_hot_stratum(spark):
    """A stratum with nearly all rows is ranked in buckets, also beyond Spark's rank limit."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") < 50, "b").otherwise("a").alias("s"))
    got = sm.first_n_per_stratum(rows, "s", [F.col("id")], 1001).collect()
    assert sorted(r.id for r in got if r.s == "a") == list(range(50, 1051))
    assert sorted(r.id for r in got if r.s == "b") == list(range(50))


def test_unknown_marker_is_a_violation(spark):
    raw = spark.createDataFrame([({"fever_of_unknown_kind": "1"},), ({},), (None,)], "raw map<string,string>")
    out = normalize_markers(raw, "raw", c.ONTOLOGY).select("raw", "violations").collect()
    assert [r.violations for r in out if r.raw] == [["fever_of_unknown_kind.unknown"]]
    assert all("unknown" not in v for r in out if not r.raw for v in r.violations)


def test_a_half_written_stage_is_refused(spark, tmp_path):
    from noteframe.sources import tables as io

    root, asked = str(tmp_path), {"one": ("a", "x"), "two": ("a", "y")}
    df = spark.createDataFrame([(1, "p", None), (2, None, 0.5), (2, None, 0.5)], "k long, s string, v double")
    record = io.commit_stage({"x": df, "y": df.limit(0)}, root, "r", "a").orderBy("name").collect()
    assert [(r["name"], r["rows"]) for r in record] == [("x", 3), ("y", 0)] and record[1]["digest"] == "0"
    bundle = io.committed_bundle(spark, root, "r", asked, verify=True)
    assert bundle["one"].count() == 3 and bundle["two"].count() == 0
    assert io.table_digest(df.repartition(3)).first() == io.table_digest(df).first()
    # the same number of other rows is found by the digest alone
    io.write_stage(df.withColumn("k", df["k"] + 1), root, "r", "a", "x")
    io.committed_bundle(spark, root, "r", asked)
    with pytest.raises(ValueError, match="a/x has not the content"):
        io.committed_bundle(spark, root, "r", asked, verify=True)
    io.write_stage(df.limit(1), root, "r", "a", "x")
    with pytest.raises(ValueError, match="a/x has not the rows"):
        io.committed_bundle(spark, root, "r", asked)
    # a writer that stops between its tables and its record
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        io.commit_stage({"x": df, "y": df.selectExpr("k", "1 / (k - 1) AS v")}, root, "r", "a")
    with pytest.raises(ValueError, match="a/x has no record; a/y has no record"):
        io.committed_bundle(spark, root, "r", asked)
    with pytest.raises(FileNotFoundError, match="b/_record"):
        io.committed_bundle(spark, root, "r", {"one": ("b", "x")})
