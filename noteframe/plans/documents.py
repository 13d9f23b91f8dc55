"""Queries over documents, conversations and events: sentences, web lexicon, JSON, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extraction as ex
from ..operators.contracts import forbidden_json_paths, forbidden_map_keys
from ..operators.markers import FIELDS, markers_long, markers_wide, parse_section_replies
from ..operators.rendering import soap_note
from ..presets import web
from . import sql
from .common import dealt, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


_SENT = f"""WITH sent AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS s FROM (
  SELECT doc_id, {sql.sentence_list('text')} AS l FROM documents))"""
_O = web.ONTOLOGY


@query(f"{_SENT} SELECT doc_id, position::INT AS position, md5(s) AS sentence_md5 FROM sent")
def sentences(spark, folder):
    docs = dealt(table(spark, folder, "documents").select("doc_id", "text"))
    rows = ex.sentence_rows(docs, "doc_id", "text")
    return rows.select("doc_id", "position", F.md5("sentence").alias("sentence_md5"))


@query(
    f"""{_SENT}, q AS (SELECT CASE WHEN {sql.found('s', _O.remote_cues)} THEN 'remote' WHEN {sql.found('s', _O.current_cues)} THEN 'current' ELSE 'unspecified' END AS temporality,
  CASE WHEN {sql.found('s', _O.uncertain_cues)} THEN 'uncertain' ELSE 'affirmed' END AS certainty,
  CASE WHEN {sql.found('s', _O.third_party_cues)} THEN 'other' ELSE 'self' END AS experiencer FROM sent)
SELECT temporality, certainty, experiencer, count(*)::BIGINT AS n FROM q GROUP BY ALL"""
)
def sentence_cues(spark, folder):
    docs = dealt(table(spark, folder, "documents").select("doc_id", "text"))
    rows = ex.sentence_rows(docs, "doc_id", "text")
    cues = ex.qualified_sentences(rows, "sentence", _O)
    return cues.groupBy("temporality", "certainty", "experiencer").agg(F.count("*").alias("n"))


def web_markers(spark, folder) -> DataFrame:
    docs = dealt(table(spark, folder, "documents").select("doc_id", "text"))
    return ex.extract_markers(docs, "doc_id", "text", _O, extractor_id="web", document_prefilter=True)


_EXT = f"WITH {sql.extraction_ctes('ext', 'documents', 'doc_id', 'text', _O).lstrip()}"


@query(f"{_EXT} SELECT doc_id, marker, {', '.join(FIELDS)} FROM ext")
def marker_extract_long(spark, folder):
    return markers_long(web_markers(spark, folder)).select("doc_id", "marker", *FIELDS)


@query(f"{_EXT} " + sql.wide_select("ext", "doc_id", "m_", _O))
def marker_extract_wide(spark, folder):
    return markers_wide(web_markers(spark, folder).select("doc_id", "markers"), "m_", _O)


@query(
    f"""{_SENT}, a AS (SELECT doc_id, arg_min(s, position) AS ev, arg_max(s, position) AS past FROM sent GROUP BY doc_id)
SELECT doc_id, md5(concat_ws(' | ', nullif(ev, ''), CASE WHEN past <> ev THEN past END)) AS evidence_md5 FROM a"""
)
def evidence_text(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", tx.sentences("text").alias("l")).where("size(l) > 0")
    ends = docs.select("doc_id", F.get("l", F.lit(0)).alias("ev"), F.element_at("l", -1).alias("past"))
    joined = ex.joined_evidence(ends, "ev", "past", "evidence")
    return joined.select("doc_id", F.md5("evidence").alias("evidence_md5"))


@query(
    """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest,
  'EV-' || event_id || '-' || substr(sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 10) AS hashed_id FROM events"""
)
def content_hashes(spark, folder):
    """Hash of the row as JSON with sorted names, and ids derived from it."""
    events = table(spark, folder, "events")
    digest = events.select("event_id", tx.content_hash(["user_id", "event_type", "event_id"]).alias("digest"))
    return digest.withColumn("hashed_id", tx.hashed_id("EV", "event_id", F.col("digest")))


@query(
    """SELECT event_type, CASE WHEN event_id % 4 IN (0, 1) THEN true WHEN event_id % 4 = 2 THEN false ELSE false END AS flag, count(*)::BIGINT AS n FROM events GROUP BY ALL"""
)
def truth_texts(spark, folder):
    k = F.col("event_id") % 4
    text = F.when(k == 0, " Sim ").when(k == 1, "TRUE").when(k == 2, "no")
    return (
        table(spark, folder, "events")
        .select("event_type", tx.truthy(text).alias("flag"))
        .groupBy("event_type", "flag")
        .agg(F.count("*").alias("n"))
    )


_NESTED = """CASE event_id % 3 WHEN 0 THEN '{"context": {"k": 1, "Label ": 2}, "list": [{"a": 1}, ' || props || ', {"target": ' || props || '}]}'
  WHEN 1 THEN '{"a": [[{"yhat": 1}]], "p": ' || props || '}' ELSE 'not json' END"""


@query(
    f"""WITH j AS (SELECT event_id, {_NESTED} AS doc FROM events),
w AS (SELECT event_id, string_agg(replace(substr(fullkey, 3), '"', ''), ';' ORDER BY fullkey) AS paths FROM
  (SELECT event_id, doc FROM j WHERE json_valid(doc)) x, json_tree(x.doc) t
  WHERE lower(trim(t.key)) IN ('label', 'target', 'yhat', 'k') AND t.key IS NOT NULL GROUP BY event_id)
SELECT event_id, coalesce(paths, '') AS paths FROM j LEFT JOIN w USING (event_id)"""
)
def forbidden_paths(spark, folder):
    """Paths of forbidden keys at any depth of a JSON text."""
    events = table(spark, folder, "events")
    doc = F.expr(_NESTED).alias("doc")
    found = events.select("event_id", forbidden_json_paths(doc, ["k"]).alias("p"))
    return found.select("event_id", F.array_join(F.array_sort("p"), ";").alias("paths"))


@query("SELECT event_type, count(*)::BIGINT AS n, sum((props LIKE '%\"k\"%')::INT)::BIGINT AS n_forbidden FROM events GROUP BY event_type")
def forbidden_keys_in_maps(spark, folder):
    events = table(spark, folder, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("m"))
    checked = events.withColumn("bad", F.size(forbidden_map_keys("m", ["K"])))
    return checked.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("bad").alias("n_forbidden"))


@query(
    """SELECT conv_id, turn, md5('S - ' || trim(regexp_replace(replace(text, chr(10), ' '), '\\s+', ' ', 'g')) || chr(10) || 'A - ' || role) AS note_md5 FROM conversations"""
)
def cleaned_sections(spark, folder):
    """Collapse white space, drop one leading header, and join the sections of a note."""
    turns = table(spark, folder, "conversations")
    raw = F.concat(F.lit("Subjective:  "), F.col("text"))
    subjective = tx.clean_section(raw, "subjective", ("s", "a"))
    return turns.select("conv_id", "turn", F.md5(soap_note(subjective, F.col("role"))).alias("note_md5"))


_CLEAN = "trim(regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '\\s+', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT conv_id || '-' || turn AS reply_id, (conv_id + turn) % 6 AS kind, {_CLEAN} AS said, role FROM conversations),
f AS (SELECT *, CASE WHEN kind = 3 OR kind = 5 THEN 'reply' ELSE concat_ws(',', CASE WHEN kind = 4 OR said = '' THEN 'subjective' END,
  CASE WHEN kind = 2 THEN 'assessment' END) END AS faults FROM t)
SELECT reply_id, CASE WHEN faults = '' THEN 'success' ELSE 'failed' END AS status, faults,
  md5(CASE WHEN faults = '' THEN said ELSE '' END) AS subjective_md5, CASE WHEN faults = '' THEN role ELSE '' END AS assessment FROM f"""
)
def section_replies(spark, folder):
    """Replies with two text sections: fenced, plain, one missing, broken, blank, not an object."""
    turns = table(spark, folder, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    said = F.when(kind == 4, " \n").otherwise(F.concat(F.lit("S -  "), F.col("text")))
    body = F.to_json(F.struct(said.alias("subjective"), F.when(kind != 2, F.col("role")).alias("assessment")))
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 3, F.concat(F.lit("answer: "), F.col("role")))
        .when(kind == 5, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body)
    )
    rows = turns.select(F.concat_ws("-", "conv_id", "turn").alias("reply_id"), reply.alias("reply"))
    parsed = parse_section_replies(rows, "reply_id", "reply", {"subjective": ("s",), "assessment": ("a",)})
    return parsed.select(
        "reply_id",
        "status",
        F.array_join("faults", ",").alias("faults"),
        F.md5("subjective").alias("subjective_md5"),
        "assessment",
    )
