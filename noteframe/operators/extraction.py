"""Rule-based extraction of qualified markers from text.

Extraction is local to a row: sentences are split once, sentences without any hit are
dropped, every pattern is tested once per remaining sentence, and the first matching
sentences are picked per marker. There is no explode and no shuffle, so the cost grows
with the text only, and a hot key or source cannot overload a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as x
from ..functions.text import WHITESPACE, sentences_sql
from .contracts import require_columns
from .markers import Ontology


def temporality_sql(sentence: str, ontology: Ontology) -> str:
    """Remote cues are tested before current cues."""
    return x.case(
        [
            (x.found(sentence, ontology.remote_cues, False), x.lit(ontology.remote)),
            (x.found(sentence, ontology.current_cues, False), x.lit(ontology.current)),
        ],
        x.lit(ontology.unspecified),
    )


def certainty_sql(sentence: str, ontology: Ontology) -> str:
    return x.case(
        [(x.found(sentence, ontology.uncertain_cues, False), x.lit(ontology.uncertain))], x.lit(ontology.affirmed)
    )


def experiencer_sql(sentence: str, ontology: Ontology) -> str:
    return x.case(
        [(x.found(sentence, ontology.third_party_cues, False), x.lit(ontology.other_experiencer))],
        x.lit(ontology.self_experiencer),
    )


def severity_sql(marker: str, sentence: str, present: str, ontology: Ontology) -> str:
    """struct(label, code): the marker's own cues first, then the general ones, then the default."""

    def record(label: str, code: int) -> str:
        return x.struct([("label", x.lit(label)), ("code", str(code))])

    steps = [(f"{present} = 0", record(ontology.absent, 0))]
    for spec in ontology.markers:
        for cue in spec.severity:
            hit = x.found(sentence, [cue.pattern], False)
            steps.append((f"{marker} = {x.lit(spec.name)} AND {hit}", record(cue.label, cue.code)))
    for cue in ontology.severity_cues:
        steps.append((x.found(sentence, [cue.pattern], False), record(cue.label, cue.code)))
    default = ontology.default_severity
    return x.case(steps, record(default.label, default.code))


@dataclass(frozen=True)
class Variant:
    """One extractor over a shared text: a lexicon, and how often presence is flipped."""

    name: str
    ontology: Ontology
    flip_rate: float = 0.0
    seed: int = 0


def _patterns(ontology: Ontology) -> list[str]:
    return list(dict.fromkeys(p for m in ontology.markers for p in (*m.positive, *m.negative)))


def _candidates(sentences: str, ontology: Ontology) -> str:
    """Sentences with a hit: struct(s, raw[], neg[], remote), one flag per marker."""
    raw = ", ".join(x.found("s", m.positive, True) for m in ontology.markers)
    neg = ", ".join(x.found("s", m.negative, True) for m in ontology.markers)
    flags = x.struct(
        [("s", "s"), ("raw", f"array({raw})"), ("neg", f"array({neg})"), ("remote", x.found("s", ontology.remote_cues, False))]
    )
    return f"transform(filter({sentences}, s -> {x.found('s', _patterns(ontology), True)}), s -> {flags})"


def _split(text: str, ontologies: Sequence[Ontology], document_prefilter: bool) -> str:
    """The sentences of a text; with the prefilter only of texts with a hit of any lexicon."""
    sentences = sentences_sql(text)
    if not document_prefilter:
        return sentences
    patterns = list(dict.fromkeys(p for o in ontologies for p in _patterns(o)))
    return f"CASE WHEN {x.found(f'lower({text})', patterns, True)} THEN {sentences} END"


def _picks(candidates: str, ontology: Ontology) -> str:
    """Per marker the first current positive, current denial and remote positive sentence."""

    def first(test: str) -> str:
        return f"get(filter({candidates}, c -> {test}), 0).s"

    picks = []
    for i, name in enumerate(ontology.names):
        positive = f"get(c.raw, {i}) AND NOT get(c.neg, {i})"
        picks.append(
            x.struct(
                [
                    ("marker", x.lit(name)),
                    ("cur", first(f"{positive} AND NOT c.remote")),
                    ("den", first(f"get(c.neg, {i}) AND NOT c.remote")),
                    ("past", first(f"{positive} AND c.remote")),
                ]
            )
        )
    return f"array({', '.join(picks)})"


def _decided(picks: str, key: str, ontology: Ontology, flip_rate: float, seed: int) -> str:
    """Nested markers from the picked sentences of a row."""
    flip = f"{x.uniform(x.lit(str(seed)), 'p.marker', key)} < {x.lit(float(flip_rate))}" if flip_rate > 0 else "false"
    # The chosen sentence and the (possibly flipped) presence are bound before they are used.
    bound = x.struct(
        [
            ("marker", "p.marker"),
            ("cur", "p.cur"),
            ("den", "p.den"),
            ("past", "p.past"),
            ("ev", "coalesce(p.cur, p.den, p.past, '')"),
            (
                "present",
                f"int((p.cur IS NOT NULL OR (p.den IS NULL AND p.past IS NOT NULL)) <> ({flip}))",
            ),
        ]
    )
    time = x.case(
        [
            (
                "m.cur IS NOT NULL OR m.den IS NOT NULL",
                x.case(
                    [(x.found("m.ev", ontology.current_cues, False), x.lit(ontology.current))],
                    x.lit(ontology.unspecified),
                ),
            ),
            ("m.past IS NOT NULL", x.lit(ontology.remote)),
        ],
        x.lit(ontology.unspecified),
    )
    evidence = "concat_ws(' | ', nullif(m.ev, ''), CASE WHEN m.past <> m.ev THEN m.past END)"
    decided = x.struct(
        [
            ("marker", "m.marker"),
            ("present", "m.present"),
            ("negated", "int(m.cur IS NULL AND m.den IS NOT NULL AND m.present = 0)"),
            ("remote_present", "int(m.past IS NOT NULL)"),
            ("temporality", time),
            ("sev", severity_sql("m.marker", "m.ev", "m.present", ontology)),
            ("certainty", certainty_sql("m.ev", ontology)),
            ("experiencer", experiencer_sql("m.ev", ontology)),
            ("evidence", f"btrim({evidence}, {x.lit(WHITESPACE)})"),
        ]
    )
    flat = x.struct(
        [(f, f"m.{f}") for f in ("marker", "present", "negated", "remote_present", "temporality")]
        + [("severity", "m.sev.label"), ("severity_code", "m.sev.code")]
        + [(f, f"m.{f}") for f in ("certainty", "experiencer", "evidence")]
    )
    return f"transform(transform(transform({picks}, p -> {bound}), m -> {decided}), m -> {flat})"


def extract_markers(
    df: DataFrame,
    key: str,
    text: str,
    ontology: Ontology,
    *,
    extractor_id: str = "rules",
    flip_rate: float = 0.0,
    seed: int = 0,
    document_prefilter: bool = False,
) -> DataFrame:
    """Nested markers per key. Only ``key`` and ``text`` are read from ``df``.

    Per marker: the first current positive sentence wins, then the first current denial,
    then the first remote positive sentence. A sentence that matches a denial pattern is
    never a positive. ``flip_rate`` flips presence by a hash of (seed, marker, key)
    before severity is read. ``document_prefilter`` skips the sentence split of texts
    without any hit; use it when hits are rare and no pattern is anchored (``^``, ``$``).
    """
    require_columns(df, [key, text], "extraction input")
    k = x.col(key)
    split = _split(x.col(text), [ontology], document_prefilter)
    # One projection for the candidates and one for the rest: shorter plans for wide outputs.
    staged = df.select(key, text).selectExpr(k, f"{_candidates(split, ontology)} AS _c")
    return staged.selectExpr(
        k,
        f"{x.lit(extractor_id)} AS extractor_id",
        f"{x.lit(ontology.version)} AS ontology_version",
        "'success' AS extraction_status",
        "0 AS retry_count",
        f"{_decided(_picks('_c', ontology), k, ontology, flip_rate, seed)} AS markers",
    )


def extract_variants(
    df: DataFrame, key: str, text: str, variants: Sequence[Variant], *, document_prefilter: bool = False
) -> DataFrame:
    """One row per key with a column of nested markers per variant, named as the variant.

    The text is read and split once for all variants, and each lexicon is searched once for
    all its flip rates and seeds, so runs are compared as columns of one row and no join of
    extractions by key is needed. Each column is what ``extract_markers`` gives alone.
    """
    require_columns(df, [key, text], "extraction input")
    k = x.col(key)
    ontologies: list[Ontology] = []
    for v in variants:
        if v.ontology not in ontologies:
            ontologies.append(v.ontology)
    split = _split(x.col(text), ontologies, document_prefilter)
    staged = df.select(key, text).selectExpr(k, f"{split} AS _s")
    staged = staged.selectExpr(k, *[f"{_candidates('_s', o)} AS _c{i}" for i, o in enumerate(ontologies)])
    staged = staged.selectExpr(k, *[f"{_picks(f'_c{i}', o)} AS _p{i}" for i, o in enumerate(ontologies)])
    decided = [
        f"{_decided(f'_p{ontologies.index(v.ontology)}', k, v.ontology, v.flip_rate, v.seed)} AS {x.col(v.name)}"
        for v in variants
    ]
    return staged.selectExpr(k, *decided)


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per key and sentence, with its position."""
    # The outer form keeps the planner from inferring (and evaluating) a size filter first.
    split = df.select(key, F.expr(f"posexplode_outer({sentences_sql(x.col(text))}) AS (position, sentence)"))
    return split.where("position IS NOT NULL")


def qualified_sentences(df: DataFrame, sentence: str, ontology: Ontology) -> DataFrame:
    """Add the sentence-level cues (time, certainty, experiencer)."""
    s = x.col(sentence)
    return df.withColumns(
        {
            "temporality": F.expr(temporality_sql(s, ontology)),
            "certainty": F.expr(certainty_sql(s, ontology)),
            "experiencer": F.expr(experiencer_sql(s, ontology)),
        }
    )


def joined_evidence(df: DataFrame, evidence: str, remote: str, out: str) -> DataFrame:
    """Chosen sentence, plus the remote sentence if it is another one, joined by `` | ``."""
    e, r = x.col(evidence), x.col(remote)
    return df.withColumn(out, F.expr(f"concat_ws(' | ', nullif({e}, ''), CASE WHEN {r} <> {e} THEN {r} END)"))
