"""Render rows with markers and scores as short notes (native expressions)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as x
from ..functions.text import content_hash, hashed_id
from .contracts import forbidden_schema_paths, refuse_label_columns, require_columns
from .markers import Ontology


@dataclass(frozen=True)
class NoteSpec:
    """Phrases of a note; ``graded`` and ``support`` name the two markers with own phrases."""

    scores: Sequence[str]
    score_steps: Sequence[tuple]
    score_phrases: Sequence[str]
    graded: str
    graded_phrases: Sequence[str]
    graded_unknown: str
    support: str
    support_phrases: tuple[str, str]
    always_past: str
    terms: Mapping[str, str]
    subjects: tuple[str, str]
    tenses: Mapping[str, str]
    hedge: str
    verbs: tuple[str, str, str]
    past: str
    openings: Sequence[str]
    assessment: str
    generator_id: str
    prompt_version: str
    id_prefix: str


def score_phrase(spec: NoteSpec) -> str:
    """First rung of the ladder that any score reaches."""
    steps = [
        (x.any_true(f"{x.col(c)} >= {limit}" for c, limit in zip(spec.scores, step) if limit is not None), x.lit(text))
        for step, text in zip(spec.score_steps, spec.score_phrases)
    ]
    return x.case(steps, x.lit(spec.score_phrases[-1]))


def marker_sentences(m: str, name: str, spec: NoteSpec, ontology: Ontology) -> str:
    """Sentences of one expressed marker struct (SQL expression ``m``)."""
    self_subject, other_subject = (x.lit(s) for s in spec.subjects)
    if name == spec.graded:
        phrases = ", ".join(x.lit(p) for p in spec.graded_phrases)
        described = f"coalesce(get(array({phrases}), {m}.severity_code), {x.lit(spec.graded_unknown)})"
        kept = x.case([(f"{m}.negated = 1", x.lit(spec.graded_phrases[0]))], described)
        return f"concat({self_subject}, ' ', {kept}, '.')"
    if name == spec.support:
        low, available = (x.lit(p) for p in spec.support_phrases)
        return x.case([(f"{m}.present = 1", low)], available)
    term = x.lit(spec.terms[name])
    subject = x.case([(f"{m}.experiencer = {x.lit(ontology.other_experiencer)}", other_subject)], self_subject)
    had, denies, has = (x.lit(v) for v in spec.verbs)
    # An empty tense leaves a space before the full stop.
    end = x.case(
        [(f"{m}.temporality = {x.lit(k)}", x.lit(f" {v}.")) for k, v in spec.tenses.items()], x.lit(" .")
    )
    hedge = f"CASE WHEN {m}.certainty = {x.lit(ontology.uncertain)} THEN {x.lit(spec.hedge.strip())} END"
    now = x.case(
        [(f"{m}.negated = 1", f"concat_ws(' ', {subject}, {denies}, {term})")],
        f"concat_ws(' ', {subject}, {hedge}, {has}, {term})",
    )
    stated = f"concat({now}, {end})"
    if name == spec.always_past:
        return stated
    remote = f"concat({subject}, ' ', {had}, ' ', {term}, ' ', {x.lit(spec.past)}, '.')"
    return f"concat_ws(' ', CASE WHEN {m}.remote_present = 1 THEN {remote} END, {stated})"


def render_notes(
    df: DataFrame,
    key: str,
    spec: NoteSpec,
    ontology: Ontology,
    *,
    seed: int = 0,
    omission_rate: float = 0.0,
    markers: str = "markers",
    audited: Sequence[str] = (),
) -> DataFrame:
    """(key, narrative_id, subjective, assessment, note, generator_id, prompt_version, input_hash).

    Refuses label columns at any depth of the schema. A mention is dropped at
    ``omission_rate`` by a hash of (seed, marker, key). ``audited`` columns enter the input
    hash besides scores and markers.
    """
    if not 0 <= omission_rate <= 1:
        raise ValueError("omission_rate must lie between 0 and 1")
    require_columns(df, [key, markers, *spec.scores], "text stage")
    refuse_label_columns(df)
    leaked = forbidden_schema_paths(df.schema)
    if leaked:
        raise ValueError(f"forbidden keys in the input of a text stage: {leaked}")
    parts = [score_phrase(spec)]
    for i, name in enumerate(ontology.names):
        m = f"get({x.col(markers)}, {i})"
        tests = [f"({m}.present = 1 OR {m}.negated = 1 OR {m}.remote_present = 1)"]
        if omission_rate > 0:
            draw = x.uniform(x.lit(str(seed)), x.lit(f"omit/{name}"), x.col(key))
            tests.append(f"{draw} >= {x.lit(float(omission_rate))}")
        parts.append(f"CASE WHEN {x.all_true(tests)} THEN {marker_sentences(m, name, spec, ontology)} END")
    openings = ", ".join(x.lit(o) for o in spec.openings)
    draw = x.uniform(x.lit(str(seed)), x.lit("opening"), x.col(key))
    opening = f"concat(get(array({openings}), int(floor({draw} * {len(spec.openings)}))), ':')"
    inputs = {
        key: F.col(key),
        **{c: F.col(c) for c in (*spec.scores, *audited)},
        "markers": F.col(markers),
        "prompt_version": F.lit(spec.prompt_version),
        "seed": F.lit(seed),
    }
    told = df.select(
        key,
        F.expr(f"concat_ws(' ', {opening}, {', '.join(parts)})").alias("subjective"),
        F.lit(spec.assessment).alias("assessment"),
        content_hash(inputs).alias("input_hash"),
    )
    return told.select(
        key,
        hashed_id(spec.id_prefix, key, F.col("input_hash")).alias("narrative_id"),
        "subjective",
        "assessment",
        soap_note(F.col("subjective"), F.col("assessment")).alias("note"),
        F.lit(spec.generator_id).alias("generator_id"),
        F.lit(spec.prompt_version).alias("prompt_version"),
        "input_hash",
    )


def soap_note(subjective: Column, assessment: Column) -> Column:
    """Two sections; the headers are fixed values of the note format."""
    return F.concat(F.lit("S - "), subjective, F.lit("\nA - "), assessment)
