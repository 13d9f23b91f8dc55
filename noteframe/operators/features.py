"""Analytic sets: one checked join, three projections with symmetric marker columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions import expr as x
from .contracts import require_symmetric
from .joins import join_one_to_one
from .markers import FEATURE_FIELDS, Ontology, marker_columns
from .quality import with_missing_values


@dataclass(frozen=True)
class AnalyticSpec:
    key: str
    scores: Sequence[str]
    targets: Sequence[str]
    dropped: Sequence[str]
    source_prefix: str
    extracted_prefix: str
    canonical_prefix: str
    text_columns: Sequence[str] = ()


def analytic_sets(
    profiles: DataFrame,
    scores: DataFrame,
    labels: DataFrame,
    extracted: DataFrame,
    spec: AnalyticSpec,
    ontology: Ontology,
    *,
    missing_rate: float = 0.0,
    seed: int = 0,
    check: Sequence[str] = ("left", "right"),
) -> dict[str, DataFrame]:
    """base; base + source markers; base + extracted markers (the last two share their columns).

    The key, seeds, audit columns and source-prefixed columns never become features.
    """
    key = spec.key
    source = marker_columns(spec.source_prefix, ontology, FEATURE_FIELDS)
    found = marker_columns(spec.extracted_prefix, ontology, FEATURE_FIELDS)
    canonical = marker_columns(spec.canonical_prefix, ontology, FEATURE_FIELDS)
    right = [s for s in check if s == "right"]
    merged = join_one_to_one(profiles, scores.select(key, *spec.scores), key, "inner", check)
    merged = join_one_to_one(merged, labels.select(key, *spec.targets), key, "inner", right)
    kept = [c for c in extracted.columns if c == key or c in found]
    merged = join_one_to_one(merged, extracted.select(*kept), key, "inner", right)
    require_symmetric(merged, source, found)

    attributes = [
        c
        for c in profiles.columns
        if c != key and c not in spec.dropped and not c.startswith(spec.source_prefix)
    ]
    base = [key, *spec.targets, *attributes, *spec.scores]

    def renamed(columns: Sequence[str]) -> list[str]:
        return [f"{x.col(a)} AS {x.col(b)}" for a, b in zip(columns, canonical)]

    sets = {
        "base": merged.select(*base),
        "source": merged.selectExpr(*map(x.col, base), *renamed(source)),
        "extracted": merged.selectExpr(*map(x.col, base), *renamed(found)),
    }
    return {
        name: with_missing_values(df, key, missing_rate, seed, [key, *spec.targets], spec.text_columns)
        for name, df in sets.items()
    }
