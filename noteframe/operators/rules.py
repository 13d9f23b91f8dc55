"""Ordinal rule matrix: urgent rules, weighted evidence counts and cut-offs.

A term is a function ``Features -> boolean SQL``. Thresholds are looked up by name: numbers,
or names of columns, so a scenario sweep can carry its own cut-offs in the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as x
from ..functions.hashing import normal
from .contracts import require_columns
from .joins import join_one_to_one
from .markers import Ontology, active_sql, marker_column


@dataclass(frozen=True)
class Features:
    """What a rule term may read, as SQL: columns, markers under one prefix, named thresholds."""

    columns: frozenset
    prefix: str
    ontology: Ontology | None
    thresholds: Mapping[str, object]

    def number(self, name: str) -> str:
        return x.number(x.col(name))

    def threshold(self, name: str) -> str:
        value = self.thresholds[name]
        return x.col(value) if isinstance(value, str) else x.lit(float(value))

    def active(self, marker: str) -> str:
        return active_sql(self.columns, self.prefix, marker, self.ontology, require_current=True)

    def graded(self, marker: str) -> str:
        """Severity code of a marker while it is active and current, else 0."""
        name = marker_column(self.prefix, marker, "severity_code")
        code = f"int({x.number(x.col(name))})" if name in self.columns else "0"
        return f"(CASE WHEN {self.active(marker)} THEN {code} ELSE 0 END)"


Term = Callable[[Features], str]


def at_least(column: str, threshold: str) -> Term:
    return lambda f: f"({f.number(column)} >= {f.threshold(threshold)})"


def active(marker: str) -> Term:
    return lambda f: f.active(marker)


def graded_at_least(marker: str, level: int) -> Term:
    return lambda f: f"({f.graded(marker)} >= {level})"


def all_of(*terms: Term) -> Term:
    return lambda f: x.all_true(t(f) for t in terms)


@dataclass(frozen=True)
class RuleMatrix:
    """Rules and parameters; ``labels`` go from the lowest class to the urgent one."""

    version: str
    inputs: tuple[str, ...]
    urgent: tuple[Term, ...]
    high: tuple[Term, ...]
    moderate: tuple[Term, ...]
    thresholds: Mapping[str, object]
    labels: tuple[str, str, str, str]
    noise: float = 0.0

    def with_thresholds(self, **changes) -> "RuleMatrix":
        return replace(self, thresholds={**self.thresholds, **changes})


RULE_OUTPUTS = (
    "priority_label",
    "priority_code",
    "urgent_rule_triggered",
    "priority_high_evidence",
    "priority_moderate_evidence",
    "priority_score",
)


def _count(terms: Sequence[Term], features: Features) -> str:
    return "(" + " + ".join(f"int(coalesce({t(features)}, false))" for t in terms) + ")"


def apply_rule_matrix(
    df: DataFrame,
    matrix: RuleMatrix,
    prefix: str = "",
    ontology: Ontology | None = None,
    *,
    key: str | None = None,
    seed: int | None = None,
) -> DataFrame:
    """Add the six ``RULE_OUTPUTS``; the same matrix serves any marker prefix.

    Score noise needs an explicit seed and a key (the draw is a hash of both).
    """
    require_columns(df, matrix.inputs, "rule matrix")
    f = Features(frozenset(df.columns), prefix, ontology, matrix.thresholds)
    urgent = x.any_true(f"coalesce({t(f)}, false)" for t in matrix.urgent)
    counted = df.withColumns(
        {
            "urgent_rule_triggered": F.expr(f"int({urgent})"),
            "priority_high_evidence": F.expr(_count(matrix.high, f)),
            "priority_moderate_evidence": F.expr(_count(matrix.moderate, f)),
        }
    )
    score = F.expr(
        f"{f.threshold('high_evidence_weight')} * priority_high_evidence"
        f" + {f.threshold('moderate_evidence_weight')} * priority_moderate_evidence"
    )
    if matrix.noise:
        if seed is None or key is None:
            raise ValueError("score noise needs an explicit seed and key")
        score = score + F.lit(float(matrix.noise)) * normal(seed, key, "label")
    scored = counted.withColumn("priority_score", score)
    code = x.case(
        [
            ("urgent_rule_triggered = 1", "3"),
            (f"priority_score >= {f.threshold('high_priority_cutoff')}", "2"),
            (f"priority_score >= {f.threshold('moderate_priority_cutoff')}", "1"),
        ],
        "0",
    )
    coded = scored.withColumn("priority_code", F.expr(code))
    names = ", ".join(x.lit(v) for v in matrix.labels)
    return coded.withColumn("priority_label", F.expr(f"get(array({names}), priority_code)"))


def assign_reference(
    profiles: DataFrame,
    scores: DataFrame,
    matrix: RuleMatrix,
    prefix: str,
    ontology: Ontology,
    key: str,
    names: Mapping[str, str],
    seed: int | None = None,
    check: Sequence[str] = ("left", "right"),
) -> DataFrame:
    """1:1 join of profiles and scores, rule matrix on the source markers; ``names`` renames outputs."""
    merged = join_one_to_one(profiles, scores, key, "inner", check)
    result = apply_rule_matrix(merged, matrix, prefix, ontology, key=key, seed=seed)
    return result.select(key, *[F.col(c).alias(names.get(c, c)) for c in RULE_OUTPUTS])


def available_prefix(df: DataFrame, prefixes: Sequence[str]) -> str:
    """First prefix that any column starts with; an unused prefix if there is none."""
    for prefix in prefixes:
        if any(c.startswith(prefix) for c in df.columns):
            return prefix
    return "unavailable_"


def rule_baseline(
    df: DataFrame, matrix: RuleMatrix, ontology: Ontology, prefixes: Sequence[str], out: str = "predicted_code"
) -> DataFrame:
    """Prediction of the rule matrix from whatever marker family the table holds."""
    scored = apply_rule_matrix(df, matrix, available_prefix(df, prefixes), ontology)
    return scored.select(*df.columns, F.col("priority_code").alias(out))
