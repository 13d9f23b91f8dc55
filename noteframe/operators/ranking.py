"""Ranked inspection tables and model selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import code_label, label_code, number_or, number_or_missing, round_half_even
from ..functions.text import active_labels, mapped, mapped_lower, percent
from .contracts import require_columns
from .joins import join_one_to_one, refuse_orphans
from .ordered import positions


def class_rank(label: Column, labels: Sequence[str]) -> Column:
    """0 for the top class, counting down; unknown labels come last."""
    code = label_code(label, labels)
    return F.coalesce(F.lit(len(labels) - 1) - code, F.lit(len(labels)))


def ranked(df: DataFrame, label: str, labels: Sequence[str], high: str, top: str, key: str) -> DataFrame:
    """Order: class rank, upper-band probability, top-class probability (both descending, NULL last), key."""
    return df.orderBy(
        class_rank(F.col(label), labels), F.desc_nulls_last(high), F.desc_nulls_last(top), F.asc(key)
    )


def rank_key(label: Column, labels: Sequence[str], high: Column, top: Column, key: Column) -> Column:
    """The same order as one comparable struct, for positions over the whole table."""
    last = F.lit(float("inf"))
    return F.struct(
        class_rank(label, labels).alias("r"),
        F.coalesce(-high, last).alias("h"),
        F.coalesce(-top, last).alias("t"),
        key.alias("k"),
    )


def with_positions(
    df: DataFrame, order: Column, name: str = "position", buckets: int | None = None, store: bool = False
) -> DataFrame:
    """1..n over the whole table without a one-partition window."""
    return positions(df, order, name, buckets=buckets, store=store)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """First n rows of an ordered table."""
    if n <= 0:
        raise ValueError("n must be greater than zero")
    return df.limit(n)


def top_by(df: DataFrame, value: str, n: int, tie: str, absolute: bool = False) -> DataFrame:
    """Top n rows by a value (or its size)."""
    v = F.abs(value) if absolute else F.col(value)
    return df.orderBy(v.desc(), F.col(tie)).limit(n)


def best_per_group(df: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """Row with the highest score per group, then the first name."""
    w = W.partitionBy(group).orderBy(F.desc_nulls_last(score), F.asc(name))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def select_model(
    summary: DataFrame, dataset: str, model: str = "best", score: str = "development_f1_macro"
) -> tuple[str, str]:
    """(model, criterion) of one dataset; never chosen by a test score.

    ``summary`` has one row per model and is read once.
    """
    require_columns(summary, ["dataset", "model"], "model summary")
    if model == "best":
        require_columns(summary, [score], "model summary")
    rows = summary.select("dataset", "model", *([score] if score in summary.columns else [])).collect()
    known = sorted({r["dataset"] for r in rows})
    if dataset not in known:
        raise ValueError(f"dataset {dataset!r} not found; available: {known}")
    mine = [r for r in rows if r["dataset"] == dataset]
    if model != "best":
        models = sorted({r["model"] for r in mine})
        if model not in models:
            raise ValueError(f"model {model!r} not found for {dataset!r}; available: {models}")
        return model, "named by the caller"
    best = min(mine, key=lambda r: (r[score] is None, -(r[score] or 0.0), r["model"]))
    return best["model"], f"highest {score}"


def predicted_label(df: DataFrame, label: str, code: str, labels: Sequence[str]) -> Column:
    """Label column if there is one, else from the code; an error if there is neither."""
    found = optional_label(df, label, code, labels)
    if found is None:
        raise ValueError(f"predictions have neither {label!r} nor {code!r}")
    return found


def optional_label(df: DataFrame, label: str, code: str, labels: Sequence[str]) -> Column | None:
    if label in df.columns:
        return F.lower(F.col(label).cast("string"))
    if code in df.columns:
        return code_label(code, labels)
    return None


@dataclass(frozen=True)
class RankedTableSpec:
    """Column names and texts of a ranked table."""

    key: str
    labels: Sequence[str]
    predicted: tuple[str, str]
    reference: tuple[str, str]
    probabilities: tuple[str, str]
    profile: Sequence[str]
    scores: Sequence[str]
    age: str
    category: str
    index: str
    functional: str
    signals: Mapping[str, str]
    class_titles: Mapping[str, str]
    category_titles: Mapping[str, str]
    functional_titles: Sequence[str]
    no_signal: str
    not_available: str
    yes: str
    no: str
    titles: Mapping[str, str]


def ranked_table(
    profiles: DataFrame,
    scores: DataFrame,
    extracted: DataFrame,
    predictions: DataFrame,
    spec: RankedTableSpec,
    include_reference: bool = False,
    check: Sequence[str] = ("left", "right"),
    buckets: int | None = None,
    store: bool = False,
) -> DataFrame:
    """Readable table in inspection order, position first.

    Three left joins of pruned tables, an orphan guard, labels and formats; sorting uses the
    numeric values, never the formatted texts. ``store`` checkpoints the joined table, so the
    joins run once although positions read it three times.
    """
    key = spec.key
    require_columns(profiles, [key, *spec.profile], "profiles")
    require_columns(scores, [key, *spec.scores], "scores")
    require_columns(extracted, [key], "extracted markers")
    require_columns(predictions, [key], "predictions")
    marker_columns = [c for c in (spec.functional, *spec.signals) if c in extracted.columns]
    checked = refuse_orphans(predictions, profiles, key, "predictions")
    merged = join_one_to_one(checked, profiles.select(key, *spec.profile), key, "left", check)
    right = [s for s in check if s == "right"]
    merged = join_one_to_one(merged, scores.select(key, *spec.scores), key, "left", right)
    merged = join_one_to_one(merged, extracted.select(key, *marker_columns), key, "left", right)

    predicted = predicted_label(merged, *spec.predicted, spec.labels)
    if set(spec.probabilities) <= set(merged.columns):
        high = number_or(spec.probabilities[0]) + number_or(spec.probabilities[1])
        top = number_or(spec.probabilities[1])
    else:
        high = top = F.lit(None).cast("double")

    def whole(name: str) -> Column:
        return F.rint(F.col(name).try_cast("double")).cast("int")

    t = spec.titles
    functional = number_or_missing(merged, spec.functional).cast("int")
    shown = {
        t["key"]: F.col(key),
        t["predicted"]: mapped_lower(predicted, spec.class_titles),
    }
    if include_reference:
        reference = optional_label(merged, *spec.reference, spec.labels)
        if reference is None:
            raise ValueError(f"predictions have neither {spec.reference[0]!r} nor {spec.reference[1]!r}")
        shown[t["reference"]] = mapped_lower(reference, spec.class_titles)
        shown[t["agreement"]] = F.when(predicted == reference, F.lit(spec.yes)).otherwise(F.lit(spec.no))
    shown |= {
        t["high"]: percent(high, spec.not_available),
        t["top"]: percent(top, spec.not_available),
        t["age"]: whole(spec.age),
        t["category"]: mapped(spec.category, spec.category_titles),
        t["index"]: round_half_even(F.col(spec.index).try_cast("double"), 2),
        **{t[s]: whole(s) for s in spec.scores},
        t["functional"]: F.coalesce(code_label(functional, spec.functional_titles), F.lit(spec.not_available)),
        t["signals"]: active_labels(
            {label: F.col(c) for c, label in spec.signals.items() if c in merged.columns}, spec.no_signal
        ),
    }
    table = merged.select(
        *[c.alias(n) for n, c in shown.items()],
        rank_key(predicted, spec.labels, high, top, F.col(key)).alias("_rank"),
    )
    numbered = with_positions(table, F.col("_rank"), t["position"], buckets, store)
    return numbered.select(t["position"], *shown).orderBy(t["position"])
