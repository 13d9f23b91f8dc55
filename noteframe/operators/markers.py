"""Qualified markers: naming, normalisation, wide and nested forms, activity.

The nested form is one ``markers`` array per key, in ontology order, of structs with the
nine ``FIELDS``. It keeps one row per key, so long rows (explode) and the wide form (one
column per marker and field) are both local projections.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as x
from ..functions.text import WHITESPACE, clean_section, marker_status, without_code_fences
from .contracts import guard
from .joins import join_one_to_one

# Field names of the marker record.
BINARY_FIELDS = ("present", "negated", "remote_present")
CATEGORY_FIELDS = ("temporality", "severity", "certainty", "experiencer")
FEATURE_FIELDS = (
    "present",
    "negated",
    "remote_present",
    "temporality",
    "severity",
    "severity_code",
    "certainty",
    "experiencer",
)
FIELDS = (*FEATURE_FIELDS, "evidence")
INTEGER_FIELDS = (*BINARY_FIELDS, "severity_code")


@dataclass(frozen=True)
class Cue:
    """A pattern with the severity label and code it stands for."""

    pattern: str
    label: str
    code: int


@dataclass(frozen=True)
class MarkerSpec:
    """One marker: patterns of a mention, patterns of its denial, own severity cues."""

    name: str
    positive: tuple[str, ...]
    negative: tuple[str, ...] = ()
    severity: tuple[Cue, ...] = ()
    graded: bool = False


@dataclass(frozen=True)
class Ontology:
    """Closed set of markers with the cue lists and the closed value lists."""

    version: str
    markers: tuple[MarkerSpec, ...]
    remote_cues: tuple[str, ...]
    current_cues: tuple[str, ...]
    severity_cues: tuple[Cue, ...]
    uncertain_cues: tuple[str, ...]
    third_party_cues: tuple[str, ...]
    current: str = "current"
    remote: str = "remote"
    unspecified: str = "unspecified"
    absent: str = "absent"
    default_severity: Cue = Cue("", "mild", 1)
    scalar_severity: tuple[str, ...] = ("absent", "mild", "moderate", "severe")
    severities: tuple[str, ...] = ("absent", "mild", "moderate", "severe", "unspecified")
    affirmed: str = "affirmed"
    uncertain: str = "uncertain"
    self_experiencer: str = "self"
    other_experiencer: str = "other"
    defaults: Mapping[str, object] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(
            self,
            "defaults",
            {
                "present": 0,
                "negated": 0,
                "remote_present": 0,
                "temporality": self.unspecified,
                "severity": self.absent,
                "severity_code": 0,
                "certainty": self.affirmed,
                "experiencer": self.self_experiencer,
                "evidence": "",
            },
        )

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(m.name for m in self.markers)

    @property
    def closed_values(self) -> dict[str, tuple[str, ...]]:
        return {
            "temporality": (self.current, self.remote, self.unspecified),
            "severity": self.severities,
            "certainty": (self.affirmed, self.uncertain),
            "experiencer": (self.self_experiencer, self.other_experiencer),
        }


def marker_column(prefix: str, marker: str, name: str) -> str:
    return f"{prefix}{marker}_{name}"


def marker_columns(prefix: str, ontology: Ontology, fields: Sequence[str] = FIELDS) -> list[str]:
    """Wide column names in stable order."""
    return [marker_column(prefix, m, f) for m in ontology.names for f in fields]


def _struct(marker: str, values: Mapping[str, str]) -> str:
    """SQL struct of a marker record from SQL expressions per field."""
    return x.struct(
        [("marker", marker)]
        + [(f, f"int({values[f]})" if f in INTEGER_FIELDS else f"string({values[f]})") for f in FIELDS]
    )


def default_markers(ontology: Ontology) -> str:
    """SQL array of all markers with every field at its default."""
    defaults = {f: x.lit(ontology.defaults[f]) for f in FIELDS}
    return "array(" + ", ".join(_struct(x.lit(n), defaults) for n in ontology.names) + ")"


def _flag(raw: str) -> str:
    """0/1 of a raw text value: everything but empty, zero and false counts as set."""
    return f"int(NOT lower(trim({raw})) IN ('', '0', '0.0', 'false', 'null', 'nan'))"


def normalized_marker(spec: MarkerSpec, raw: Mapping[str, str], ontology: Ontology) -> tuple[str, str]:
    """(marker struct, array of violations) as SQL; ``raw`` maps fields to SQL expressions.

    Missing and NULL fields take their default.
    """
    values = {
        f: f"coalesce(string({raw[f]}), {x.lit(str(ontology.defaults[f]))})" if f in raw else x.lit(str(ontology.defaults[f]))
        for f in FIELDS
    }
    fields = dict(values)
    for f in BINARY_FIELDS:
        fields[f] = _flag(values[f])
    fields["severity_code"] = f"floor(try_cast({values['severity_code']} AS DOUBLE))"
    fields["evidence"] = f"btrim({values['evidence']}, {x.lit(WHITESPACE)})"
    closed = ontology.closed_values
    code = f"int({fields['severity_code']})"
    problems = [
        f"CASE WHEN {fields['present']} = 1 AND {fields['negated']} = 1 THEN {x.lit(spec.name + '.present_and_negated')} END"
    ]
    problems += [
        f"CASE WHEN NOT {x.one_of(values[f], closed[f])} THEN {x.lit(f'{spec.name}.{f}')} END" for f in CATEGORY_FIELDS
    ]
    problems.append(
        f"CASE WHEN {code} IS NULL OR NOT {x.one_of(code, (0, 1, 2, 3))} THEN {x.lit(spec.name + '.severity_code')} END"
    )
    return _struct(x.lit(spec.name), fields), f"array_compact(array({', '.join(problems)}))"


def scalar_marker(spec: MarkerSpec, value: str, ontology: Ontology) -> tuple[str, str]:
    """Old scalar form 0..3: presence, and a severity code if the marker is graded."""
    number = f"try_cast({value} AS INT)"
    present = f"int(coalesce({number} > 0, false))"
    code = number if spec.graded else present
    labels = ", ".join(x.lit(s) for s in ontology.scalar_severity)
    label = f"get(array({labels}), {code})"
    fields = {f: x.lit(ontology.defaults[f]) for f in FIELDS}
    fields |= {"present": present, "severity": label, "severity_code": code}
    wrong = f"CASE WHEN {number} IS NULL OR {label} IS NULL THEN {x.lit(spec.name + '.scalar')} END"
    return _struct(x.lit(spec.name), fields), f"array_compact(array({wrong}))"


def normalize_markers(
    df: DataFrame, raw: str, ontology: Ontology, out: str = "markers", problems: str = "violations"
) -> DataFrame:
    """Map marker -> JSON text (object or scalar) to the nested form plus all violations.

    ``violations`` holds ``marker.problem`` texts (``name.unknown`` for a marker that the
    ontology lacks); an empty array means the row is valid.
    """
    r = x.col(raw)
    parsed = x.struct(
        [
            (
                spec.name,
                x.struct(
                    [
                        ("text", f"{r}[{x.lit(spec.name)}]"),
                        ("fields", f"from_json({r}[{x.lit(spec.name)}], 'map<string,string>')"),
                    ]
                ),
            )
            for spec in ontology.markers
        ]
    )
    staged = df.withColumn("_raw", F.expr(parsed))
    structs, wrong = [], []
    for spec in ontology.markers:
        text, fields = f"_raw.{x.col(spec.name)}.text", f"_raw.{x.col(spec.name)}.fields"
        is_object = f"({text} IS NULL OR startswith(ltrim({text}), '{{'))"
        full, full_problems = normalized_marker(spec, {f: f"{fields}[{x.lit(f)}]" for f in FIELDS}, ontology)
        scalar, scalar_problems = scalar_marker(spec, text, ontology)
        structs.append(f"CASE WHEN {is_object} THEN {full} ELSE {scalar} END")
        wrong.append(f"CASE WHEN {is_object} THEN {full_problems} ELSE {scalar_problems} END")
    known = ", ".join(x.lit(spec.name) for spec in ontology.markers)
    strange = f"filter(map_keys({r}), k -> k NOT IN ({known}))"
    wrong.append(f"coalesce(transform({strange}, k -> concat(k, '.unknown')), array())")
    return staged.withColumns(
        {out: F.expr(f"array({', '.join(structs)})"), problems: F.expr(f"flatten(array({', '.join(wrong)}))")}
    ).drop("_raw")


def strict(df: DataFrame, problems: str = "violations") -> DataFrame:
    """Fail the query at the first row with a violation."""
    checked = guard(
        df, F.size(problems) == 0, F.concat(F.lit("invalid markers: "), F.array_join(problems, ", "))
    )
    return checked.drop(problems)


def quarantine(df: DataFrame, problems: str = "violations") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with their violations)."""
    return df.where(F.size(problems) == 0).drop(problems), df.where(F.size(problems) > 0)


def parse_replies(
    df: DataFrame, key: str, reply: str, ontology: Ontology, constants: Mapping[str, object], retries: str | None = None
) -> DataFrame:
    """Column of JSON replies -> nested markers and a status; a bad reply gives defaults.

    The reply may be wrapped in code fences; it must be an object with an object
    ``markers`` whose entries obey the marker contract.
    """
    staged = df.select(
        key,
        F.from_json(without_code_fences(F.col(reply)), "struct<markers:map<string,string>>")["markers"].alias("_map"),
        F.sha2(F.coalesce(F.col(reply), F.lit("")), 256).alias("reply_hash"),
        (F.col(retries) if retries else F.lit(0)).cast("int").alias("retry_count"),
    )
    normal = normalize_markers(staged, "_map", ontology)
    ok = "(_map IS NOT NULL AND size(violations) = 0)"
    return normal.selectExpr(
        x.col(key),
        *[f"{x.lit(v)} AS {x.col(n)}" for n, v in constants.items()],
        f"CASE WHEN {ok} THEN 'success' ELSE 'failed' END AS extraction_status",
        "retry_count",
        f"CASE WHEN {ok} THEN reply_hash ELSE '' END AS reply_hash",
        f"CASE WHEN {ok} THEN markers ELSE {default_markers(ontology)} END AS markers",
    )


def parse_section_replies(
    df: DataFrame, key: str, reply: str, sections: Mapping[str, Sequence[str]], retries: str | None = None
) -> DataFrame:
    """Column of JSON replies with text sections -> one column per section and a status.

    The reply may be wrapped in code fences; it must be an object in which every section is a
    text (other values count by their JSON text) that is not empty after white space is
    collapsed and a leading header (the section's name or one in ``sections``) is dropped. A bad reply gives empty sections and
    ``failed`` with the sections at fault (``reply`` where there is no object).
    """
    parsed = F.from_json(without_code_fences(F.col(reply)), "map<string,string>")
    staged = df.select(
        key, parsed.alias("_map"), (F.col(retries) if retries else F.lit(0)).cast("int").alias("retry_count")
    )
    for i, (name, headers) in enumerate(sections.items()):
        text = clean_section(F.col("_map")[name], name, headers)
        staged = staged.withColumn(f"_s{i}", F.coalesce(text, F.lit("")))
    empty = [F.when(F.col(f"_s{i}") == "", F.lit(n)) for i, n in enumerate(sections)]
    faults = F.when(F.col("_map").isNull(), F.array(F.lit("reply"))).otherwise(F.array_compact(F.array(*empty)))
    checked = staged.withColumn("faults", faults)
    ok = F.size("faults") == 0
    return checked.select(
        key,
        F.when(ok, "success").otherwise("failed").alias("status"),
        "retry_count",
        "faults",
        *[F.when(ok, F.col(f"_s{i}")).otherwise("").alias(n) for i, n in enumerate(sections)],
    )


def markers_from_wide(
    df: DataFrame, prefix: str, ontology: Ontology, out: str = "markers", problems: str | None = None
) -> DataFrame:
    """Wide columns -> nested form; NULL fields and absent columns take their default."""
    structs, wrong = [], []
    have = set(df.columns)
    for spec in ontology.markers:
        names = {f: marker_column(prefix, spec.name, f) for f in FIELDS}
        struct, bad = normalized_marker(spec, {f: x.col(n) for f, n in names.items() if n in have}, ontology)
        structs.append(struct)
        wrong.append(bad)
    columns = {out: F.expr(f"array({', '.join(structs)})")}
    if problems:
        columns[problems] = F.expr(f"flatten(array({', '.join(wrong)}))")
    return df.withColumns(columns)


def markers_wide(
    df: DataFrame, prefix: str, ontology: Ontology, fields: Sequence[str] = FIELDS, markers: str = "markers"
) -> DataFrame:
    """Nested form -> one column per marker and field, in fixed order."""
    others = [x.col(c) for c in df.columns if c != markers]
    wide = [
        f"get({x.col(markers)}, {i}).{f} AS {x.col(marker_column(prefix, name, f))}"
        for i, name in enumerate(ontology.names)
        for f in fields
    ]
    return df.selectExpr(*others, *wide)


def markers_long(df: DataFrame, markers: str = "markers") -> DataFrame:
    """Nested form -> one row per key and marker.

    The nested form always holds every marker; the outer form of ``inline`` only keeps the
    planner from inferring a size filter, which would evaluate the array twice.
    """
    others = [c for c in df.columns if c != markers]
    return df.select(*others, F.inline_outer(markers))


def active_sql(
    columns: Sequence[str], prefix: str, marker: str, ontology: Ontology, require_current: bool = False
) -> str:
    """SQL of ``marker_is_active``."""

    def value(f: str) -> str:
        name, default = marker_column(prefix, marker, f), x.lit(ontology.defaults[f])
        return f"coalesce({x.col(name)}, {default})" if name in columns else default

    def number(f: str) -> str:
        name = marker_column(prefix, marker, f)
        return f"int({x.number(x.col(name))})" if name in columns else "0"

    tests = [
        f"{number('present')} = 1",
        f"{number('negated')} = 0",
        f"{value('certainty')} = {x.lit(ontology.affirmed)}",
        f"{value('experiencer')} = {x.lit(ontology.self_experiencer)}",
    ]
    if require_current:
        tests.append(f"{value('temporality')} = {x.lit(ontology.current)}")
    return x.all_true(tests)


def marker_is_active(
    columns: Sequence[str], prefix: str, marker: str, ontology: Ontology, require_current: bool = False
) -> Column:
    """Present, not denied, affirmed, of the subject itself and (if asked) current."""
    return F.expr(active_sql(columns, prefix, marker, ontology, require_current))


def reference_table(df: DataFrame, key: str, prefix: str, ontology: Ontology) -> DataFrame:
    """Source markers in the extractor's schema; presence may fall back to ``<prefix><marker>`` > 0."""
    have, out = set(df.columns), [x.col(key)]
    for name in ontology.names:
        for f in FIELDS:
            source = marker_column(prefix, name, f)
            if source in have:
                value = x.col(source)
            elif f == "present" and f"{prefix}{name}" in have:
                value = f"int({x.number(x.col(prefix + name))} > 0)"
            else:
                value = x.lit(ontology.defaults[f])
            out.append(f"{value} AS {x.col(source)}")
    return df.selectExpr(*out)


def paired_markers(
    reference: DataFrame, predicted: DataFrame, key: str, check: Sequence[str] = ("left", "right"), keep: Sequence[str] = ()
) -> DataFrame:
    """One row per key and marker with both records: ``ref_<field>`` and ``pred_<field>``.

    One join on the key of the nested forms; the markers are unfolded after it, so the
    shuffle carries one row per key instead of one per marker.
    """
    left = reference.select(key, F.col("markers").alias("_ref"))
    right = predicted.select(key, *keep, F.col("markers").alias("_pred"))
    joined = join_one_to_one(left, right, key, "inner", check)
    return joined.select(key, *keep, F.inline_outer(F.expr(_zipped("_ref", "_pred"))))


def _zipped(ref: str, pred: str, fields: Sequence[str] = FIELDS) -> str:
    """Two nested marker columns as one array of records with ``ref_`` and ``pred_`` fields."""
    record = x.struct(
        [("marker", "r.marker")]
        + [(f"ref_{f}", f"r.{f}") for f in fields]
        + [(f"pred_{f}", f"p.{f}") for f in fields]
    )
    return f"zip_with({ref}, {pred}, (r, p) -> {record})"


def paired_columns(
    df: DataFrame,
    key: str,
    reference: str,
    predicted: Sequence[str],
    fields: Sequence[str] = FIELDS,
    name: str = "extractor",
) -> DataFrame:
    """The rows of ``paired_markers`` from nested columns of one row, without a join.

    Each ``predicted`` column is compared with ``reference``; its name stands in ``name``.
    Fields that are not listed are not read.
    """
    cells = ", ".join(
        x.struct([("_name", x.lit(p)), ("_pairs", _zipped(x.col(reference), x.col(p), fields))]) for p in predicted
    )
    per_run = df.select(key, F.inline(F.expr(f"array({cells})")))
    return per_run.select(key, F.col("_name").alias(name), F.inline_outer("_pairs"))


def marker_comparison(
    pairs: DataFrame, key: str, labels: Sequence[str], yes: str = "yes", no: str = "no", keep: Sequence[str] = ()
) -> DataFrame:
    """Status on both sides, agreement, and the extracted qualifiers, for every key and marker."""
    origin = marker_status("ref_present", "ref_negated", "ref_remote_present", labels)
    found = marker_status("pred_present", "pred_negated", "pred_remote_present", labels)
    return pairs.select(
        *keep,
        key,
        "marker",
        origin.alias("origin_status"),
        found.alias("extracted_status"),
        F.when(origin == found, F.lit(yes)).otherwise(F.lit(no)).alias("agreement"),
        F.col("pred_temporality").alias("temporality"),
        F.col("pred_severity").alias("severity"),
        F.col("pred_certainty").alias("certainty"),
        F.col("pred_experiencer").alias("experiencer"),
        F.col("pred_evidence").alias("evidence"),
    )
