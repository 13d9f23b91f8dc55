"""Text, label and hash column functions (native expressions)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import expr as x
from .hashing import as_column

# Characters that count as white space at the ends of a sentence.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# A sentence ends at white space after one of these marks, or at a new line.
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+|\n"


def strip(value) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(as_column(value), F.lit(WHITESPACE))


def sentences_sql(text: str) -> str:
    """SQL text of ``sentences`` for a SQL expression."""
    parts = f"split(lower(coalesce({text}, '')), {x.lit(SENTENCE_BREAK)})"
    return f"filter(transform({parts}, t -> btrim(t, {x.lit(WHITESPACE)})), t -> t <> '')"


def sentences(text: str) -> Column:
    """Lower-cased, trimmed, non-empty sentences in order, as an array."""
    return F.expr(sentences_sql(x.col(text)))


def content_hash(columns: Mapping[str, Column] | Sequence[str]) -> Column:
    """SHA-256 of the JSON of the named columns in sorted name order."""
    if not isinstance(columns, Mapping):
        columns = {c: F.col(c) for c in columns}
    record = F.struct(*[columns[name].alias(name) for name in sorted(columns)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def padded_id(prefix: str, number, width: int = 6) -> Column:
    """``<prefix>-000001`` style identifier."""
    return F.format_string(f"{prefix}-%0{width}d", as_column(number).cast("long"))


def hashed_id(prefix: str, key, digest: Column, length: int = 10) -> Column:
    """``<prefix>-<key>-<first digits of the hash>``."""
    return F.concat_ws("-", F.lit(prefix), as_column(key).cast("string"), F.substring(digest, 1, length))


def percent(p, missing: str) -> Column:
    """0.98 -> '98.0%'; NULL or NaN -> ``missing``."""
    p = as_column(p)
    tenths = F.rint(p * 100.0 * 10.0) / 10.0
    return F.when(p.isNull() | F.isnan(p), F.lit(missing)).otherwise(F.format_string("%.1f%%", tenths))


def mapped(value, labels: Mapping, default: Column | None = None) -> Column:
    """Dictionary mapping; unknown values pass through (or take ``default``)."""
    value = as_column(value)
    result = None
    for source, label in labels.items():
        test = value == F.lit(source)
        result = F.when(test, F.lit(label)) if result is None else result.when(test, F.lit(label))
    fallback = value.cast("string") if default is None else default
    return fallback if result is None else result.otherwise(fallback)


def mapped_lower(value, labels: Mapping) -> Column:
    """Mapping on the trimmed, lower-cased text; unknown values pass through unchanged."""
    value = as_column(value).cast("string")
    return mapped(F.lower(F.trim(value)), labels, default=value)


def active_labels(flags: Mapping[str, Column], empty: str, separator: str = "; ") -> Column:
    """Labels of the flags equal to 1, joined in order; ``empty`` if there are none."""
    joined = F.concat_ws(
        separator, *[F.when(flag.try_cast("double") == 1, F.lit(label)) for label, flag in flags.items()]
    )
    return F.when(joined == "", F.lit(empty)).otherwise(joined)


# Texts read as true.
TRUE_TEXTS = ("1", "true", "sim", "yes")


def truthy(value) -> Column:
    """Boolean of a text, number or boolean column; NULL is false."""
    text = F.lower(F.trim(as_column(value).cast("string")))
    return F.coalesce(text.isin(*TRUE_TEXTS), F.lit(False))


def marker_status(present, negated, remote, labels: Sequence[str]) -> Column:
    """Four-state status; labels = (present, negated, remote history, not mentioned)."""
    present, negated, remote = truthy(present), truthy(negated), truthy(remote)
    return (
        F.when(present & ~negated, F.lit(labels[0]))
        .when(negated, F.lit(labels[1]))
        .when(remote, F.lit(labels[2]))
        .otherwise(F.lit(labels[3]))
    )


def clean_section(text, header: str, other_headers: Sequence[str] = ()) -> Column:
    """Collapse white space, trim, and drop one leading ``header -`` or ``header:``."""
    collapsed = strip(F.regexp_replace(as_column(text), r"(?U)\s+", " "))
    heads = "|".join([header, *other_headers])
    return strip(F.regexp_replace(collapsed, rf"(?iu)^(?:{heads})\s*[-:]\s*", ""))


def without_code_fences(text) -> Column:
    """Drop a leading ```` ```json ```` fence and the closing fence."""
    trimmed = strip(text)
    body = F.regexp_replace(F.regexp_replace(trimmed, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(trimmed.startswith("```"), body).otherwise(trimmed)


def feature_title(
    name,
    prefixes: Sequence[str],
    titles: Mapping[str, str],
    markers: Mapping[str, str],
    qualifiers: Mapping[str, str],
    joiner: str,
) -> Column:
    """Readable feature title: strip prefixes, dictionary, marker + qualifier, capitalise."""
    cleaned = as_column(name)
    for prefix in prefixes:
        cleaned = F.when(cleaned.startswith(prefix), F.substr(cleaned, F.lit(len(prefix) + 1))).otherwise(cleaned)
    spaced = F.trim(F.regexp_replace(cleaned, "_", " "))
    fallback = F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substr(spaced, F.lit(2))))
    result = None
    for source, title in titles.items():
        test = cleaned == source
        result = F.when(test, F.lit(title)) if result is None else result.when(test, F.lit(title))
    for marker, label in markers.items():
        after = F.substring_index(cleaned, marker, -1)
        rest = F.when(F.instr(cleaned, marker) > 0, F.substr(cleaned, F.instr(cleaned, marker) + len(marker))).otherwise(after)
        qualifier = F.btrim(rest, F.lit("_"))
        shown = mapped(qualifier, qualifiers, default=F.regexp_replace(qualifier, "_", " "))
        text = F.concat(F.lit(label + joiner), shown)
        test = F.instr(cleaned, marker) > 0
        result = F.when(test, text) if result is None else result.when(test, text)
    return fallback if result is None else result.otherwise(fallback)
