"""Quality rules as a short-circuit cascade, ordered by rejection per cost, in SQL functions.

Every rule is a condition that rejects a document. On a sample each rule is timed alone, and
the sample's documents are counted by the set of rules that reject them. The order is greedy:
next comes the rule that rejects most of what the rules before it let pass, per second of its
cost. The cascade is one CASE expression, so a rule runs only on documents that all rules
before it let pass. The verdict is the same in any order; only the work differs.

The sample is bounded: about ``sample_rows`` documents by a hash of doc_id, and never more
than twice that. Everything else reads all documents, row by row and without a shuffle.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, as_row, kept, word_count

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = " \t\n\x0b\x0c\r"
_WORD_SQL = WORD.replace("\\", "\\\\")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the text, the counts of ``with_counts`` and ``_lines``."""

    name: str
    rejects: str


def _share_of_lines(condition: str, percent: int) -> str:
    return f"100 * size(filter(_lines, x -> {condition})) > {percent} * size(_lines)"


#: Limits follow published filters of web text; shares are compared in whole numbers.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * size(_lines)"),
    Rule("capitals", f"2 * (length(text) - length(translate(text, '{UPPER}', ''))) > word_chars"),
    Rule("exclamations", "5 * (length(text) - length(replace(text, '!', ''))) > n_words"),
    Rule("braces", "20 * (length(text) - length(translate(text, '{}', ''))) > n_words"),
    Rule(
        "letters",
        "10 * regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D\\\\p{L}]*\\\\p{L}[^\\\\x20\\\\x09-\\\\x0D]*')"
        " < 6 * n_words",
    ),
    Rule(
        "stutter",
        f"transform(array(regexp_extract_all(text, '{_WORD_SQL}', 0)), "
        "v -> 2 * size(filter(v, (w, i) -> w <=> get(v, i - 1))))[0] > n_words",
    ),
    Rule("ellipses", _share_of_lines("endswith(rtrim(x), '...') OR endswith(rtrim(x), '…')", 50)),
    Rule("bullets", _share_of_lines("substr(ltrim(x), 1, 1) IN ('•', '*', '-', '·')", 90)),
)


def _repeated_words(text: str) -> str:
    """Words of a text that windows of ``WINDOW`` words cover which it holds at least twice.

    All steps are bound to lambda variables, so a filter on the result that Catalyst moves
    below the projection still takes the text apart once.
    """
    hashes = f"transform(regexp_extract_all({text}, '{_WORD_SQL}', 0), w -> xxhash64(w))"
    at = ", ".join(f"get(h, i + {j})" for j in range(WINDOW))
    windows = f"transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({at}))"
    places = (
        "transform(filter(s, (x, i) -> x.h <=> get(s, i - 1).h OR x.h <=> get(s, i + 1).h), x -> x.p)"
    )
    sorted_pairs = "sort_array(transform(w, (x, i) -> named_struct('h', x, 'p', i)))"
    covered = (
        f"aggregate(transform(p, (x, i) -> least({WINDOW}, coalesce(get(p, i + 1) - x, {WINDOW}))), "
        "0L, (a, x) -> a + x)"
    )
    found = (
        f"transform(array(sort_array(transform(array({sorted_pairs}), s -> {places})[0])), "
        f"p -> {covered})[0]"
    )
    counted = (
        f"CASE WHEN size(h) <= {WINDOW} THEN 0L ELSE transform(array({windows}), w -> "
        f"CASE WHEN size(array_distinct(w)) = size(w) THEN 0L ELSE {found} END)[0] END"
    )
    return f"transform(array({hashes}), h -> {counted})[0]"


def with_counts(docs: DataFrame, carry: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _lines).

    Null texts are empty. ``_lines`` are the lines that hold a word. ``carry`` comes after.
    """
    text = F.col("text")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(text, F.lit("")).alias("text"),
        *carry,
    )
    carried = slim.columns[2:]
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    return slim.withColumn("_lines", lines).select(
        "doc_id",
        "text",
        word_count(text).alias("n_words"),
        F.length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeated_words("text")).alias("n_repeat_words"),
        "_lines",
        *carried,
    )


#: What rejects a document before any rule is asked.
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def sample_of(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` documents by a hash of doc_id, twice as many at most."""
    share = min(1.0, rows / max(1, docs.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    return docs.where(place < int(share * (1 << 30)) + 1).limit(2 * rows)


def _seconds(sample: DataFrame, condition: str, runs: int) -> float:
    best = float("inf")
    for _ in range(runs):
        start = time.perf_counter()
        sample.agg(F.count_if(F.expr(condition))).first()
        best = min(best, time.perf_counter() - start)
    return best


def estimate(
    sample: DataFrame, rules: Sequence[Rule], runs: int = 2
) -> tuple[dict[str, float], dict[int, int]]:
    """(seconds of each rule, documents by the bits of the rules that reject them).

    ``sample`` should be stored. At most one row per set of rules goes to the driver, and no
    more than the sample has documents.
    """
    idle = _seconds(sample, "n_words < 0", runs)
    costs = {r.name: max(_seconds(sample, r.rejects, runs) - idle, idle / 100) for r in rules}
    bits = " + ".join(f"CASE WHEN {r.rejects} THEN {1 << i} ELSE 0 END" for i, r in enumerate(rules))
    patterns = sample.groupBy(F.expr(bits).alias("bits")).count().collect() if rules else []
    return costs, {r["bits"]: r["count"] for r in patterns}


def cheapest_order(
    rules: Sequence[Rule], costs: Mapping[str, float], patterns: Mapping[int, int]
) -> list[Rule]:
    """Rules by rejections per second among the documents that those before let pass.

    Rules that reject nothing more come last, the cheaper ones first.
    """
    left, out, live = list(enumerate(rules)), [], dict(patterns)
    while left:
        caught = {i: sum(n for bits, n in live.items() if bits >> i & 1) for i, _ in left}
        best = max(left, key=lambda x: (caught[x[0]] / costs[x[1].name], -costs[x[1].name], -x[0]))
        left.remove(best)
        out.append(best[1])
        live = {bits: n for bits, n in live.items() if not bits >> best[0] & 1}
    return out


def cascade(rules: Sequence[Rule], first: str | None = BASE_FAILED) -> Column:
    """Name of the first rule that rejects (``base`` for ``first``), null if none does."""
    verdict = F.when(F.expr(first), F.lit("base")) if first else F.when(F.lit(False), F.lit(""))
    for r in rules:
        verdict = verdict.when(F.expr(r.rejects), F.lit(r.name))
    return verdict.otherwise(F.lit(None).cast("string"))


def planned_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000) -> list[Rule]:
    """The rules in the order that the sample of ``docs`` asks for."""
    slim = docs.select("doc_id", "text")
    sample = kept(with_counts(sample_of(slim, sample_rows)))
    return cheapest_order(rules, *estimate(sample.where(f"NOT ({BASE_FAILED})"), rules))


def judge_documents(
    docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000
) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed and kept.

    ``n_words``: runs between ASCII white space; ``word_chars``: their code points;
    ``n_symbols``: characters of ``SYMBOLS``; ``n_dup_lines``: lines with a word that equal an
    earlier line; ``n_repeat_words``: words in windows of eight words that the text holds at
    least twice. A document is kept if it does not fail the base and no rule rejects it. Null
    texts are empty and fail the base, texts of any length are read whole, equal rows are
    judged each, null ids stay null, an empty table gives no rows, further columns are not
    read. Two windows count as equal if their 64-bit hashes are.
    """
    ordered = planned_rules(docs, rules, sample_rows)
    return with_counts(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.expr(BASE_FAILED).alias("base_failed"),
        cascade(ordered).isNull().alias("kept"),
    )


def good_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns as they came."""
    ordered = planned_rules(docs, rules, sample_rows)
    counted = with_counts(docs, carry=[as_row(docs).alias("_row")])
    passed = F.when(cascade(ordered).isNull(), F.array("_row"))
    return counted.select(F.explode(passed).alias("_row")).select("_row.*")
