"""SQL text pieces for large generated expressions.

Operators that build hundreds of sub-expressions (90 marker columns, cue ladders) write
them as SQL text: one parse instead of one gateway call per node.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence


def lit(value) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str) -> str:
    """Quoted column name."""
    return "`" + name.replace("`", "``") + "`"


def any_true(tests: Iterable[str]) -> str:
    tests = list(tests)
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def all_true(tests: Iterable[str]) -> str:
    tests = list(tests)
    return "(" + " AND ".join(tests) + ")" if tests else "true"


def case(steps: Iterable[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"WHEN {test} THEN {value}" for test, value in steps)
    return f"(CASE {whens} ELSE {default} END)" if whens else default


def struct(fields: Iterable[tuple[str, str]]) -> str:
    return "named_struct(" + ", ".join(f"{lit(n)}, {v}" for n, v in fields) + ")"


def number(value: str, default: float = 0.0) -> str:
    """Numeric value of an expression; ``default`` for NULL, NaN and text that is no number."""
    return f"coalesce(nullif(try_cast({value} AS DOUBLE), double('NaN')), {lit(float(default))})"


def one_of(value: str, choices: Sequence) -> str:
    return f"({value} IN (" + ", ".join(lit(c) for c in choices) + "))"


def uniform(seed: str, salt: str, key: str) -> str:
    """Uniform draw; the arguments are SQL expressions (see ``hashing.uniform``)."""
    text = f"concat_ws('|', string({seed}), string({salt}), string({key}))"
    return f"(double(conv(substring(md5({text}), 1, 13), 16, 10)) / 4503599627370496D)"


# Patterns without any operator: found by a byte search instead of a regex engine.
_PLAIN = re.compile(r"[A-Za-z0-9 À-ÖØ-öø-ÿ@,;:=_#%&/'-]+")
LONG_S = "ſ"  # the one letter that equals a plain one only when case is ignored


def found(text: str, patterns: Sequence[str], ignore_case: bool) -> str:
    """True if any pattern is found in lower-cased ``text``.

    Plain patterns are byte searches; the others form one alternation. With
    ``ignore_case`` a text that holds a long s takes the regex path, so that both paths
    agree on every text.
    """
    if not patterns:
        return "false"
    plain = [p for p in patterns if _PLAIN.fullmatch(p)]
    other = [p for p in patterns if not _PLAIN.fullmatch(p)]
    flags = "(?iu)" if ignore_case else ""
    tests = [f"contains({text}, {lit(p.lower() if ignore_case else p)})" for p in plain]
    if other:
        tests.append(f"rlike({text}, {lit(flags + alternation(other))})")
    if ignore_case and any("s" in p.lower() for p in plain):
        tests.append(f"(contains({text}, {lit(LONG_S)}) AND rlike({text}, {lit(flags + alternation(plain))}))")
    return any_true(tests)


def alternation(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)
