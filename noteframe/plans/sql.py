"""Pieces of the check SQL (DuckDB dialect) that several queries share."""

from __future__ import annotations

from ..functions.hashing import poisson_thresholds
from ..operators.markers import FIELDS, Ontology

WHITESPACE_SQL = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160)||chr(12288)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def alternation(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def draw(seed, salt: str, key: str) -> str:
    """Uniform draw; ``salt`` and ``key`` are SQL expressions."""
    return f"(('0x'||substr(md5('{seed}|'||{salt}||'|'||{key}),1,13))::BIGINT / 4503599627370496.0)"


def found(sentence: str, patterns, ignore_case: bool = False) -> str:
    if not patterns:
        return "FALSE"
    option = ", 'i'" if ignore_case else ""
    return f"regexp_matches({sentence}, {quoted(alternation(patterns))}{option})"


def sentence_list(text: str) -> str:
    return (
        "list_filter(list_transform(string_split(regexp_replace(lower("
        + text
        + f"),'([.!?])\\s+','\\1'||chr(10),'g'),chr(10)), lambda x: trim(x, {WHITESPACE_SQL})), lambda x: x <> '')"
    )


def extraction_ctes(
    name: str, source: str, key: str, text: str, ontology: Ontology, flip_rate: float = 0.0, seed: int = 0
) -> str:
    """CTEs ending in ``name``: long rows key, i, marker and the nine fields."""
    all_patterns = [p for m in ontology.markers for p in (*m.positive, *m.negative)]
    hits = " UNION ALL ".join(
        f"SELECT {key}, pos, s, {i} AS i, {found('s', m.negative, True)} AS neg, "
        f"{found('s', m.positive, True)} AS raw FROM {name}_sent WHERE {found('s', (*m.positive, *m.negative), True)}"
        for i, m in enumerate(ontology.markers)
    )
    values = ", ".join(f"({i}, {quoted(n)})" for i, n in enumerate(ontology.names))
    flip = f"{draw(seed, 'marker', key + '::VARCHAR')} < {flip_rate}" if flip_rate > 0 else "FALSE"
    steps = []
    for m in ontology.markers:
        for c in m.severity:
            steps.append((f"marker = {quoted(m.name)} AND regexp_matches(ev, {quoted(c.pattern)})", c))
    for c in ontology.severity_cues:
        steps.append((f"regexp_matches(ev, {quoted(c.pattern)})", c))
    d = ontology.default_severity

    def ladder(pick, absent, default):
        whens = " ".join(f"WHEN {test} THEN {pick(c)}" for test, c in steps)
        return f"CASE WHEN present = 0 THEN {absent} {whens} ELSE {default} END"

    label = ladder(lambda c: quoted(c.label), quoted(ontology.absent), quoted(d.label))
    code = ladder(lambda c: str(c.code), "0", str(d.code))
    return f"""
{name}_sent AS (
  SELECT {key}, generate_subscripts(l, 1) AS pos, unnest(l) AS s
  FROM (SELECT {key}, {sentence_list(text)} AS l FROM {source})),
{name}_hits AS (
  SELECT *, {found('s', ontology.remote_cues)} AS remote FROM ({hits})),
{name}_picks AS (
  SELECT {key}, i,
    arg_min(s, pos) FILTER (WHERE raw AND NOT neg AND NOT remote) AS cur,
    arg_min(s, pos) FILTER (WHERE neg AND NOT remote) AS den,
    arg_min(s, pos) FILTER (WHERE raw AND NOT neg AND remote) AS past
  FROM {name}_hits GROUP BY {key}, i),
{name}_all AS (
  SELECT k.{key}, m.i, m.marker, cur, den, past, coalesce(cur, den, past, '') AS ev,
    (cur IS NOT NULL OR (den IS NULL AND past IS NOT NULL))::INT AS found0
  FROM (SELECT {key} FROM {source}) k CROSS JOIN (VALUES {values}) AS m(i, marker)
  LEFT JOIN {name}_picks p ON p.{key} = k.{key} AND p.i = m.i),
{name}_flip AS (
  SELECT *, CASE WHEN {flip} THEN 1 - found0 ELSE found0 END AS present FROM {name}_all),
{name} AS (
  SELECT {key}, i, marker, present,
    (cur IS NULL AND den IS NOT NULL AND present = 0)::INT AS negated,
    (past IS NOT NULL)::INT AS remote_present,
    CASE WHEN cur IS NOT NULL OR den IS NOT NULL THEN
           CASE WHEN {found('ev', ontology.current_cues)} THEN {quoted(ontology.current)} ELSE {quoted(ontology.unspecified)} END
         WHEN past IS NOT NULL THEN {quoted(ontology.remote)} ELSE {quoted(ontology.unspecified)} END AS temporality,
    {label} AS severity, {code} AS severity_code,
    CASE WHEN {found('ev', ontology.uncertain_cues)} THEN {quoted(ontology.uncertain)} ELSE {quoted(ontology.affirmed)} END AS certainty,
    CASE WHEN {found('ev', ontology.third_party_cues)} THEN {quoted(ontology.other_experiencer)} ELSE {quoted(ontology.self_experiencer)} END AS experiencer,
    trim(concat_ws(' | ', nullif(ev, ''), CASE WHEN past <> ev THEN past END)) AS evidence
  FROM {name}_flip)"""


def wide_select(name: str, key: str, prefix: str, ontology: Ontology, fields=FIELDS) -> str:
    """SELECT that pivots long marker rows to wide columns."""
    columns = [
        f"max(CASE WHEN marker = {quoted(m)} THEN {f} END) AS {prefix}{m}_{f}" for m in ontology.names for f in fields
    ]
    return f"SELECT {key}, " + ", ".join(columns) + f" FROM {name} GROUP BY {key}"


def active(row: str, ontology: Ontology, current: bool = True) -> str:
    """0/1 activity of a long marker row alias."""
    test = (
        f"{row}.present = 1 AND {row}.negated = 0 AND {row}.certainty = {quoted(ontology.affirmed)} "
        f"AND {row}.experiencer = {quoted(ontology.self_experiencer)}"
    )
    if current:
        test += f" AND {row}.temporality = {quoted(ontology.current)}"
    return f"(CASE WHEN {test} THEN 1 ELSE 0 END)"


def kappa_sql(cells: str, group: str, left: str, right: str, weight: str) -> str:
    """SELECT group..., kappa: unweighted, NULL when the left side has fewer than two values."""
    return f"""
  SELECT {group}, CASE WHEN nl >= 2 AND pe <> 1 THEN 1 - (1 - po) / (1 - pe) END AS kappa FROM (
    SELECT {group}, sum(l * r) / (sum(l) * sum(l))::DOUBLE AS pe, count(*) FILTER (WHERE l > 0) AS nl,
      max(po) AS po
    FROM (SELECT {group}, lab, sum(l)::DOUBLE AS l, sum(r)::DOUBLE AS r FROM (
        SELECT {group}, {left} AS lab, {weight} AS l, 0 AS r FROM {cells}
        UNION ALL SELECT {group}, {right}, 0, {weight} FROM {cells}) GROUP BY {group}, lab)
    JOIN (SELECT {group}, sum(CASE WHEN {left} = {right} THEN {weight} ELSE 0 END)::DOUBLE / sum({weight}) AS po
          FROM {cells} GROUP BY {group}) USING ({group})
    GROUP BY {group})"""


def quadratic_kappa_sql(cells: str, group: str, left: str, right: str, weight: str) -> str:
    """SELECT group..., kappa with quadratic weights on the positions of the labels that occur."""
    return f"""
  SELECT {group}, CASE WHEN nl >= 2 THEN 1 - o / nullif(e, 0) END AS kappa FROM (
    SELECT {group}, sum(w * (a - b) * (a - b))::DOUBLE AS o,
      (sum(w * a * a) + sum(w * b * b) - 2.0 * sum(w * a) * sum(w * b) / sum(w))::DOUBLE AS e,
      count(DISTINCT a) AS nl
    FROM (
      SELECT c.{group.replace(', ', ', c.')}, {weight}::DOUBLE AS w, x.p::DOUBLE AS a, y.p::DOUBLE AS b
      FROM {cells} c
      JOIN (SELECT {group}, lab, row_number() OVER (PARTITION BY {group} ORDER BY lab) - 1 AS p FROM (
          SELECT {group}, {left} AS lab FROM {cells} UNION SELECT {group}, {right} FROM {cells})) x
        ON {' AND '.join(f'x.{g} = c.{g}' for g in group.split(', '))} AND x.lab = c.{left}
      JOIN (SELECT {group}, lab, row_number() OVER (PARTITION BY {group} ORDER BY lab) - 1 AS p FROM (
          SELECT {group}, {left} AS lab FROM {cells} UNION SELECT {group}, {right} FROM {cells})) y
        ON {' AND '.join(f'y.{g} = c.{g}' for g in group.split(', '))} AND y.lab = c.{right})
    GROUP BY {group})"""


def rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def poisson_digits(seed: int, key: str, repetition: str = "repetition") -> str:
    """SQL of the eight hash digits that decide a key's weight in a replicate."""
    return f"substr(md5('{seed}|'||({repetition} // 4)||'|'||{key}), 1 + 8 * ({repetition} % 4), 8)"


def poisson_case(digits: str) -> str:
    points = poisson_thresholds()
    return "CASE " + " ".join(f"WHEN {digits} < '{p}' THEN {k}" for k, p in enumerate(points)) + f" ELSE {len(points)} END"
