"""Reproducible randomness: every draw is a hash of (seed, salt, key).

A draw depends only on the row's key, so it is the same under any partitioning,
after a task is retried, and on any cluster size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import expr

# Stage offsets added to the base seed.
STAGE_OFFSETS = {
    "profiles": 0,
    "scores": 1000,
    "text": 2000,
    "label": 3000,
    "extraction": 4000,
    "annotation": 5000,
    "missingness": 5000,
    "bootstrap": 6000,
}


def stage_seed(base_seed: int, stage: str, replicate: int = 0) -> int:
    """Seed of one stage of one replicate."""
    return int(base_seed) + int(replicate) + STAGE_OFFSETS[stage]


def as_column(value) -> Column:
    """Column, column name or literal (numbers) as a Column."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def uniform(seed, key, salt="") -> Column:
    """Uniform draw in [0, 1) from the first 52 bits of md5(seed|salt|key).

    ``key`` is a column name or Column, ``salt`` text or a Column (for example a replicate
    number), ``seed`` a number or a Column.
    """
    if isinstance(key, str) and not isinstance(salt, Column) and not isinstance(seed, Column):
        return F.expr(expr.uniform(expr.lit(str(seed)), expr.lit(str(salt)), expr.col(key)))
    parts = [
        seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)),
        salt.cast("string") if isinstance(salt, Column) else F.lit(str(salt)),
        as_column(key).cast("string"),
    ]
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def normal(seed, key, salt="") -> Column:
    """Standard normal draw (Box-Muller on two uniforms)."""
    first = F.lit(1.0) - uniform(seed, key, f"{salt}/r")
    second = uniform(seed, key, f"{salt}/t")
    return F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(2.0 * math.pi) * second)


def poisson_cut_points(n: int = 12) -> list[float]:
    """Cumulative Poisson(1) probabilities for 0..n-1."""
    points, total = [], 0.0
    for k in range(n):
        total += math.exp(-1.0) / math.factorial(k)
        points.append(total)
    return points


DRAWS_PER_HASH = 4


def poisson_thresholds() -> list[str]:
    """Cumulative Poisson(1) probabilities as 8 hex digits (32 bits)."""
    return [format(min(int(p * 2**32), 2**32 - 1), "08x") for p in poisson_cut_points()]


def poisson_case(digits: str) -> str:
    """SQL: Poisson(1) count for 8 hex digits of a hash, by text comparison."""
    points = poisson_thresholds()
    steps = [(f"{digits} < {expr.lit(p)}", str(k)) for k, p in enumerate(points)]
    return expr.case(steps, str(len(points)))


def poisson_weights(seed: int, key: str, repetitions: int) -> Column:
    """Array of the weights of ``poisson_draws`` in all replicates, zeros included."""
    blocks = -(-repetitions // DRAWS_PER_HASH)
    text = f"md5(concat_ws('|', {expr.lit(str(seed))}, string(b), string({expr.col(key)})))"
    weights = ", ".join(poisson_case(f"substring(m, {8 * j + 1}, 8)") for j in range(DRAWS_PER_HASH))
    # the hash is an array of its own, so that it is computed once
    return F.expr(
        f"slice(flatten(transform(transform(sequence(0, {blocks - 1}), b -> {text}), m -> array({weights}))), 1, {repetitions})"
    )


def poisson_draws(seed: int, key: str, repetitions: int) -> Column:
    """Array of (repetition, w) with w > 0: in which replicates a key enters, and how often.

    One hash serves four replicates (32 bits each): replicate r reads digits 8 * (r % 4)
    onwards of md5(seed|r div 4|key).
    """
    blocks = -(-repetitions // DRAWS_PER_HASH)
    text = f"md5(concat_ws('|', {expr.lit(str(seed))}, string(b), string({expr.col(key)})))"
    weights = ", ".join(
        expr.struct(
            [
                ("repetition", f"int(h.b * {DRAWS_PER_HASH} + {j})"),
                ("w", poisson_case(f"substring(h.m, {8 * j + 1}, 8)")),
            ]
        )
        for j in range(DRAWS_PER_HASH)
    )
    hashes = f"transform(sequence(0, {blocks - 1}), b -> named_struct('b', b, 'm', {text}))"
    every = f"flatten(transform({hashes}, h -> array({weights})))"
    return F.expr(f"filter({every}, d -> d.w > 0 AND d.repetition < {repetitions})")
