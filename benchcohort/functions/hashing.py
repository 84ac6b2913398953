"""Deterministic pseudo-random draws as Column expressions.

``h(seed, k1, k2, ...)`` is the first 32 bits of ``md5(seed:k1:k2...)`` read
as an unsigned integer; it is computed once per unit (or per replicate).
Every further draw is ``stream(base, i)``: a Weyl step followed by a 32-bit
integer finaliser — plain BIGINT arithmetic that stays in whole-stage
codegen. Draws depend only on their arguments, never on how the data is
partitioned, so resampling and splits are reproducible on any cluster shape,
survive task retries, and have an exact SQL twin (``*_sql`` functions).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0

def _poisson1_cuts() -> list[int]:
    """P(K <= k) * 2^32 of a Poisson(1) count, rounded, for every k up to the last
    that a 32-bit draw can tell apart (k = 12)."""
    cuts, p, total = [], math.exp(-1), 0.0
    for k in range(1, 14):
        total += p
        p /= k
        if (cut := round(total * TWO32)) >= TWO32:
            break
        cuts.append(cut)
    return cuts


POISSON1_CUTS = _poisson1_cuts()


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def h(seed, *keys, method: str = "md5") -> Column:
    """Unsigned 32-bit hash of (seed, *keys) as BIGINT in [0, 2^32)."""
    parts = [_as_col(seed).cast("string")] + [_as_col(k).cast("string") for k in keys]
    if method == "xxhash64":
        return F.pmod(F.xxhash64(*parts), F.lit(4294967296)).cast("bigint")
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def h_sql(seed: str, *keys: str) -> str:
    """DuckDB twin of :func:`h` (md5 method)."""
    inner = ", ".join([f"CAST({seed} AS VARCHAR)"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST('0x' || substr(md5(concat_ws(':', {inner})), 1, 8) AS BIGINT)"


# Weyl increment (golden ratio * 2^32) and the multiplier of
# the 32-bit integer finaliser (xor-shift 16, multiply, twice, xor-shift 16).
GOLDEN = 2654435769
MIX = 73244475
M32 = 4294967296


def mix32(x: Column) -> Column:
    """32-bit integer finaliser on a BIGINT in [0, 2^32): pure arithmetic, so
    it stays inside whole-stage codegen (no string hashing per draw)."""
    a = x
    for _ in range(2):
        a = (F.shiftright(a, 16).bitwiseXOR(a) * F.lit(MIX)) % F.lit(M32)
    return F.shiftright(a, 16).bitwiseXOR(a)


def stream(base: Column, i) -> Column:
    """i-th draw of the stream seeded by ``base`` (a 32-bit hash):
    mix32((base + i * GOLDEN) mod 2^32). One md5 per unit, then integers."""
    return mix32((base + _as_col(i).cast("bigint") * F.lit(GOLDEN)) % F.lit(M32))


def mix32_sql(x: str) -> str:
    step = "(xor({v} >> 16, {v}) * " + str(MIX) + ") % " + str(M32)
    inner = f"list_transform([CAST(({x}) AS BIGINT)], lambda a: {step.format(v='a')})[1]"
    mid = f"list_transform([{inner}], lambda b: {step.format(v='b')})[1]"
    return f"list_transform([{mid}], lambda c: xor(c >> 16, c))[1]"


def stream_sql(base: str, i: str) -> str:
    return mix32_sql(f"(({base}) + CAST({i} AS BIGINT) * {GOLDEN}) % {M32}")


def unit_hash(key) -> Column:
    """32-bit hash of a unit key (the base of that unit's draw stream)."""
    return h("unit", key)


def unit_hash_sql(key: str) -> str:
    return h_sql("'unit'", key)


def in_train(seed, key, train_pct: float = 0.70) -> Column:
    """Approximate-size split: train iff draw #seed of the key's stream is
    below pct * 2^32. Independent of partitioning; one md5 per row however
    many seeds are tried."""
    return stream(unit_hash(key), seed) < F.lit(int(train_pct * TWO32))


def in_train_sql(seed: str, key: str, train_pct: float = 0.70) -> str:
    return f"({stream_sql(unit_hash_sql(key), seed)} < {int(train_pct * TWO32)})"


def fold(seed, key, k: int) -> Column:
    """Cross-validation fold id in 0..k-1."""
    return F.pmod(stream(unit_hash(key), F.lit(seed) + F.lit(7919)), F.lit(k)).cast("int")


def poisson1_of(z: Column) -> Column:
    """Poisson(1) draw from a 32-bit integer by inverse CDF: the number of
    cut-offs at or below it."""
    return reduce(lambda a, b: a + b, [(z >= F.lit(cut)).cast("int") for cut in POISSON1_CUTS])


def poisson1_of_sql(z: str) -> str:
    cases = " ".join(f"WHEN d < {c} THEN {k}" for k, c in enumerate(POISSON1_CUTS))
    return f"list_transform([{z}], lambda d: CAST(CASE {cases} ELSE {len(POISSON1_CUTS)} END AS INTEGER))[1]"
