"""Seeded randomness from a row's key, so that results do not depend on partitioning or on task retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32_digits(*parts: Column | str, seed: int | str) -> Column:
    """``hash32`` as eight hexadecimal digits, which sort alike."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in columns], F.lit(str(seed)))
    return F.substring(F.md5(text), 1, 8)


def hash32(*parts: Column | str, seed: int | str) -> Column:
    """32-bit hash of the given columns and the seed, as a long."""
    return F.conv(hash32_digits(*parts, seed=seed), 16, 10).cast("long")


def hash_uniform(*parts: Column | str, seed: int | str) -> Column:
    """Uniform number in [0, 1)."""
    return hash32(*parts, seed=seed) / F.lit(4294967296.0)


def hash_normal(*parts: Column | str, seed: int | str) -> Column:
    """Standard normal number, from two uniforms (Box-Muller)."""
    u = hash_uniform(*parts, seed=f"{seed}a")
    v = hash_uniform(*parts, seed=f"{seed}b")
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(F.lit(2.0 * math.pi) * v)


def hash_pick(values: list[str], *parts: Column | str, seed: int | str) -> Column:
    """One of ``values``."""
    position = hash32(*parts, seed=seed) % F.lit(len(values))
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))
