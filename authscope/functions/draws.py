"""Repeatable draws keyed by row, independent of partitioning and engine.

A draw is the first 32 bits of an md5 digest over ``seed:purpose:key...``. The same
text gives the same draw in any engine that has md5, on any partitioning, and again
after a lost executor recomputes the row, which ``rand(seed)`` does not promise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296.0  # 2 ** 32


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_text(*key: str | Column) -> Column:
    """The parts of a row key as one string."""
    return F.concat_ws(":", *[_col(k).cast("string") for k in key])


def digest32(*parts: str | Column) -> Column:
    """First 32 bits of the digest of ``parts`` as a long in [0, 2^32)."""
    return F.conv(F.substring(F.md5(key_text(*parts)), 1, 8), 16, 10).cast("long")


def uniform(seed: int, purpose: str, *key: str | Column) -> Column:
    """Uniform double in [0, 1) for the row named by ``key``."""
    return digest32(F.lit(f"{seed}:{purpose}"), *key) / F.lit(SPAN)


def uniform_sql(seed: int, purpose: str, *names: str) -> str:
    """The same draw as SQL text, for columns given by name."""
    text = f"concat_ws(':', '{seed}:{purpose}', {', '.join(names)})"
    return f"(cast(conv(substring(md5({text}), 1, 8), 16, 10) as bigint) / {SPAN:.1f}D)"


def numbered_draws(text: str, numbers: np.ndarray) -> np.ndarray:
    """The draws of ``text`` followed by each number, as ``uniform`` has them."""
    digests = b"".join([hashlib.md5(f"{text}{n}".encode()).digest()[:4] for n in numbers.tolist()])
    return np.frombuffer(digests, ">u4") / SPAN


def categorical(draw: Column, values: Sequence[str], weights: Sequence[float]) -> Column:
    """Pick a value by cumulative weight."""
    if len(values) != len(weights) or abs(sum(weights) - 1.0) > 1e-9:
        raise ValueError("one weight per value, adding up to 1")
    out, running = None, 0.0
    for value, weight in list(zip(values, weights))[:-1]:
        running += weight
        hit = draw < F.lit(running)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def poisson_cdf(mean: float) -> list[float]:
    """Cumulative probabilities of a Poisson count, up to where they reach 1."""
    import math

    term, total, out, k = math.exp(-mean), 0.0, [], 0
    while total < 1.0 - 1e-12:
        total += term
        out.append(min(total, 1.0))
        k += 1
        term *= mean / k
    return out


def poisson(draw: Column, mean: float) -> Column:
    """Poisson count by inverse distribution: how many cumulative steps lie at or below the draw."""
    steps = F.array(*[F.lit(p) for p in poisson_cdf(mean)])
    return F.size(F.filter(steps, lambda p: p <= draw))
