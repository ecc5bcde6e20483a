"""Mergeable sketches: stored once for small windows, merged for wider ones, without a rescan.

A distinct count or a quantile over a month needs no second look at the log: sketches of its
hours are kept as a table and united. Sketches of a window are merged on the map side, so
a source that holds much of the log hands on a few sketches.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.functions.durations import duration_seconds
from authscope.functions.scalars import flag, floor_time, ratio, success_after_fail
from authscope.operators.features import DIMENSIONS, DISTINCT_NAMES, group_keys
from authscope.schemas import DEFAULT_MIN_FAIL

SKETCH_BITS = 14
#: Rank error of a quantile sketch of size k: RANK_ERROR[0] / k ** RANK_ERROR[1].
RANK_ERROR = (2.296, 0.9723)
MAX_SKETCH = 65535


def distinct_error(bits: int = SKETCH_BITS) -> float:
    """One standard error of a sketched distinct count, as a share of it."""
    return 1.04 / math.sqrt(2**bits)


def window_sketches(logs: DataFrame, window: str = "1h", by_app: bool = False, bits: int = SKETCH_BITS) -> DataFrame:
    """Counts and a sketch of each counted column, by source and small window: a table to store.

    Rows without a source are left out; a column without a value gives an empty sketch.
    """
    keys = group_keys(by_app)
    present = [c for c in DIMENSIONS if c in logs.columns]
    return (
        logs.dropna(subset=keys)
        .groupBy(*keys, floor_time(F.col("ts"), window).alias("ts"))
        .agg(
            F.count(F.lit(1)).alias("n_attempts"),
            F.sum(flag(F.col("result") == "fail")).alias("n_fail"),
            F.sum(flag(F.col("result") == "success")).alias("n_success"),
            *[F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(f"{DISTINCT_NAMES[c]}_sketch") for c in present],
        )
    )


def features_of_sketches(
    sketches: DataFrame, window: str, stored: str = "1h", by_app: bool = False, min_fail: int = DEFAULT_MIN_FAIL
) -> DataFrame:
    """Window features of wider windows from a table of ``window_sketches``, entropy apart.

    ``window`` is a whole number of the ``stored`` windows.
    """
    if duration_seconds(window) % duration_seconds(stored):
        raise ValueError(f"{window} is no whole number of windows of {stored}")
    keys, minutes = group_keys(by_app), duration_seconds(window) / 60.0
    names = [n for n in DISTINCT_NAMES.values() if f"{n}_sketch" in sketches.columns]
    counts = sketches.groupBy(*keys, floor_time(F.col("ts"), window).alias("ts")).agg(
        *[F.sum(c).alias(c) for c in ("n_attempts", "n_fail", "n_success")],
        *[F.hll_sketch_estimate(F.hll_union_agg(f"{n}_sketch")).alias(n) for n in names],
    )
    return counts.select(
        "*",
        ratio(F.col("n_fail"), F.col("n_attempts")).alias("fail_rate"),
        (F.col("n_attempts") / F.lit(minutes)).alias("attempts_per_min"),
        success_after_fail(F.col("n_success"), F.col("n_fail"), min_fail).alias("success_after_fail"),
    )


def sketch_size(error: float) -> int:
    """Size of a quantile sketch whose ranks are off by at most this share of the rows (99 %)."""
    if not 0 < error < 1:
        raise ValueError("an error is a share of the rows")
    size = math.ceil((RANK_ERROR[0] / error) ** (1 / RANK_ERROR[1]))
    if size > MAX_SKETCH:
        raise ValueError(f"an error of {error} needs a sketch beyond {MAX_SKETCH}: take the exact quantile")
    return max(8, size)


def sketched_quantile(df: DataFrame, column: str, share: float, error: float = 0.001) -> float | None:
    """A value whose rank is within ``error`` of ``share``, in one pass. Null and NaN are left out."""
    value = F.col(column).cast("double")
    held = df.select(value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sketch = F.kll_sketch_agg_double("v", sketch_size(error))
    found = held.agg(F.count("v").alias("n"), sketch.alias("sketch"))
    found = found.select(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(share)))).alias("q"))
    return found.first()["q"]
