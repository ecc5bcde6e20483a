"""Exact order statistics by repeated histograms.

The built-in ``percentile`` keeps every distinct value in one aggregation buffer, which is
the whole column for continuous scores. Here each pass counts at most ``BINS`` ranges per
wanted rank and then looks only at the range that holds it, so no task or driver holds more
than that whatever the size of the data. Repeated values end a search at once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, NaN as null."""
    picked = [F.col(c).cast("double") for c in columns]
    return df.select(*[F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(picked)])


class _Ends(NamedTuple):
    """Values of a column: how many, how many below and above all finite ones, and the finite range."""

    n: int
    n_below: int
    n_above: int
    lo: float | None
    hi: float | None


def _ends(values: DataFrame, width: int) -> list[_Ends]:
    aggs = []
    for i in range(width):
        v = F.col(f"v{i}")
        finite = F.when(F.abs(v) < math.inf, v)
        aggs += [F.count(v), F.count_if(v == -math.inf), F.count_if(v == math.inf), F.min(finite), F.max(finite)]
    row = values.agg(*aggs).first()
    return [_Ends(*row[5 * i : 5 * i + 5]) for i in range(width)]


def _at_ranks(values: DataFrame, ends: list[_Ends], wanted: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Value at each (column, zero-based rank). All searches share their passes.

    Infinities are set aside by their counts; only finite values are searched.
    """
    found: dict[tuple[int, int], float] = {}
    search = {}
    for i, rank in wanted:
        n, n_below, n_above, lo, hi = ends[i]
        if rank < n_below:
            found[i, rank] = -math.inf
        elif rank >= n - n_above:
            found[i, rank] = math.inf
        elif lo == hi:
            found[i, rank] = lo
        else:
            search[i, rank] = (lo, hi, n_below)
    while search:
        ranges = {key: n for n, key in enumerate({(i, lo, hi) for (i, _), (lo, hi, _) in search.items()})}
        slots = []
        for (i, lo, hi), n in ranges.items():
            v, width = F.col(f"v{i}"), hi / BINS - lo / BINS  # the whole range may be beyond a double
            slot = F.least(F.lit(BINS - 1.0), F.floor(v / F.lit(width) - F.lit(lo / width)).cast("double")) if width > 0 else v
            inside = (v >= lo) & (v <= hi)
            slots.append(F.when(inside, F.struct(F.lit(n).alias("range"), slot.alias("bin"), v.alias("v"))))
        bins = (
            values.select(F.explode(F.array_compact(F.array(*slots))).alias("s"))
            .groupBy("s.range", "s.bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("s.v").alias("lo"), F.max("s.v").alias("hi"))
            .collect()
        )
        by_range: dict[int, list] = {n: [] for n in ranges.values()}
        for b in sorted(bins, key=lambda b: (b["range"], b["bin"])):
            by_range[b["range"]].append(b)
        for (i, rank), (lo, hi, below) in list(search.items()):
            for b in by_range[ranges[i, lo, hi]]:
                if rank < below + b["n"]:
                    break
                below += b["n"]
            else:
                raise ValueError("values changed between passes; write them first")
            if (b["lo"], b["hi"]) == (lo, hi):
                raise ValueError("the search for a rank does not narrow")
            if b["lo"] == b["hi"]:
                found[i, rank] = b["lo"]
                del search[i, rank]
            else:
                search[i, rank] = (b["lo"], b["hi"], below)
    return found


def exact_percentiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[tuple[str, float], float | None]:
    """For each column and share, linear interpolation between the two ranks around it.

    Null and NaN are left out, infinities count; a column without values gives None. Between
    two values whose difference is beyond a double the result is infinite, between the two
    infinities it is NaN.
    """
    columns = list(wanted)
    values = _numbers(df, columns)
    ends = _ends(values, len(columns))
    places = {(i, s): (ends[i].n - 1) * s for i, c in enumerate(columns) for s in wanted[c] if ends[i].n}
    ranks = {(i, r) for (i, _), p in places.items() for r in (math.floor(p), math.ceil(p))}
    found = _at_ranks(values, ends, ranks)
    out: dict[tuple[str, float], float | None] = {(c, s): None for c in columns for s in wanted[c]}
    for (i, s), p in places.items():
        low, high, part = found[i, math.floor(p)], found[i, math.ceil(p)], p - math.floor(p)
        out[columns[i], s] = low if low == high or not part else low + (high - low) * part
    return out


def exact_percentile(df: DataFrame, column: str, share: float) -> float | None:
    return exact_percentiles(df, {column: [share]})[column, share]


def value_at_rank(df: DataFrame, column: str, rank: int) -> float | None:
    """The value with ``rank`` values before it in ascending order, None beyond the end."""
    values = _numbers(df, [column])
    ends = _ends(values, 1)
    if not 0 <= rank < ends[0].n:
        return None
    return _at_ranks(values, ends, {(0, rank)})[0, rank]


def bounded_rows(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest values of a unique numeric column.

    A filter at the exact cut value: nothing is gathered and the filter reaches the scan.
    Numbers beyond 2^53 are not exact as doubles and are refused.
    """
    cut = value_at_rank(df, column, n - 1)
    if cut is None:
        return df
    if abs(cut) >= 2**53:
        raise ValueError(f"{column} is too large for an exact cut")
    return df.where(F.col(column) <= F.lit(cut).cast(df.schema[column].dataType))
