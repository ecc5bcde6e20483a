"""Row positions and running totals in a total order, without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authscope.session import cut_lineage, pieces

_INDEX_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows split into sorted ranges of about equal size, written out so the split stays fixed.

    Range bounds come from a sample of the whole order key, so one repeated leading value
    is still split by the later columns. Planning twice could pick other bounds, hence the
    written copy. The written rows are in range order, so the built-in id numbers them.
    """
    return cut_lineage(
        df.repartitionByRange(pieces(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", _INDEX_BITS))
    )


def _starts(parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sums over all earlier ranges. One row per range, so at most the shuffle partition count."""
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return parts.select(
        "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_start_{n}") for n in names]
    )


def row_positions(df: DataFrame, order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Zero-based position of every row in ``order``, which must be total to be repeatable."""
    ranged = _ranged(df, order)
    starts = _starts(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), ["n"])
    index = F.col("_id") - F.shiftleft("_part", _INDEX_BITS)
    return (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start_n") + index)
        .drop("_id", "_part", "_start_n")
    )


def running_totals(df: DataFrame, order: Sequence[str | Column], totals: Mapping[str, str]) -> DataFrame:
    """Inclusive running sums: output name to summed column. A null adds nothing.

    One shuffle: each sorted range sums up its own rows before it is written, and the sums of
    the ranges before it are added when it is read.
    """
    kinds = df.agg(*[F.sum(c).alias(n) for n, c in totals.items()]).schema
    within = [f"_in_{n}" for n in totals]
    summed = df.select("*", *[F.coalesce(F.col(c).cast(kinds[n].dataType), F.lit(0)).alias(w) for w, (n, c) in zip(within, totals.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = dict.fromkeys(within, 0)
        for rows in batches:
            for i, name in enumerate(rows.schema.names):
                if name in before and rows.num_rows:
                    kind = rows.column(i).type
                    start = pa.array([before[name]], kind)
                    sums = pc.cumulative_sum_checked(pa.concat_arrays([start, rows.column(i)])).slice(1)
                    before[name] = sums[-1].as_py()
                    rows = rows.set_column(i, rows.schema.field(i), sums)
            yield rows

    ranged = summed.repartitionByRange(pieces(df), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged.mapInArrow(run, ranged.schema))
    sums = ranged.groupBy("_part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in totals.items()])
    starts = _starts(sums, list(totals))
    out = ranged.join(F.broadcast(starts), "_part")
    return out.withColumns({n: F.col(f"_start_{n}") + F.col(w) for w, n in zip(within, totals)}).drop(
        "_part", *[f"_start_{n}" for n in totals], *within
    )


def sequence_time(
    df: DataFrame, order: Sequence[str | Column], start: str = "2021-01-01", name: str = "ts"
) -> DataFrame:
    """One time per row, a second apart, in ``order``."""
    first = F.unix_seconds(F.lit(start).cast("timestamp"))
    return row_positions(df, order, "_pos").withColumn(
        name, F.timestamp_seconds(first + F.col("_pos"))
    ).drop("_pos")
