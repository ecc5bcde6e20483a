"""Contiguous shards of near equal byte size, from global prefix sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authscope.session import cut_lineage, shuffle_width


def _running(batches):
    """Bytes and rows that precede each row within the partition."""
    part, bytes_, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        ends, n = bytes_ + np.cumsum(size), len(size)
        extra = [pa.array(np.full(n, part, np.int32)), pa.array(ends - size), pa.array(np.arange(rows, rows + n))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "before", "nth"])
        bytes_, rows = (int(ends[-1]) if n else bytes_), rows + n


def shard_by_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut the rows, in order of ``key``, at equal shares of all bytes.

    Sizes are measured in one narrow pass; only (key, size, checksum) is ordered, by range
    partitions. Each partition sums up its own rows, the totals of the partitions (one row
    each) give every partition its offset, and a row belongs to the shard in whose share its
    middle byte lies. A shard is thus off its share by less than its two largest border rows.

    A null text has no bytes and the checksum of the empty text; each row counts one byte more.
    Null keys come first, equal keys go by size and checksum. No rows give no rows. Only the
    key and the text are read, so other columns may have any names.
    """
    sized = cut_lineage(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        )
    )
    order = [F.col("key").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    ranged = sized.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    schema = sized.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    rows = cut_lineage(ranged.mapInArrow(_running, f"{schema}, part int, before long, nth long"))

    parts = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    parts = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("part_bytes"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("part_rows"),
        F.sum("bytes").over(every).alias("total"),
    )  # a row for each range partition, whose number is a setting
    placed = rows.join(F.broadcast(parts), "part").select(
        "key",
        "size",
        "text_crc32",
        F.expr(f"int(((part_bytes + before) * 2 + size) * {int(shards)} div (total * 2))").alias("shard"),
        (F.col("part_rows") + F.col("nth")).alias("nth"),
    )
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
