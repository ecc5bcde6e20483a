"""Session helpers: where lineage may be cut, and the settings the library relies on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


SMALL_INPUT = 2**30


def use_utc(spark: SparkSession) -> SparkSession:
    """Window starts and naive times are read as UTC throughout the library."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only in local mode a folder in the session's
    warehouse serves instead; on a cluster a missing setting is an error, since executors would each
    write to a disk the others cannot read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/authscope-tables"


#: Tables made by the runs that are open, innermost last.
_OPEN_RUNS: list[list[str]] = []


@contextmanager
def run_tables(spark: SparkSession) -> Iterator[None]:
    """Owns the intermediate tables made within, and deletes them at the end, also after an error.

    What the run returns must be written or read before the end, as it may read those tables.
    """
    made: list[str] = []
    _OPEN_RUNS.append(made)
    try:
        yield
    finally:
        _OPEN_RUNS.remove(made)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from that copy.

    Unlike ``checkpoint()``, which runs the last stage once to count and once to write, this
    computes the rows once, and later reads prune columns. The copy outlives lost executors;
    ``run_tables`` deletes it when the run it was made in is over.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/authscope-{uuid.uuid4().hex}"
    if _OPEN_RUNS:
        _OPEN_RUNS[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; nothing runs to find out."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame, each: int = 2**24) -> int:
    """Partitions for a shuffle of ``df``: the session's width, fewer for small data."""
    return min(shuffle_width(df.sparkSession), max(8, estimated_bytes(df) // each))


def spread(df: DataFrame) -> DataFrame:
    """Split small input over the cores before costly row work.

    Large inputs come in many pieces already and are left as they are.
    """
    if df.isStreaming:
        return df
    size = estimated_bytes(df)
    if size > SMALL_INPUT:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(cores, max(8, size // 2**22)))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_batches(spark: SparkSession, rows: int):
    """Few rows per Arrow batch, for rows that each hold a block of data."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def batches_by_rows(spark: SparkSession):
    """Arrow batches end by their rows alone, for rows of a few numbers: a limit in bytes is looked up anew at every row."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))


def compiled_methods(spark: SparkSession):
    """Generated code beyond 8,000 bytes a method is generated in smaller parts: the JVM never compiles longer methods."""
    return _setting(spark, "spark.sql.codegen.hugeMethodLimit", "8000")
