"""Reading logs, flows and results."""

from __future__ import annotations

import csv
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authscope.operators.normalize import auth_logs
from authscope.operators.quantile import bounded_rows
from authscope.schemas import FLOW_COLUMNS
from authscope.session import cut_lineage


def trim_headers(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema every column is text and no data is read."""
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return trim_headers(reader.csv(path if isinstance(path, str) else list(path)))


def read_auth_csv(spark: SparkSession, path: str) -> DataFrame:
    """Canonical logs from a CSV in either layout, lenient about bad rows."""
    return auth_logs(read_csv(spark, path))


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, on any file system Spark reads."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def file_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The header of each CSV file, its names as they stand, from one pass over all files together.

    The lines of a file's first block come to one task in order, so the first is the one with
    the least running number. Files without a line are left out.
    """
    lines = spark.read.text(list(paths)).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")
    )
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "n").alias("line"))
    return {r["file_path"]: tuple(next(csv.reader([r["line"]]))) for r in first.collect()}  # a row for each file


def read_flow_csvs(spark: SparkSession, pattern: str, schema: dict[str, str] | None = None) -> DataFrame:
    """All files of a glob as one table, by trimmed column name.

    Files with the same header are one scan. ``schema`` gives types by trimmed name; without
    it types are inferred per header, at the price of an extra pass.
    """
    paths = list_files(spark, pattern)
    if not paths:
        raise FileNotFoundError(pattern)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path, header in sorted(file_headers(spark, paths).items()):
        by_header.setdefault(header, []).append(path)
    out = None
    for header, paths in by_header.items():
        reader = spark.read.option("header", True)
        if schema:
            fields = T.StructType([T.StructField(c, _type_of(schema.get(c.strip(), "string"))) for c in header])
            part = reader.schema(fields).csv(paths)
        else:
            part = reader.option("inferSchema", True).csv(paths)
        part = trim_headers(part)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _type_of(name: str) -> T.DataType:
    return T.StructType.fromDDL(f"x {name}")["x"].dataType


def flow_columns(df: DataFrame, columns: Mapping[str, str] = FLOW_COLUMNS) -> DataFrame:
    """Flows under the names the routes read; dots in other names become underscores.

    ``columns`` maps a route's name to the file's; those the file lacks are left out.
    """
    names = {source: name for name, source in columns.items()}
    return df.toDF(*[names.get(c, c.replace(".", "_")) for c in df.columns])


ROW_KEY = ("row_part", "row_number")


def row_keys(df: DataFrame) -> DataFrame:
    """``df`` with a key of two numbers for rows that have none: a row's part of a written table and its place there.

    The rows are written once; nothing is shuffled, and equal rows get keys of their own. Reading the
    same files in the same splits gives the same keys.
    """
    held = cut_lineage(df)
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int")
    return held.select(*[F.col(f"`{c}`") for c in df.columns], part.alias(ROW_KEY[0]), F.col("_metadata.row_index").alias(ROW_KEY[1]))


def read_parquet_pair(spark: SparkSession, train: str, test: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(train), spark.read.parquet(test)


def read_bounded(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first ``n`` rows by a unique numeric column."""
    return bounded_rows(df, column, n)


def read_optional(read: Callable[[], DataFrame]) -> DataFrame | None:
    """Result of ``read``, or None where its path does not exist."""
    try:
        return read()
    except FileNotFoundError:
        return None
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_results(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Alerts, summaries and grids as written by the sinks."""
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.format(kind).load(path)
