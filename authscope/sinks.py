"""Writing features, scores, alerts, results and models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.operators.alerts import ranked
from authscope.operators.forest import Forest
from authscope.operators.scaler import Scaler
from authscope.plans.detect import Detection


@dataclass(frozen=True)
class RunPaths:
    """Where a run was written."""

    features: str
    scored: str
    alerts: str
    model: str


def write_table(df: DataFrame, path: str, kind: str = "parquet", by_day: str | None = None) -> str:
    """Write over ``path``; ``by_day`` splits the output by the day of a time column."""
    if by_day:
        df = df.withColumn("day", F.to_date(by_day))
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    if by_day:
        writer = writer.partitionBy("day")
    writer.save(path)
    return path


def write_detection(found: Detection, folder: str, kind: str = "parquet") -> RunPaths:
    """Features and scores as they are, alerts in rank order, and the model."""
    keys = [c for c in ("src_ip", "app") if c in found.features.columns]
    return RunPaths(
        write_table(found.features, f"{folder}/features", kind),
        write_table(found.scored, f"{folder}/scored", kind),
        write_table(ranked(found.alerts, keys), f"{folder}/alerts", kind),
        save_forest(found.model, f"{folder}/model"),
    )


def save_forest(forest: Forest, folder: str) -> str:
    """Three plain tables: nodes, scaler, meta."""
    spark = forest.nodes.sparkSession
    write_table(forest.nodes, f"{folder}/nodes")
    write_table(forest.scaler.table(spark), f"{folder}/scaler")
    meta = [(forest.trees, forest.sample, forest.depth, forest.seed, forest.cut, forest.scaler.rows)]
    schema = "trees int, sample long, depth int, seed long, cut double, rows long"
    write_table(spark.createDataFrame(meta, schema), f"{folder}/meta")
    return folder


def load_forest(spark: SparkSession, folder: str) -> Forest:
    meta = spark.read.parquet(f"{folder}/meta").first()
    lines = spark.read.parquet(f"{folder}/scaler").orderBy("position").collect()
    scaler = Scaler(
        tuple(r["column"] for r in lines),
        tuple(r["mean"] for r in lines),
        tuple(r["scale"] for r in lines),
        meta["rows"],
    )
    nodes = spark.read.parquet(f"{folder}/nodes")
    return Forest(nodes, scaler, meta["trees"], meta["sample"], meta["depth"], meta["seed"], meta["cut"])
