"""Standard scaling with the population deviation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.functions.scalars import clean_number


@dataclass(frozen=True)
class Scaler:
    """Means and scales of the fitted columns, and how many rows they come from."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    rows: int

    def expr(self, column: str) -> Column:
        i = self.columns.index(column)
        return (clean_number(F.col(f"`{column}`")) - F.lit(self.means[i])) / F.lit(self.scales[i])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expr(c) for c in self.columns})

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(range(len(self.columns)), self.columns, self.means, self.scales))
        return spark.createDataFrame(rows, "position int, column string, mean double, scale double")


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """One aggregate for all columns. A constant column gets scale 1."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        v = clean_number(F.col(f"`{c}`"))
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    row = df.agg(*aggs).first()
    if not row["n"]:
        raise ValueError("no rows to fit on")
    span = range(len(columns))
    flat = [row[f"l{i}"] == row[f"h{i}"] for i in span]
    return Scaler(
        tuple(columns),
        tuple(row[f"l{i}"] if flat[i] else row[f"m{i}"] for i in span),
        tuple(1.0 if flat[i] else row[f"s{i}"] for i in span),
        row["n"],
    )
