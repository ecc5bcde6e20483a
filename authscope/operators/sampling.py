"""Repeatable samples without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.functions.draws import key_text, uniform


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42, purpose: str = "sample") -> DataFrame:
    """``n`` rows by smallest draw, all rows if there are fewer.

    Rows that cannot be among the smallest draws are filtered before the sort, so the sort
    sees a few times ``n`` rows and its heap holds ``n``.
    """
    total = df.count()
    if total <= n:
        return df
    draw = uniform(seed, purpose, *key)
    likely = min(1.0, (2 * n + 200) / total)
    return (
        df.withColumns({"_draw": draw, "_key": key_text(*key)})
        .where(F.col("_draw") < likely)
        .orderBy("_draw", "_key")
        .limit(n)
        .drop("_draw", "_key")
    )
