"""Alert tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.functions.scalars import alert_summary
from authscope.schemas import ALERT_COLUMNS


def alert_table(scored: DataFrame, keys: Sequence[str] = ("src_ip",), ts: str = "ts") -> DataFrame:
    """Flagged windows with a line of text. Listed columns that are absent are left out.

    Unordered; see ``ranked``. Without any flagged window the table is empty, with all columns.
    """
    wanted = [*keys, ts, *ALERT_COLUMNS]
    flagged = scored.where(F.col("is_anomaly") == 1)
    for c in ("fail_rate", "success_after_fail"):
        if c not in flagged.columns:
            flagged = flagged.withColumn(c, F.lit(0))
    text = flagged.withColumn("summary", alert_summary())
    return text.select(*[c for c in wanted if c in scored.columns], "summary")


def ranked(alerts: DataFrame, keys: Sequence[str] = ("src_ip",), ts: str = "ts") -> DataFrame:
    """Strangest first, ties by key and time."""
    return alerts.orderBy(F.desc("anomaly_score"), *keys, ts)


def top_alerts(alerts: DataFrame, n: int = 20, keys: Sequence[str] = ("src_ip",), ts: str = "ts") -> DataFrame:
    """The first ``n`` alerts; each task keeps only its own best ``n``."""
    return ranked(alerts, keys, ts).limit(n)
