"""Features over sliding windows, from panes.

A pane is one slide long. Log rows are counted by pane once; a window is then put together from
the counts of its panes, so a log row is never copied into the windows that overlap it. The same
steps run on a table and on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.functions.durations import duration_seconds, interval_text
from authscope.operators.features import count_values, finish_features, group_keys, stack_values, sum_values
from authscope.schemas import DEFAULT_MIN_FAIL, DEFAULT_WINDOW


def check_slide(window: str, slide: str) -> None:
    if duration_seconds(window) % duration_seconds(slide):
        raise ValueError(f"a window of {window} is no whole number of slides of {slide}")


def sliding_features(
    logs: DataFrame,
    window: str = DEFAULT_WINDOW,
    slide: str = "5min",
    by_app: bool = False,
    min_fail: int = DEFAULT_MIN_FAIL,
    delay: str | None = None,
) -> DataFrame:
    """Window features of every source for windows that begin each ``slide``.

    ``delay`` is how late rows of a stream may come; a table needs none. Only windows with a row
    of the source are there, named by their start. A column without a value counts 0.
    """
    check_slide(window, slide)
    keys = group_keys(by_app)
    rows = logs if delay is None else logs.withWatermark("ts", interval_text(delay))
    panes = count_values(stack_values(rows, keys, {"pane": F.window("ts", interval_text(slide))}), keys, ["pane"])
    held = panes.select(
        *keys, F.window(F.window_time("pane"), interval_text(window), interval_text(slide)).alias("win"), "dim", "val", "c", "f", "s"
    )
    values = held.groupBy(*keys, "win", "dim", "val").agg(F.sum("c").alias("c"), F.sum("f").alias("f"), F.sum("s").alias("s"))
    sums = sum_values(values, keys, ["win"])
    return finish_features(sums.withColumn("win", F.col("win.start")), keys, window, min_fail)


def finish_sliding(
    closed: DataFrame,
    logs: DataFrame,
    window: str = DEFAULT_WINDOW,
    slide: str = "5min",
    delay: str = "10min",
    by_app: bool = False,
    min_fail: int = DEFAULT_MIN_FAIL,
) -> DataFrame:
    """All sliding windows of a bounded replay: those the stream has closed, and those open at its end.

    Only rows of panes in windows that end behind the watermark are read again.
    """
    last = logs.agg(F.max(F.unix_micros("ts"))).first()[0]
    if last is None:
        return closed
    mark = last - int(duration_seconds(delay) * 1_000_000)
    width, step = (int(duration_seconds(d) * 1_000_000) for d in (window, slide))
    pane_end = F.unix_micros(F.col("_pane.end"))
    rows = logs.withColumn("_pane", F.window("ts", interval_text(slide)))
    tail = rows.where(pane_end + F.lit(width - step) > F.lit(mark)).drop("_pane")
    open_ = sliding_features(tail, window, slide, by_app, min_fail)
    return closed.unionByName(open_.where(F.unix_micros("ts") + F.lit(width) > F.lit(mark)))
