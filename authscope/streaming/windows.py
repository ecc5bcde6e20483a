"""The same window features, scores and alerts on a stream of logs.

The two chained aggregates of the batch form carry over: the first keeps state per source,
window and counted value, the second per source and window, so a flooding source never
gathers its users in one row of state. In append mode a window is emitted once the watermark
has passed its end; later rows for it are dropped. ``finish_open`` adds the windows that are
still open when a bounded replay ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from authscope.functions.durations import duration_seconds, interval_text
from authscope.operators.alerts import alert_table
from authscope.operators.features import count_values, finish_features, group_keys, stack_values, sum_values
from authscope.operators.forest import Forest, score_and_flag
from authscope.schemas import DEFAULT_MIN_FAIL, DEFAULT_WINDOW

DEFAULT_DELAY = "10min"


def stream_features(
    logs: DataFrame,
    window: str = DEFAULT_WINDOW,
    delay: str = DEFAULT_DELAY,
    by_app: bool = False,
    min_fail: int = DEFAULT_MIN_FAIL,
) -> DataFrame:
    """Streaming counterpart of ``window_features``.

    Whether a counted column is empty in the whole input cannot be known on a stream, so an
    empty column counts 0 here.
    """
    keys = group_keys(by_app)
    late = logs.withWatermark("ts", interval_text(delay))
    stacked = stack_values(late, keys, {"win": F.window("ts", interval_text(window))})
    sums = sum_values(count_values(stacked, keys, ["win"]), keys, ["win"])
    return finish_features(sums.withColumn("win", F.col("win.start")), keys, window, min_fail)


def finish_open(
    closed: DataFrame,
    logs: DataFrame,
    window: str = DEFAULT_WINDOW,
    delay: str = DEFAULT_DELAY,
    by_app: bool = False,
    min_fail: int = DEFAULT_MIN_FAIL,
) -> DataFrame:
    """All windows of a bounded replay: those the stream has closed, and those still open at its end.

    The watermark stays ``delay`` behind the latest row, so the last windows never leave the
    stream. Their rows, the tail behind the watermark, are aggregated the same way in a batch.
    ``logs`` are the replayed rows as a table.
    """
    last = logs.agg(F.max(F.unix_micros("ts"))).first()[0]
    if last is None:
        return closed
    mark = last - int(duration_seconds(delay) * 1_000_000)
    rows = logs.withColumn("_end", F.window("ts", interval_text(window)).end)
    tail = rows.where(F.unix_micros("_end") > F.lit(mark)).drop("_end")
    return closed.unionByName(stream_features(tail, window, delay, by_app, min_fail))


def stream_alerts(features: DataFrame, model: Forest, by_app: bool = False) -> DataFrame:
    """Score each closed window with a fitted model and keep the flagged ones. Stateless."""
    return alert_table(score_and_flag(features, model), group_keys(by_app))


def write_alerts(
    features: DataFrame, model: Forest, path: str, state: str, by_app: bool = False, once: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    """Alerts of a stream of closed windows by a forest of any size, batch by batch.

    A batch is a table, so a forest too large for one walk goes over it in parts. Each batch has
    a folder of its number, which a repeated batch writes over: no alert is there twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        found = alert_table(score_and_flag(batch, model), group_keys(by_app))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = features.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", state)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files: int = 100) -> DataFrame:
    """Files of a folder or glob as they arrive, a bounded number per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def write_stream(rows: DataFrame, path: str, state: str, once: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Append to a parquet folder; ``state`` is the checkpoint folder of the query.

    With ``once`` all files present are worked through and the query ends.
    """
    writer = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start(path)
