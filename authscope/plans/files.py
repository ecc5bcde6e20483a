"""From files to results: every evaluation route whose files are there, in one call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from authscope import sinks
from authscope.operators import evaluate
from authscope.plans import evaluation
from authscope.plans.evaluation import Evaluation, Fit
from authscope.sources.readers import (
    ROW_KEY,
    flow_columns,
    read_auth_csv,
    read_csv,
    read_flow_csvs,
    read_optional,
    read_parquet_pair,
    row_keys,
)


@dataclass(frozen=True)
class Sources:
    """Where the files are; a source that is not named, or whose path does not exist, is left out."""

    flows: str | None = None
    logins: str | None = None
    logs: str | None = None
    split: tuple[str, str] | None = None


def _routes(spark: SparkSession, sources: Sources, window: str, fit: Fit) -> dict[str, Callable[[], Evaluation | None]]:
    def flows() -> DataFrame | None:
        found = sources.flows and read_optional(lambda: read_flow_csvs(spark, sources.flows))
        return row_keys(flow_columns(found)) if found is not None and found else None

    def routed(rows: DataFrame | None, route: Callable[[DataFrame], Evaluation]) -> Evaluation | None:
        return None if rows is None else route(rows)

    held = flows()

    def windowed(rows: DataFrame) -> Evaluation:
        timed = {"ts", "src_ip"} <= set(rows.columns)
        order = ["ts", *ROW_KEY] if timed else list(ROW_KEY)
        return evaluation.windowed_flows(rows, order, leaky=not timed, window=window, fit=fit)

    def logins() -> DataFrame | None:
        return read_optional(lambda: read_csv(spark, sources.logins)) if sources.logins else None

    def logs() -> DataFrame | None:
        return read_optional(lambda: read_auth_csv(spark, sources.logs)) if sources.logs else None

    def split() -> Evaluation | None:
        pair = read_optional(lambda: read_parquet_pair(spark, *sources.split)) if sources.split else None
        if pair is None:
            return None
        train, test = pair
        return evaluation.split_flows(row_keys(train), test, ROW_KEY, drop=ROW_KEY, fit=fit)

    return {
        "flows-raw": lambda: routed(held, lambda rows: evaluation.raw_flows(rows, ROW_KEY, drop=ROW_KEY, fit=fit)),
        "flows-windowed": lambda: routed(held, windowed),
        "logins": lambda: routed(logins(), lambda rows: evaluation.risk_logins(rows, window=window, fit=fit)),
        "logs": lambda: routed(logs(), lambda rows: evaluation.auth_logs(rows, window=window, fit=fit)),
        "flows-split": split,
    }


def evaluate_files(
    spark: SparkSession, sources: Sources, out: str | None = None, window: str = "10min", fit: Fit = Fit()
) -> dict[str, Evaluation]:
    """All routes whose files are there, by name; with ``out`` their recalls are written there as CSV.

    Flow files have no row key, so their rows get one (``row_keys``). Flows without time and source
    are windowed by position and label (``leaky``), whose recalls mean nothing. No files at all are an error.
    """
    found = {name: done for name, route in _routes(spark, sources, window, fit).items() if (done := route()) is not None}
    if not found:
        raise FileNotFoundError(f"none of the files is there: {sources}")
    if out:
        table = evaluation.summary([e.recalls for e in found.values()])
        sinks.write_table(evaluate.sorted_summary(table).coalesce(1), out, "csv")  # a row for each label
    return found
