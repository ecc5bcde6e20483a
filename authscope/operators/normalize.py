"""Raw logs to the canonical schema, and the checks on them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from authscope.functions.scalars import boolean_result, parse_time, recode_result
from authscope.schemas import (
    AUTH_LOG,
    OPTIONAL_COLUMNS,
    RBA_APP,
    RBA_COLUMNS,
    REQUIRED_COLUMNS,
    RESULT_VALUES,
)

SHOWN_VALUES = 50


def column_map(**names: str | None) -> dict[str, str]:
    """Canonical name to source name; an optional column set to None is left out."""
    unknown = set(names) - set(REQUIRED_COLUMNS) - set(OPTIONAL_COLUMNS)
    if unknown:
        raise ValueError(f"not canonical columns: {sorted(unknown)}")
    whole = {c: c for c in REQUIRED_COLUMNS + OPTIONAL_COLUMNS} | names
    unset = [c for c in REQUIRED_COLUMNS if not whole[c]]
    if unset:
        raise ValueError(f"required columns need a source name: {unset}")
    return {c: s for c, s in whole.items() if s}


def rename_to_canonical(df: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Required and optional columns under their canonical names, in fixed order."""
    names = dict(columns or column_map())
    missing = [names[c] for c in REQUIRED_COLUMNS if names[c] not in df.columns]
    if missing:
        raise ValueError(f"missing required columns in input: {missing}")
    picked = []
    for field in AUTH_LOG:
        source = names.get(field.name)
        if source in df.columns:
            picked.append(F.col(f"`{source}`").alias(field.name))
        else:
            picked.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*picked)


def canonical_logs(df: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Canonical rows, lenient: bad times become null and unknown results stay as text.

    Lazy and narrow. Use ``check_logs`` to raise on bad rows, or ``split_logs`` to set
    them aside.
    """
    raw = rename_to_canonical(df, columns)
    kinds = dict(raw.dtypes)
    return raw.select(
        parse_time(F.col("ts"), kinds["ts"]).alias("ts"),
        *[F.col(c).cast("string").alias(c) for c in ("user", "src_ip", "app")],
        recode_result(F.col("result")).alias("result"),
        *[F.col(c).cast("string").alias(c) for c in OPTIONAL_COLUMNS],
    )


def canonical_rba(df: DataFrame) -> DataFrame:
    """Login records of the public risk data set: boolean outcome, no application."""
    outcome = boolean_result(F.col(f"`{RBA_COLUMNS['result']}`"))
    return canonical_logs(
        df.withColumns({"app": F.lit(RBA_APP), RBA_COLUMNS["result"]: outcome}), RBA_COLUMNS
    )


def auth_logs(df: DataFrame) -> DataFrame:
    """Pick the adapter by the columns present."""
    return canonical_rba(df) if RBA_COLUMNS["ts"] in df.columns else canonical_logs(df)


def _good() -> Column:
    return F.col("ts").isNotNull() & _known()


def split_logs(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the schema, and the rows that do not."""
    return logs.where(_good()), logs.where(~_good())


def _bad_counts() -> list[Column]:
    return [F.count_if(F.col("ts").isNull()).alias("times"), F.count_if(~_known()).alias("results")]


def _known() -> Column:
    return F.coalesce(F.col("result").isin(*RESULT_VALUES), F.lit(False))


def _raise_bad(times: int, results: int, logs: DataFrame) -> None:
    if times:
        raise ValueError(f"failed to parse {times} timestamps in column 'ts'")
    if results:
        values = logs.where(~_known()).groupBy("result").count()
        shown = [r["result"] for r in values.orderBy(F.desc("count"), "result").limit(SHOWN_VALUES).collect()]
        more = values.count() - len(shown) if len(shown) == SHOWN_VALUES else 0
        raise ValueError(
            f"{results} invalid values in 'result', most frequent: {shown}{f' and {more} more' if more else ''}; "
            f"expected {sorted(RESULT_VALUES)}"
        )


def check_logs(logs: DataFrame) -> DataFrame:
    """Raise on unparsable times or unknown results, else return ``logs``.

    One aggregate over two columns. A second, grouped, pass runs only when there is
    something to report. ``write_logs`` checks without a pass of its own.
    """
    seen = logs.agg(*_bad_counts()).first()
    _raise_bad(seen["times"], seen["results"], logs)
    return logs


def write_logs(logs: DataFrame, path: str) -> DataFrame:
    """Write the logs as a table and return it; raise on bad rows as ``check_logs`` does.

    The bad rows are counted while the rows are written, so a sound log is read once. After an error
    the table is left at ``path`` with its bad rows, to be looked at with ``split_logs``.
    """
    seen = Observation()
    logs.observe(seen, *_bad_counts()).write.mode("overwrite").parquet(path)
    held = logs.sparkSession.read.schema(logs.schema).parquet(path)
    _raise_bad(seen.get["times"], seen.get["results"], held)
    return held


def sorted_logs(logs: DataFrame) -> DataFrame:
    """Log in time order, ties broken by the other columns."""
    return logs.orderBy(*AUTH_LOG.names)
