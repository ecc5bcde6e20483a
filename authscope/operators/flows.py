"""Network flows and login records: column preparation and windows with labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authscope.functions.durations import duration_seconds
from authscope.functions.scalars import clean_number, flag, floor_time, is_attack
from authscope.schemas import BENIGN_FLOW

WINDOW = "10min"
#: Label of a window whose attack flows all lack one.
UNKNOWN_ATTACK = "UNKNOWN"


def numeric_columns(df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns, without the ones in ``drop``."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in drop]


def clean_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace null, NaN and infinities by 0 in ``columns``."""
    return df.withColumns({c: clean_number(F.col(f"`{c}`")) for c in columns})


def align_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``columns`` in their order: extra ones go, missing ones are 0."""
    have = set(df.columns)
    return df.select(
        *keep,
        *[
            F.col(f"`{c}`").cast("double").alias(c) if c in have else F.lit(0.0).alias(c)
            for c in columns
        ],
    )


def distinct_by_group(
    df: DataFrame,
    group: Sequence[str],
    counted: dict[str, str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Row counts, distinct counts, sums and maxima per group in two chained aggregates.

    ``counted`` maps an output name to the column whose distinct values are counted. The
    first aggregate is keyed by group and value, so a hot group is spread over its values
    and never meets one task whole; both aggregates have a map-side part.
    """
    sums, maxima = sums or {}, maxima or {}
    names = list(counted)
    pairs = [e for i, n in enumerate(names) for e in (F.lit(i), F.col(counted[n]).cast("string"))]
    rows = df.select(
        *group,
        *[c.alias(n) for n, c in {**sums, **maxima}.items()],
        F.stack(F.lit(len(names)), *pairs).alias("dim", "val"),
    )
    first = F.col("dim") == 0
    return (
        rows.groupBy(*group, "dim", "val")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.sum(n).alias(n) for n in sums],
            *[F.max(n).alias(n) for n in maxima],
        )
        .groupBy(*group)
        .agg(
            F.sum(F.when(first, F.col("n_rows"))).alias("n_rows"),
            *[
                F.count_if((F.col("dim") == i) & F.col("val").isNotNull()).alias(n)
                for i, n in enumerate(names)
            ],
            *[F.sum(F.when(first, F.col(n))).alias(n) for n in sums],
            *[F.max(n).alias(n) for n in maxima],
        )
    )


def _rates(windows: DataFrame, reach: str, spread: str, window: str) -> DataFrame:
    """Derived columns: the six-fold counts, the true rates per minute and the log of a distinct count."""
    minutes = F.lit(duration_seconds(window) / 60.0)
    return windows.withColumns(
        {
            "fail_rate": F.col("n_fail") / F.col("n_rows"),
            "flows_x6": F.col("n_flows") * 6,
            "dst_x6": F.col(reach) * 6,
            "flows_per_min": F.col("n_flows") / minutes,
            "dst_per_min": F.col(reach) / minutes,
            "log_distinct": F.log1p(F.col(spread).cast("double")),
        }
    )


def flow_windows(
    flows: DataFrame, order_key: Sequence[str], window: str = WINDOW, benign: str = BENIGN_FLOW
) -> DataFrame:
    """Flows per source and window, with the first attack label in ``order_key`` order.

    The counts are keyed by destination port first, then by source and window, and both steps
    are hash aggregates. The label is looked for among attack rows with a label alone; a
    window with attacks but no label gets ``UNKNOWN_ATTACK``.
    """
    rows = flows.withColumns(
        {"win": floor_time(F.col("ts"), window), "is_fail": is_attack(F.col("label"), benign)}
    ).dropna(subset=["src_ip"])
    ports = rows.groupBy("src_ip", "win", "dst_port").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("is_fail").alias("n_fail")
    )
    has_port = F.col("dst_port").isNotNull()
    counts = ports.groupBy("src_ip", "win").agg(
        F.coalesce(F.sum(F.when(has_port, F.col("n_rows"))), F.lit(0)).alias("n_flows"),
        F.count_if(has_port).alias("n_dst_ports"),
        F.count_if(has_port).alias("n_dst_ips"),
        F.sum("n_fail").alias("n_fail"),
        F.sum("n_rows").alias("n_rows"),
    )
    attacks = rows.where((F.col("is_fail") == 1) & F.col("label").isNotNull())
    labels = attacks.groupBy(F.col("src_ip").alias("_src"), F.col("win").alias("_win")).agg(
        F.min(F.struct(*order_key, "label"))["label"].alias("_label")
    )
    same = F.col("src_ip").eqNullSafe(F.col("_src")) & F.col("win").eqNullSafe(F.col("_win"))
    label = F.when(F.col("n_fail") == 0, benign).otherwise(F.coalesce("_label", F.lit(UNKNOWN_ATTACK)))
    windows = counts.join(labels, same, "left").withColumn("true_label", label)
    return _rates(windows, "n_dst_ips", "n_dst_ports", window).select(
        "src_ip",
        F.col("win").alias("ts"),
        "n_flows",
        "n_dst_ports",
        "n_dst_ips",
        "n_fail",
        "fail_rate",
        "flows_x6",
        "dst_x6",
        "flows_per_min",
        "dst_per_min",
        "log_distinct",
        "true_label",
    )


def login_windows(logins: DataFrame, window: str = WINDOW, second: str = "country") -> DataFrame:
    """Logins per source and window.

    ``logins`` has ts, src_ip, user, is_fail, is_attack and the ``second`` counted column
    (``country`` or ``app``). Where that column is absent the row count stands in for it.
    """
    name = {"country": "n_countries", "app": "n_apps"}[second]
    counted = {"n_users": "user"}
    if second in logins.columns:
        counted[name] = second
    rows = logins.dropna(subset=["ts", "src_ip"]).withColumn("win", floor_time(F.col("ts"), window))
    windows = distinct_by_group(
        rows,
        ["src_ip", "win"],
        counted,
        sums={"n_fail": F.col("is_fail")},
        maxima={"is_attack_window": F.col("is_attack")},
    ).withColumn("n_flows", F.col("n_rows"))
    if name not in counted:
        windows = windows.withColumn(name, F.col("n_rows"))
    return _rates(windows, "n_users", name, window).select(
        "src_ip",
        F.col("win").alias("ts"),
        "n_flows",
        "n_users",
        name,
        "n_fail",
        "fail_rate",
        "flows_x6",
        "dst_x6",
        "flows_per_min",
        "dst_per_min",
        "log_distinct",
        "is_attack_window",
    )


def login_records(rba: DataFrame) -> DataFrame:
    """Risk-based login rows as the input of ``login_windows``; unknown marks count as harmless."""
    from authscope.functions.scalars import failure_from_success, parse_time, truth
    from authscope.schemas import RBA_ATTACK, RBA_COLUMNS

    kinds = dict(rba.dtypes)
    when = RBA_COLUMNS["ts"]
    return rba.select(
        parse_time(F.col(f"`{when}`"), kinds[when]).alias("ts"),
        F.col(f"`{RBA_COLUMNS['user']}`").alias("user"),
        F.col(f"`{RBA_COLUMNS['src_ip']}`").alias("src_ip"),
        F.col(f"`{RBA_COLUMNS['country']}`").alias("country"),
        failure_from_success(F.col(f"`{RBA_COLUMNS['result']}`")).alias("is_fail"),
        F.coalesce(truth(F.col(f"`{RBA_ATTACK}`")), F.lit(0)).alias("is_attack"),
    )


def log_records(logs: DataFrame) -> DataFrame:
    """Authentication rows as the input of ``login_windows``; every failure counts as an attack."""
    failed = flag(F.col("result") == "fail")
    return logs.withColumns({"is_fail": failed, "is_attack": failed})
