"""Behaviour of each source per time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.functions.durations import duration_seconds
from authscope.functions.scalars import flag, floor_time, ratio, success_after_fail
from authscope.schemas import DEFAULT_MIN_FAIL, DEFAULT_WINDOW
from authscope.session import cut_lineage

# One bit per counted column, so that one number tells which columns hold any value.
DIMENSIONS = {"user": 1, "app": 2, "user_agent": 4, "country": 8}
#: Size of the sketches behind approximate counts.
APPROX_BITS = 12
DISTINCT_NAMES = {"user": "n_users", "app": "n_apps", "user_agent": "n_user_agents", "country": "n_countries"}


def group_keys(by_app: bool) -> list[str]:
    return ["src_ip", "app"] if by_app else ["src_ip"]


def _stacked(logs: DataFrame, keys: list[str], window: str) -> DataFrame:
    return stack_values(logs, keys, {"win": floor_time(F.col("ts"), window)})


def stack_values(logs: DataFrame, keys: list[str], time: dict[str, Column]) -> DataFrame:
    """One row per log row and counted column."""
    present = [c for c in DIMENSIONS if c in logs.columns]
    pairs = [e for c in present for e in (F.lit(DIMENSIONS[c]), F.col(c).cast("string"))]
    return logs.select(
        *keys,
        *[c.alias(n) for n, c in time.items()],
        flag(F.col("result") == "fail").alias("is_fail"),
        flag(F.col("result") == "success").alias("is_success"),
        F.stack(F.lit(len(present)), *pairs).alias("dim", "val"),
    )


def _filled_columns(counts: DataFrame) -> Column:
    """Bits of the counted columns that hold a value in some window, from the aggregated windows."""
    bits = [F.when(F.max(DISTINCT_NAMES[c]) > 0, bit).otherwise(0) for c, bit in DIMENSIONS.items()]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return counts.agg(total.alias("bits")).scalar()


def window_features(
    logs: DataFrame,
    window: str = DEFAULT_WINDOW,
    by_app: bool = False,
    min_fail: int = DEFAULT_MIN_FAIL,
    approx_distinct: bool = False,
) -> DataFrame:
    """Counts, distinct counts, rates and user entropy per source and window.

    Two chained aggregates and no join. The first groups by source, window and one
    counted value, so a source that holds a large part of the log is spread over as
    many groups as it has distinct values and collapses on the map side; the second
    adds up those groups, again with a map-side part. Distinct counts and entropy come
    from the same rows as the plain counts.

    A counted column without any value in the whole input gives 1 in every window. Whether it
    has one is read off the aggregated windows, which are written once for that; the log is
    scanned once.
    """
    if approx_distinct:
        return _approx_features(logs, window, by_app, min_fail)
    keys = group_keys(by_app)
    counts = count_values(_stacked(logs, keys, window), keys, ["win"])
    counts = cut_lineage(sum_values(counts, keys, ["win"], named=False))
    # Rows without a source have no window of their own, but their values count as present.
    counts = counts.withColumn("bits", _filled_columns(counts)).dropna(subset=keys)
    distinct = {
        DISTINCT_NAMES[c]: F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col(DISTINCT_NAMES[c])).otherwise(1)
        for c, bit in DIMENSIONS.items()
    }
    return finish_features(counts.withColumns(distinct), keys, window, min_fail)


def count_values(stacked: DataFrame, keys: list[str], time: list[str]) -> DataFrame:
    """Rows, failures and successes per source, window and counted value."""
    return stacked.groupBy(*keys, *time, "dim", "val").agg(
        F.count(F.lit(1)).alias("c"), F.sum("is_fail").alias("f"), F.sum("is_success").alias("s")
    )


def sum_values(values: DataFrame, keys: list[str], time: list[str], named: bool = True) -> DataFrame:
    """All counts of a source and window from its counted values, of sources with a name or of all."""
    if named:
        values = values.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    first = F.col("dim") == DIMENSIONS["user"]
    given = F.col("val").isNotNull()
    sums = (
        values.groupBy(*keys, *time)
        .agg(
            F.sum(F.when(first, F.col("c"))).alias("n_attempts"),
            F.sum(F.when(first, F.col("f"))).alias("n_fail"),
            F.sum(F.when(first, F.col("s"))).alias("n_success"),
            *[
                F.count_if((F.col("dim") == bit) & given).alias(DISTINCT_NAMES[c])
                for c, bit in DIMENSIONS.items()
            ],
            F.sum(F.when(first & given, F.col("c"))).alias("u_total"),
            F.sum(F.when(first & given, F.col("c") * F.log2(F.col("c")))).alias("u_weighted"),
        )
    )
    spread = F.log2("u_total") - F.col("u_weighted") / F.col("u_total")
    return sums.withColumn("user_entropy", F.when(F.col("n_users") > 1, spread).otherwise(0.0))


def _approx_features(logs: DataFrame, window: str, by_app: bool, min_fail: int) -> DataFrame:
    """Sketched distinct counts, for windows with very many distinct values: exact for few values, and
    with a standard error of 1.6 % beyond, so that no window of very many strays from its count by 15 %.

    Entropy is exact all the same: it takes counts by user, two plain aggregates.
    """
    keys = group_keys(by_app)
    present = [c for c in DIMENSIONS if c in logs.columns]
    counts = (
        logs.withColumns(
            {
                "win": floor_time(F.col("ts"), window),
                "is_fail": flag(F.col("result") == "fail"),
                "is_success": flag(F.col("result") == "success"),
            }
        )
        .dropna(subset=keys)
        .groupBy(*keys, "win")
        .agg(
            F.count(F.lit(1)).alias("n_attempts"),
            F.sum("is_fail").alias("n_fail"),
            F.sum("is_success").alias("n_success"),
            *[F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), APPROX_BITS)).alias(DISTINCT_NAMES[c]) for c in present],
            *[F.lit(1).cast("long").alias(n) for c, n in DISTINCT_NAMES.items() if c not in present],
        )
        .withColumn("user_entropy", F.lit(0.0))
    )
    found = finish_features(counts, keys, window, min_fail)
    if "user" not in logs.columns:
        return found
    return attach_entropy(found, user_entropy(user_counts(logs, window, by_app), by_app), by_app).select(*found.columns)


def finish_features(counts: DataFrame, keys: list[str], window: str, min_fail: int) -> DataFrame:
    """Derived columns and the fixed column order."""
    minutes = duration_seconds(window) / 60.0
    return counts.select(
        *keys,
        F.col("win").alias("ts"),
        "n_attempts",
        "n_fail",
        "n_success",
        *DISTINCT_NAMES.values(),
        ratio(F.col("n_fail"), F.col("n_attempts")).alias("fail_rate"),
        (F.col("n_attempts") / F.lit(minutes)).alias("attempts_per_min"),
        success_after_fail(F.col("n_success"), F.col("n_fail"), min_fail).alias("success_after_fail"),
        "user_entropy",
    )


def user_counts(logs: DataFrame, window: str = DEFAULT_WINDOW, by_app: bool = False) -> DataFrame:
    """Attempts per source, window and user."""
    keys = group_keys(by_app)
    return (
        logs.select(*keys, "user", floor_time(F.col("ts"), window).alias("ts"))
        .dropna(subset=[*keys, "user"])
        .groupBy(*keys, "ts", "user")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def user_entropy(counts: DataFrame, by_app: bool = False) -> DataFrame:
    """Entropy in bits of the attempts over users, from ``user_counts``."""
    total = F.sum("n")
    spread = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    return counts.groupBy(*group_keys(by_app), "ts").agg(
        F.when(F.count(F.lit(1)) > 1, spread).otherwise(0.0).alias("user_entropy")
    )


def attach_entropy(features: DataFrame, entropy: DataFrame, by_app: bool = False) -> DataFrame:
    """Left join of an entropy table on source and window; 0 where there is none."""
    keys = [*group_keys(by_app), "ts"]
    bare = features.drop("user_entropy")
    return bare.join(entropy, keys, "left").withColumn(
        "user_entropy", F.coalesce("user_entropy", F.lit(0.0))
    )


def sorted_features(features: DataFrame, by_app: bool = False) -> DataFrame:
    return features.orderBy(*group_keys(by_app), "ts")


def top_sources(logs: DataFrame, n: int = 20) -> DataFrame:
    """Sources with most failures."""
    return (
        logs.dropna(subset=["src_ip"])
        .groupBy("src_ip")
        .agg(
            F.count(F.lit(1)).alias("n_attempts"),
            F.count_if(F.col("result") == "fail").alias("n_fail"),
            F.countDistinct("user").alias("n_users"),
        )
        .orderBy(F.desc("n_fail"), F.desc("n_attempts"), "src_ip")
        .limit(n)
    )
