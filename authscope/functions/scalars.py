"""Column expressions shared by the operators. All stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from authscope.functions.durations import interval_text
from authscope.schemas import (
    CONTAMINATION_CAP,
    CONTAMINATION_FLOOR,
    FAIL_SPELLINGS,
    SUCCESS_SPELLINGS,
)


def strip_lower(c: Column) -> Column:
    """Lower-case text without white space at either end, in the Unicode sense."""
    return F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))


def recode_result(c: Column) -> Column:
    """Map the known spellings to success / fail, leave other text as it is."""
    text = strip_lower(c)
    return (
        F.when(text.isin(*SUCCESS_SPELLINGS), "success")
        .when(text.isin(*FAIL_SPELLINGS), "fail")
        .otherwise(text)
    )


def boolean_result(c: Column) -> Column:
    """true / 1 to success, false / 0 to fail, anything else to null."""
    text = strip_lower(c)
    return F.when(text.isin("true", "1", "1.0"), "success").when(text.isin("false", "0", "0.0"), "fail")


def truth(c: Column) -> Column:
    """1 for true, 0 for false, null for anything else, from booleans, numbers or their text."""
    result = boolean_result(c)
    return F.when(result == "success", 1).when(result == "fail", 0)


def parse_time(c: Column, kind: str) -> Column:
    """Time of any input type as a timestamp; text that is no time becomes null."""
    return F.try_to_timestamp(c) if kind == "string" else c.cast("timestamp")


def floor_time(c: Column, window: str) -> Column:
    """Start of the tumbling window that holds the time."""
    return F.window(c, interval_text(window)).start


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def is_attack(label: Column, benign: str) -> Column:
    """1 unless the label is the benign one; a missing label counts as attack."""
    return F.coalesce(label != F.lit(benign), F.lit(True)).cast("int")


def clean_number(c: Column) -> Column:
    """null, NaN and both infinities become 0."""
    d = c.cast("double")
    return F.when(
        d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(0.0)
    ).otherwise(d)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, null where the divisor is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def success_after_fail(n_success: Column, n_fail: Column, min_fail: int) -> Column:
    """1 where a window holds a success and many failures; no order in time is asked."""
    return flag((n_success > 0) & (n_fail >= min_fail))


def failure_from_success(c: Column) -> Column:
    """1 for a failed login; an unknown outcome counts as a success."""
    return F.lit(1) - F.coalesce(truth(c), F.lit(1))


def pseudo_source(label: Column, buckets: int = 1000) -> Column:
    """A stand-in source name made from the label. Leaks the label into the key."""
    from authscope.functions.draws import digest32

    return F.concat(
        F.lit("IP_"), F.substring(label, 1, 3), F.pmod(digest32(label), F.lit(buckets)).cast("string")
    )


def clamp_contamination(c: Column, floor: float = CONTAMINATION_FLOOR, cap: float = CONTAMINATION_CAP) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(cap), c))


def clamp_share(value: float | None, floor: float = CONTAMINATION_FLOOR, cap: float = CONTAMINATION_CAP) -> float:
    """The same clamp for a share already known to the driver."""
    return max(floor, min(cap, value or 0.0))


def recall_band(recall: Column) -> Column:
    return F.when(recall >= 0.8, "good").when(recall >= 0.5, "medium").otherwise("poor")


def alert_summary() -> Column:
    """One line of text for an alert."""
    return F.format_string(
        "score=%.3f, attempts=%d, fail=%d, users=%d, fail_rate=%.2f, success_after_fail=%d",
        F.col("anomaly_score"),
        F.col("n_attempts").cast("long"),
        F.col("n_fail").cast("long"),
        F.col("n_users").cast("long"),
        F.col("fail_rate").cast("double"),
        F.col("success_after_fail").cast("long"),
    )
