"""A generated authentication log with planted attacks, for load tests and quality checks.

Rows come from minute slots: each slot draws its number of events and each event its values,
all keyed by seed, scenario, slot and event number. Any partitioning gives the same rows, and
the log grows with the slots it is given.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.functions.draws import categorical, poisson, uniform

# Rates, shares, names and times of the scenarios.
START = "2026-02-01 08:00:00"
MINUTES = 12 * 60
USERS = 400
SOURCES = 80
APPS = ("SSO", "VPN", "MAIL")
COUNTRIES = ("FR", "DE", "ES", "GB", "US", "NL")
AGENTS = ("Chrome", "Firefox", "Edge", "MobileSafari", "python-requests", "curl")
SOURCE_PREFIX = "198.51.100."
DAY_RATE, NIGHT_RATE, DAY_HOURS = 10, 4, (9, 18)
APP_SHARES = (0.65, 0.2, 0.15)
AGENT_SHARES = (0.35, 0.25, 0.2, 0.1, 0.07, 0.03)
COUNTRY_SHARES = (0.45, 0.2, 0.08, 0.1, 0.12, 0.05)
FAIL_SHARES = {"SSO": 0.06, "VPN": 0.10, "MAIL": 0.04}
FAIL_REASONS, REASON_SHARES = ("bad_password", "mfa_required", "user_typo"), (0.75, 0.05, 0.20)
SPRAY_SOURCE, SPRAY_START, SPRAY_MINUTES, SPRAY_RATE = "203.0.113.50", 200, 45, 18
SPRAY_USERS, SPRAY_SUCCESS, SPRAY_APP_SHARES = 140, 0.012, (0.85, 0.1, 0.05)
BRUTE_SOURCE, BRUTE_START, BRUTE_MINUTES, BRUTE_RATE = "203.0.113.99", 370, 20, 55
BRUTE_APP_SHARES, BRUTE_AGENTS, BRUTE_AGENT_SHARES = (0.7, 0.2, 0.1), ("curl", "python-requests"), (0.4, 0.6)
OUTAGE_START, OUTAGE_MINUTES, OUTAGE_RATE, OUTAGE_USERS = 540, 25, 35, 60
OUTAGE_AGENTS, OUTAGE_AGENT_SHARES = ("Chrome", "Edge", "MobileSafari"), (0.5, 0.3, 0.2)
OUTAGE_COUNTRIES, OUTAGE_COUNTRY_SHARES = ("FR", "DE", "GB"), (0.6, 0.25, 0.15)


@dataclass(frozen=True)
class LogPlan:
    """Size and seed of a generated log."""

    start: str = START
    minutes: int = MINUTES
    users: int = USERS
    sources: int = SOURCES
    apps: Sequence[str] = APPS
    seed: int = 42


def minute_slots(spark: SparkSession, minutes: int) -> DataFrame:
    return spark.range(minutes).select(F.col("id").alias("minute"))


def user_name(number: Column) -> Column:
    return F.format_string("user%04d", number)


def _draw(plan: LogPlan, scenario: str, what: str) -> Column:
    return uniform(plan.seed, f"{scenario}-{what}", "minute", "i")


def _pick(draw: Column, count: int) -> Column:
    return F.floor(draw * count).cast("long")


def _events(slots: DataFrame, plan: LogPlan, scenario: str, count: Column) -> DataFrame:
    """One row per event of a slot, with its time."""
    base = F.unix_seconds(F.lit(plan.start).cast("timestamp")) + F.col("minute") * 60
    return (
        slots.withColumn("n", count)
        .where("n > 0")
        .select("minute", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
        .withColumn("ts", F.timestamp_seconds(base + _pick(_draw(plan, scenario, "second"), 60)))
    )


def _count(plan: LogPlan, scenario: str, rate: float) -> Column:
    return poisson(uniform(plan.seed, f"{scenario}-count", "minute"), rate)


def chosen_users(spark: SparkSession, plan: LogPlan, scenario: str, n: int) -> DataFrame:
    """``n`` different users by smallest draw, numbered from 0. At most ``n`` rows."""
    from pyspark.sql import Window as W

    draw = uniform(plan.seed, f"{scenario}-users", "id")
    few = spark.range(plan.users).withColumn("_d", draw).orderBy("_d", "id").limit(n)
    place = F.row_number().over(W.orderBy("_d", "id")) - 1
    return few.select(place.cast("long").alias("place"), user_name(F.col("id")).alias("user"))


def _between(slots: DataFrame, first: int, minutes: int) -> DataFrame:
    return slots.where((F.col("minute") >= first) & (F.col("minute") < first + minutes))


def _columns(df: DataFrame, scenario: str) -> DataFrame:
    return df.select(
        "ts", "user", "src_ip", "app", "result", "reason", "user_agent", "country", F.lit(scenario).alias("scenario")
    )


def normal_traffic(slots: DataFrame, plan: LogPlan) -> DataFrame:
    s = "normal"
    start = F.unix_seconds(F.lit(plan.start).cast("timestamp"))
    hour = F.pmod(F.floor((start + F.col("minute") * 60) / 3600), F.lit(24))
    u = uniform(plan.seed, f"{s}-count", "minute")
    count = F.when(hour.between(*DAY_HOURS), poisson(u, DAY_RATE)).otherwise(poisson(u, NIGHT_RATE))
    rows = _events(slots, plan, s, count).withColumns(
        {
            "user": user_name(_pick(_draw(plan, s, "user"), plan.users)),
            "src_ip": F.concat(F.lit(SOURCE_PREFIX), _pick(_draw(plan, s, "source"), plan.sources) + 1),
            "app": categorical(_draw(plan, s, "app"), plan.apps, APP_SHARES),
            "user_agent": categorical(_draw(plan, s, "agent"), AGENTS, AGENT_SHARES),
            "country": categorical(_draw(plan, s, "country"), COUNTRIES, COUNTRY_SHARES),
        }
    )
    share = F.lit(0.0)
    for app, p in FAIL_SHARES.items():
        share = F.when(F.col("app") == app, p).otherwise(share)
    failed = _draw(plan, s, "fail") < share
    why = categorical(_draw(plan, s, "reason"), FAIL_REASONS, REASON_SHARES)
    return _columns(
        rows.withColumn("_f", failed).withColumns(
            {
                "result": F.when(F.col("_f"), "fail").otherwise("success"),
                "reason": F.when(F.col("_f"), why).otherwise("ok"),
            }
        ),
        s,
    )


def password_spray(slots: DataFrame, plan: LogPlan) -> DataFrame:
    """One source tries many users."""
    s = "spray"
    users = chosen_users(slots.sparkSession, plan, s, SPRAY_USERS)
    rows = _events(_between(slots, SPRAY_START, SPRAY_MINUTES), plan, s, _count(plan, s, SPRAY_RATE))
    rows = rows.withColumns(
        {
            "place": _pick(_draw(plan, s, "user"), min(SPRAY_USERS, plan.users)),
            "app": categorical(_draw(plan, s, "app"), plan.apps, SPRAY_APP_SHARES),
            "_ok": _draw(plan, s, "success") < SPRAY_SUCCESS,
        }
    ).join(F.broadcast(users), "place")
    return _columns(
        rows.withColumns(
            {
                "src_ip": F.lit(SPRAY_SOURCE),
                "user_agent": F.lit("python-requests"),
                "country": F.lit("US"),
                "result": F.when(F.col("_ok"), "success").otherwise("fail"),
                "reason": F.when(F.col("_ok"), "ok").otherwise("bad_password"),
            }
        ),
        s,
    )


def brute_force(slots: DataFrame, plan: LogPlan) -> DataFrame:
    """One source tries one user."""
    s = "brute"
    victim = chosen_users(slots.sparkSession, plan, s, 1)
    rows = _events(_between(slots, BRUTE_START, BRUTE_MINUTES), plan, s, _count(plan, s, BRUTE_RATE))
    rows = rows.withColumn("place", F.lit(0).cast("long")).join(F.broadcast(victim), "place")
    return _columns(
        rows.withColumns(
            {
                "src_ip": F.lit(BRUTE_SOURCE),
                "app": categorical(_draw(plan, s, "app"), plan.apps, BRUTE_APP_SHARES),
                "user_agent": categorical(_draw(plan, s, "agent"), BRUTE_AGENTS, BRUTE_AGENT_SHARES),
                "country": F.lit("NL"),
                "result": F.lit("fail"),
                "reason": F.lit("bad_password"),
            }
        ),
        s,
    )


def outage(slots: DataFrame, plan: LogPlan) -> DataFrame:
    """Many ordinary sources fail at once."""
    s = "outage"
    users = chosen_users(slots.sparkSession, plan, s, OUTAGE_USERS)
    rows = _events(_between(slots, OUTAGE_START, OUTAGE_MINUTES), plan, s, _count(plan, s, OUTAGE_RATE))
    rows = rows.withColumn(
        "place", _pick(_draw(plan, s, "user"), min(OUTAGE_USERS, plan.users))
    ).join(F.broadcast(users), "place")
    return _columns(
        rows.withColumns(
            {
                "src_ip": F.concat(F.lit(SOURCE_PREFIX), _pick(_draw(plan, s, "source"), plan.sources) + 1),
                "app": F.lit("VPN"),
                "user_agent": categorical(_draw(plan, s, "agent"), OUTAGE_AGENTS, OUTAGE_AGENT_SHARES),
                "country": categorical(_draw(plan, s, "country"), OUTAGE_COUNTRIES, OUTAGE_COUNTRY_SHARES),
                "result": F.lit("fail"),
                "reason": F.lit("mfa_required"),
            }
        ),
        s,
    )


def generated_logs(spark: SparkSession, plan: LogPlan = LogPlan(), slots: DataFrame | None = None) -> DataFrame:
    """Normal traffic and the three scenarios, unordered, each row with its ``scenario``."""
    slots = minute_slots(spark, plan.minutes) if slots is None else slots
    out = normal_traffic(slots, plan)
    for part in (password_spray, brute_force, outage):
        out = out.unionByName(part(slots, plan))
    return out
