import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from authscope.functions.durations import duration_seconds
from authscope.operators import features
from authscope.schemas import AUTH_LOG, FEATURE_COLUMNS

DAY = dt.datetime(2024, 1, 1, 9, 0)


def make(spark, rows):
    """rows: (minute, user, src_ip, app, result, agent, country)"""
    full = [
        (DAY + dt.timedelta(minutes=m), u, s, a, r, None, g, c) for m, u, s, a, r, g, c in rows
    ]
    return spark.createDataFrame(full, AUTH_LOG)


def by_source(df):
    return {(r["src_ip"], r["ts"]): r for r in df.collect()}


def test_counts_rates_and_entropy(spark):
    rows = [(i % 5, f"u{i % 4}", "a", "SSO", "fail" if i % 2 else "success", "x", "FR") for i in range(8)]
    rows += [(12, "only", "a", "SSO", "success", "x", "FR")]
    out = by_source(features.window_features(make(spark, rows), "10min"))
    first, second = out["a", DAY], out["a", DAY + dt.timedelta(minutes=10)]
    assert (first["n_attempts"], first["n_fail"], first["n_success"], first["n_users"]) == (8, 4, 4, 4)
    assert first["user_entropy"] == pytest.approx(2.0)
    assert first["attempts_per_min"] == pytest.approx(0.8)
    assert first["fail_rate"] == 0.5
    assert second["user_entropy"] == 0.0
    assert tuple(features.window_features(make(spark, rows), "10min").columns) == ("src_ip", "ts", *FEATURE_COLUMNS)


def test_null_keys_are_dropped_and_null_users_counted_as_attempts(spark):
    rows = [(0, None, "a", "SSO", "fail", "x", "FR"), (1, None, "a", "SSO", "fail", "x", None), (0, "u", None, "SSO", "ok", "x", "FR")]
    out = features.window_features(make(spark, rows)).collect()
    assert len(out) == 1
    assert (out[0]["n_attempts"], out[0]["n_users"], out[0]["user_entropy"], out[0]["n_countries"]) == (2, 0, 0.0, 1)


def test_empty_column_counts_one_but_a_gap_counts_zero(spark):
    rows = [(0, "u", "a", "SSO", "fail", None, "FR"), (0, "u", "b", "SSO", "fail", None, None)]
    out = {r["src_ip"]: r for r in features.window_features(make(spark, rows)).collect()}
    assert out["a"]["n_user_agents"] == out["b"]["n_user_agents"] == 1
    assert out["b"]["n_countries"] == 0


def test_success_after_many_failures(spark):
    rows = [(0, "u", "a", "SSO", "fail", "x", "FR")] * 20 + [(1, "u", "a", "SSO", "success", "x", "FR")]
    assert features.window_features(make(spark, rows)).first()["success_after_fail"] == 1
    assert features.window_features(make(spark, rows), min_fail=21).first()["success_after_fail"] == 0


def test_hot_source_and_repartitioning_change_nothing(spark):
    """A third of all rows in one window of one source."""
    rows = [(0, f"u{i % 50}", "hot", "SSO", "fail", "x", "FR") for i in range(1000)]
    rows += [(i % 60, f"u{i % 7}", f"s{i % 13}", "VPN", "success", "y", "DE") for i in range(2000)]
    df = make(spark, rows)
    one = by_source(features.window_features(df.coalesce(1)))
    many = by_source(features.window_features(df.repartition(13)))
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert r["user_entropy"] == pytest.approx(many[k]["user_entropy"])
        assert r["n_attempts"] == r["n_fail"] + r["n_success"] == many[k]["n_attempts"]
        assert -1e-12 <= r["user_entropy"] <= math.log2(max(r["n_users"], 1)) + 1e-9
    assert sum(r["n_attempts"] for r in one.values()) == 3000
    assert one["hot", DAY]["user_entropy"] == pytest.approx(math.log2(50))


def test_entropy_join_agrees(spark):
    rows = [(i % 30, f"u{i % 5}", f"s{i % 3}", "SSO", "fail", "x", "FR") for i in range(90)]
    df = make(spark, rows)
    whole = features.window_features(df)
    joined = features.attach_entropy(whole, features.user_entropy(features.user_counts(df)))
    left, right = by_source(whole), by_source(joined)
    assert all(left[k]["user_entropy"] == pytest.approx(right[k]["user_entropy"]) for k in left)


def test_approximate_counts(spark):
    rows = [(0, f"u{i}", "a", "SSO", "fail", "x", "FR") for i in range(500)]
    out = features.window_features(make(spark, rows), approx_distinct=True).first()
    assert abs(out["n_users"] - 500) < 60 and out["n_attempts"] == 500


@pytest.mark.parametrize("text,seconds", [("10min", 600), ("1h30m", 5400), ("1 day", 86400), ("30s", 30), ("2T", 120)])
def test_durations(text, seconds):
    assert duration_seconds(text) == seconds


@pytest.mark.parametrize("text", ["500ms", "0s", "fast", "10 parsecs", ""])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        duration_seconds(text)


def test_by_app_and_sorted(spark):
    rows = [(0, "u", "a", app, "fail", "x", "FR") for app in ("VPN", "SSO", "SSO")]
    out = features.sorted_features(features.window_features(make(spark, rows), by_app=True), by_app=True)
    assert [(r["app"], r["n_attempts"]) for r in out.collect()] == [("SSO", 2), ("VPN", 1)]
    assert out.select(F.sum("n_attempts")).first()[0] == 3
