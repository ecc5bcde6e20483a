import datetime as dt

import pytest
from pyspark.sql import functions as F

from authscope.operators import normalize
from authscope.schemas import AUTH_LOG

COLUMNS = "ts string, user string, src_ip string, app string, result string"


def logs(spark, *results, ts="2024-01-01 00:00:00"):
    return spark.createDataFrame([(ts, "u", "ip", "a", r) for r in results], COLUMNS)


def test_missing_column_is_named_by_its_source(spark):
    raw = logs(spark, "ok").withColumnRenamed("user", "account")
    with pytest.raises(ValueError, match="who"):
        normalize.canonical_logs(raw, normalize.column_map(user="who"))


def test_column_map_refuses_unknown_and_unset():
    with pytest.raises(ValueError):
        normalize.column_map(colour="x")
    with pytest.raises(ValueError):
        normalize.column_map(user=None)
    assert "reason" not in normalize.column_map(reason=None)


def test_result_spellings_and_white_space(spark):
    said = ["OK", " True\t", "1", " Successful\n", "SUCCEED", "false", "0", "　Failed", "failure ", "Fail"]
    out = normalize.canonical_logs(logs(spark, *said)).select("result").collect()
    assert [r[0] for r in out] == ["success"] * 5 + ["fail"] * 5


def test_optional_columns_become_null_and_order_is_fixed(spark):
    out = normalize.canonical_logs(logs(spark, "ok").select("result", "app", "src_ip", "user", "ts", F.lit(1).alias("x")))
    assert out.columns == AUTH_LOG.names
    assert out.first()["country"] is None


def test_bad_times_raise_with_their_count(spark):
    bad = normalize.canonical_logs(logs(spark, "ok", "ok", ts="soon"))
    assert bad.first()["ts"] is None
    with pytest.raises(ValueError, match="2 timestamps"):
        normalize.check_logs(bad)


def test_offsets_are_read_as_utc(spark):
    out = normalize.canonical_logs(logs(spark, "ok", ts="2024-01-01T02:00:00+02:00")).first()
    assert out["ts"] == dt.datetime(2024, 1, 1)


def test_unknown_and_null_results_raise_or_are_set_aside(spark):
    rows = normalize.canonical_logs(logs(spark, "ok", "maybe", None, "1.0"))
    with pytest.raises(ValueError, match="3 invalid.*maybe"):
        normalize.check_logs(rows)
    good, bad = normalize.split_logs(rows)
    assert good.count() == 1 and bad.count() == 3
    assert normalize.check_logs(good).count() == 1


def test_rba_is_chosen_by_its_columns(spark):
    raw = spark.createDataFrame(
        [("2024-01-01 10:00:00", 7, "ip", "FR", "Chrome", True), ("2024-01-01 10:00:00", 7, "ip", "FR", "Chrome", None)],
        "`Login Timestamp` string, `User ID` long, `IP Address` string, Country string, `User Agent String` string, `Login Successful` boolean",
    )
    rows = normalize.auth_logs(raw).collect()
    assert rows[0]["app"] == "rba" and rows[0]["result"] == "success" and rows[0]["user"] == "7"
    assert rows[1]["result"] is None


def test_sorted_logs(spark):
    rows = logs(spark, "ok", ts="2024-01-02 00:00:00").union(logs(spark, "ok"))
    out = normalize.sorted_logs(normalize.canonical_logs(rows)).collect()
    assert out[0]["ts"] < out[1]["ts"]
