"""Readers, sinks, alerts, streams, session."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from authscope import session, sinks
from authscope.operators.alerts import alert_table, top_alerts
from authscope.operators.features import window_features
from authscope.operators.flows import align_columns, distinct_by_group, flow_windows, login_windows
from authscope.operators.forest import fit_cut, fit_forest
from authscope.schemas import AUTH_LOG, FEATURE_COLUMNS
from authscope.sources import readers
from authscope.streaming import windows
from tests import generated_logs as generated


def test_flow_files_with_padded_and_differing_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Destination Port, Flow Bytes,Label\n80,Infinity,BENIGN\n443,NaN,DDoS\n")
    (tmp_path / "b.csv").write_text("Label ,Destination Port\nBot,22\n")
    types = {"Destination Port": "long", "Flow Bytes": "double"}
    out = readers.read_flow_csvs(spark, str(tmp_path / "*.csv"), types)
    assert set(out.columns) == {"Destination Port", "Flow Bytes", "Label"} and out.count() == 3
    assert out.where("Label = 'Bot'").first()["Flow Bytes"] is None
    inferred = readers.read_flow_csvs(spark, str(tmp_path / "*.csv"))
    assert dict(inferred.dtypes)["Destination Port"] in ("int", "bigint")


def test_optional_sources(spark, tmp_path):
    assert readers.read_optional(lambda: spark.read.parquet(str(tmp_path / "none"))) is None
    assert readers.read_optional(lambda: readers.read_flow_csvs(spark, str(tmp_path / "*.none"))) is None
    spark.range(3).write.parquet(str(tmp_path / "some"))
    assert readers.read_optional(lambda: spark.read.parquet(str(tmp_path / "some"))).count() == 3


def test_auth_csv_round_trip_in_both_layouts(spark, tmp_path):
    log = generated.generated_logs(spark, generated.LogPlan(minutes=30)).drop("scenario")
    sinks.write_table(log, str(tmp_path / "log"), "csv")
    back = readers.read_auth_csv(spark, str(tmp_path / "log"))
    assert back.columns == AUTH_LOG.names
    assert back.exceptAll(log.select(back.columns)).isEmpty() and back.count() == log.count()
    (tmp_path / "rba.csv").write_text(
        "Login Timestamp,User ID,IP Address,Country,User Agent String,Login Successful\n"
        "2020-02-03 12:43:30.772,-4324,10.0.65.171,NO,Mozilla,False\n2020-02-03 12:43:43,1,1.2.3.4,AU,X,True\n"
    )
    assert [r["result"] for r in readers.read_auth_csv(spark, str(tmp_path / "rba.csv")).orderBy("ts").collect()] == ["fail", "success"]


def test_partitioned_sink_prunes_days(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d), d) for d in (1, 1, 2)], "ts timestamp, n int")
    path = sinks.write_table(df, str(tmp_path / "t"), by_day="ts")
    assert spark.read.parquet(path).where("day = '2024-01-01'").count() == 2


def test_alerts_without_rows_and_without_optional_columns(spark):
    df = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1), 0.7, 1, 5, 4, 1, 2)],
        "src_ip string, ts timestamp, anomaly_score double, is_anomaly int, n_attempts long, n_fail long, n_success long, n_users long",
    )
    out = alert_table(df)
    assert out.columns == ["src_ip", "ts", "anomaly_score", "n_attempts", "n_fail", "n_success", "n_users", "summary"]
    assert out.first()["summary"] == "score=0.700, attempts=5, fail=4, users=2, fail_rate=0.00, success_after_fail=0"
    assert alert_table(df.withColumn("is_anomaly", F.lit(0))).columns == out.columns
    assert top_alerts(out, 1).count() == 1


def test_label_and_port_gaps_in_flow_windows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, "a", 80, "BENIGN"), (2, t, "a", None, "x"), (3, t, "a", 80, "y"), (4, t, None, 1, "y"), (5, t, "b", 2, "BENIGN")]
    df = spark.createDataFrame(rows, "id long, ts timestamp, src_ip string, dst_port long, label string")
    out = {r["src_ip"]: r for r in flow_windows(df, ["id"]).collect()}
    assert (out["a"]["n_flows"], out["a"]["n_dst_ports"], out["a"]["n_fail"], out["a"]["true_label"]) == (2, 1, 2, "x")
    assert out["a"]["fail_rate"] == pytest.approx(2 / 3)
    assert out["a"]["flows_per_min"] == 0.2 and out["a"]["flows_x6"] == 12
    assert out["b"]["true_label"] == "BENIGN" and set(out) == {"a", "b"}


def test_grouped_distinct_counts_under_skew(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("g"),
        (F.col("id") % 7).alias("u"), (F.col("id") % 11).alias("c"))
    out = {r["g"]: r for r in distinct_by_group(df, ["g"], {"nu": "u", "nc": "c"}, {"s": F.col("u")}, {"m": F.col("c")}).collect()}
    assert out["hot"]["n_rows"] == 1000 and out["hot"]["nu"] == 7 and out["hot"]["nc"] == 11 and out["hot"]["m"] == 10
    assert out["hot"]["s"] == sum(i % 7 for i in range(1000))
    assert sum(r["n_rows"] for r in out.values()) == 3000


def test_login_window_marks(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "a", "u", None, 1, 0), (t, "a", "v", "FR", 0, 1)], "ts timestamp, src_ip string, user string, country string, is_fail int, is_attack int")
    row = login_windows(df).first()
    assert (row["n_flows"], row["n_users"], row["n_countries"], row["n_fail"], row["is_attack_window"]) == (2, 2, 1, 1, 1)


def test_align_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, z double, k string")
    out = align_columns(df, ["b", "a"], keep=["k"])
    assert out.columns == ["k", "b", "a"] and tuple(out.first()) == ("x", 0.0, 1.0)


def test_stream_agrees_with_batch_and_drops_late_rows(spark, tmp_path):
    log = generated.generated_logs(spark, generated.LogPlan(minutes=240)).drop("scenario").select(AUTH_LOG.names)
    late = log.orderBy("ts").limit(50).withColumn("user", F.lit("late"))
    src = str(tmp_path / "in")
    noon = F.lit("2026-02-01 10:00:00").cast("timestamp")
    for part in (log.where(F.col("ts") < noon), log.where(F.col("ts") >= noon), late):
        part.coalesce(1).write.mode("append").parquet(src)
    rows = windows.read_stream(spark, src, AUTH_LOG, files=1)
    found = windows.stream_features(rows, "10min", "5min")
    batch = window_features(log)
    model = fit_cut(fit_forest(batch, FEATURE_COLUMNS, ["src_ip", "ts"], 20), batch, 0.05)
    alerts = windows.stream_alerts(found, model)
    for df, name in ((found, "f"), (alerts, "a")):
        windows.write_stream(df, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    got = {(r["src_ip"], r["ts"]): r for r in spark.read.parquet(str(tmp_path / "f")).collect()}
    want = {(r["src_ip"], r["ts"]): r for r in batch.collect()}
    assert got.keys() <= want.keys() and len(got) > 0.9 * len(want)
    # The late file comes third, when the watermark of the first has passed its windows.
    assert all(got[k]["n_attempts"] == want[k]["n_attempts"] and got[k]["n_users"] == want[k]["n_users"] for k in got)
    assert "summary" in spark.read.parquet(str(tmp_path / "a")).columns


def test_checkpoint_folder_comes_from_the_session(spark):
    assert session.checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.cut_lineage(spark.range(3)).count() == 3
