"""Sketches, sliding windows, checks while writing, and the life of intermediate tables."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from authscope import session, sinks
from authscope.operators import forest, normalize, sketches, sliding
from authscope.operators.features import window_features
from authscope.schemas import AUTH_LOG, FEATURE_COLUMNS
from authscope.sources.readers import read_results
from authscope.streaming import windows

START = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    r = random.Random(3)
    rows = [
        (
            START + dt.timedelta(seconds=r.randrange(6 * 3600)),
            f"u{r.randrange(40)}",
            r.choice(["a", "b", "c"]),
            "SSO",
            r.choice(["success", "fail"]),
            None,
            r.choice(["x", None]),
            "FR",
        )
        for _ in range(1500)
    ]
    return session.cut_lineage(spark.createDataFrame(rows, AUTH_LOG))


def test_sketches_of_small_windows_make_wide_ones(log):
    stored = session.cut_lineage(sketches.window_sketches(log, "10min"))
    found = {(x.src_ip, x.ts): x for x in sketches.features_of_sketches(stored, "2h", "10min", min_fail=5).collect()}
    exact = window_features(log, "2h", min_fail=5).collect()
    assert len(found) == len(exact) > 5
    for x in exact:
        y = found[x.src_ip, x.ts]
        assert (y.n_attempts, y.n_fail, y.n_success, y.fail_rate, y.success_after_fail) == (
            x.n_attempts, x.n_fail, x.n_success, x.fail_rate, x.success_after_fail,
        )
        assert y.n_users == x.n_users and y.n_user_agents == x.n_user_agents  # few values: exact
    with pytest.raises(ValueError, match="whole number"):
        sketches.features_of_sketches(stored, "25min", "10min")


def test_sketched_quantiles_are_within_their_error(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, F.xxhash64("id") / 2.0**63).alias("v"))
    df = df.union(spark.sql("SELECT double('NaN') AS v"))
    for share in (0.0, 0.01, 0.5, 0.999):
        cut = sketches.sketched_quantile(df, "v", share, 0.005)
        rank = df.where("v IS NOT NULL AND NOT isnan(v)").agg(F.avg((F.col("v") <= cut).cast("int"))).first()[0]
        assert abs(rank - share) <= 0.005 + 1e-4
    assert sketches.sketched_quantile(df.where("false"), "v", 0.5) is None
    assert sketches.sketch_size(0.0133) <= 205 and sketches.sketch_size(0.001) > 2000
    for bad in (0, 1, 1e-6):
        with pytest.raises(ValueError):
            sketches.sketch_size(bad)


def by_hand(rows, width, slide):
    out = {}
    for x in rows:
        at = int((x.ts - START).total_seconds()) // slide
        for j in range(width // slide):
            out.setdefault((x.src_ip, START + dt.timedelta(seconds=(at - j) * slide)), []).append(x)
    return out


def test_sliding_windows_hold_the_rows_of_their_span(log):
    want = by_hand(log.collect(), 3600, 900)
    found = sliding.sliding_features(log, "1h", "15min").collect()
    assert len(found) == len(want)
    for x in found:
        own = want[x.src_ip, x.ts]
        assert x.n_attempts == len(own) and x.n_users == len({y.user for y in own})
        assert x.n_fail == sum(y.result == "fail" for y in own)
        assert x.n_user_agents == len({y.user_agent for y in own} - {None})
    with pytest.raises(ValueError, match="slides"):
        sliding.sliding_features(log, "1h", "25min")


def test_log_rows_are_scanned_once_and_not_copied_into_windows(log):
    plan = sliding.sliding_features(log, "1h", "5min")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    below = plan[plan.rindex("HashAggregate") :]  # nothing but the stack of counted columns copies a log row
    assert "Expand" not in below and below.count("Generate") <= 1


def test_sliding_stream_agrees_with_the_table(spark, log, tmp_path):
    src = str(tmp_path / "in")
    for lo in (0, 2, 4):
        hours = F.hour("ts")
        log.where((hours >= lo) & (hours < lo + 2)).coalesce(1).write.mode("append").parquet(src)
    rows = windows.read_stream(spark, src, AUTH_LOG, files=1)
    found = sliding.sliding_features(rows, "1h", "30min", delay="5min")
    windows.write_stream(found, str(tmp_path / "f"), str(tmp_path / "s")).awaitTermination()
    closed = spark.read.schema(found.schema).parquet(str(tmp_path / "f"))
    whole = sliding.finish_sliding(closed, log, "1h", "30min", "5min")
    want = sliding.sliding_features(log, "1h", "30min")
    assert 0 < closed.count() < want.count()
    whole, want = (df.withColumn("user_entropy", F.round("user_entropy", 9)) for df in (whole, want))  # order of summation
    assert sorted(map(str, whole.collect())) == sorted(map(str, want.collect()))


def test_alerts_of_a_stream_by_a_forest_of_any_size(spark, log, tmp_path, monkeypatch):
    batch = window_features(log, "10min")
    model = forest.fit_cut(forest.fit_forest(batch, FEATURE_COLUMNS, ["src_ip", "ts"], 10, 64), batch, 0.1)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = windows.read_stream(spark, str(tmp_path / "in"), AUTH_LOG)
    found = windows.stream_features(rows, "10min", "5min")
    windows.write_stream(windows.stream_alerts(found, model), str(tmp_path / "a"), str(tmp_path / "as")).awaitTermination()
    want = spark.read.parquet(str(tmp_path / "a")).collect()
    monkeypatch.setattr(forest, "BROADCAST_NODES", 200)
    with pytest.raises(ValueError, match="write_alerts"):
        windows.stream_alerts(found, model)
    windows.write_alerts(found, model, str(tmp_path / "b"), str(tmp_path / "bs")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "b")).drop("batch").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 3


def jobs_of(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_logs_are_checked_while_they_are_written(spark, log, tmp_path):
    held, jobs = jobs_of(spark, lambda: normalize.write_logs(log, str(tmp_path / "good")))
    assert jobs == 1 and held.count() == log.count()
    bad = log.withColumn("result", F.when(F.col("user") == "u1", F.concat(F.lit("odd"), F.minute("ts"))).otherwise(F.col("result")))
    for check in (normalize.check_logs, lambda df: normalize.write_logs(df, str(tmp_path / "bad"))):
        with pytest.raises(ValueError, match="invalid values in 'result', most frequent: .*odd"):
            check(bad)
    late = log.withColumn("ts", F.when(F.col("user") != "u2", F.col("ts")))
    n = log.where("user = 'u2'").count()
    for check in (normalize.check_logs, lambda df: normalize.write_logs(df, str(tmp_path / "late"))):
        with pytest.raises(ValueError, match=f"failed to parse {n} timestamps"):
            check(late)


def test_the_message_tells_how_many_values_are_not_shown(log):
    bad = log.withColumn("result", F.concat(F.lit("odd"), F.unix_micros("ts").cast("string")))
    with pytest.raises(ValueError, match=r"and \d+ more"):
        normalize.check_logs(bad)


def test_a_run_leaves_no_intermediate_table(spark, log, tmp_path):
    folder = session.checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with session.run_tables(spark):
        outer = session.cut_lineage(log)
        with pytest.raises(RuntimeError), session.run_tables(spark):
            session.cut_lineage(log)
            assert len(set(os.listdir(folder)) - before) == 2
            raise RuntimeError
        assert len(set(os.listdir(folder)) - before) == 1
        found = window_features(outer, "1h")
        sinks.write_table(found, str(tmp_path / "f"))
    assert set(os.listdir(folder)) == before
    assert spark.read.parquet(str(tmp_path / "f")).count() > 10


def test_summaries_and_grids_go_through_csv(spark, tmp_path):
    """Numbers, texts and missing cells come back as they were."""
    grid = spark.createDataFrame(
        [("IsolationForest", 100, 0.5, 0.1, 0.25, 0.5, 0.125), ("LOF", 20, None, None, 0.0, 0.0, 1.0)],
        "model string, n_estimators int, max_samples double, contamination double, f1 double, recall double, precision double",
    )
    summary = spark.createDataFrame([("flows", "atk, a", 0.5, 10), ("flows", 'say "b"', 1.0, 3)], "dataset string, label string, recall double, n int")
    for name, df in (("grid", grid), ("summary", summary)):
        path = sinks.write_table(df, str(tmp_path / name), "csv")
        back = read_results(spark, path, "csv")
        assert back.columns == df.columns and back.dtypes == df.dtypes
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
