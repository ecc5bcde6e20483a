"""Cases that once gave wrong results: infinities, missing labels, text booleans, repeated scans."""

import math

import pytest
from pyspark.sql import functions as F

from authscope.operators import features, prefix
from authscope.operators.evaluate import class_report
from authscope.operators.flows import UNKNOWN_ATTACK, flow_windows, login_records
from authscope.operators.quantile import exact_percentile, exact_percentiles, value_at_rank
from authscope.plans import evaluation
from authscope.schemas import RBA_ATTACK, RBA_COLUMNS


def test_percentiles_with_infinities(spark):
    v = [1.0, 2.0, 3.0, math.inf, -math.inf, math.inf]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    wanted = {0.0: -math.inf, 0.2: 1.0, 0.3: 1.5, 0.4: 2.0, 0.6: 3.0, 0.7: math.inf, 0.9: math.inf, 1.0: math.inf}
    for share, want in wanted.items():
        assert exact_percentile(df, "v", share) == pytest.approx(want)
    assert [value_at_rank(df, "v", r) for r in range(7)] == [-math.inf, 1.0, 2.0, 3.0, math.inf, math.inf, None]
    only = spark.createDataFrame([(math.inf,), (math.inf,)], "v double")
    assert exact_percentile(only, "v", 0.5) == math.inf


def test_percentiles_over_the_whole_range_of_doubles(spark):
    v = [-1.7e308, -1.0, 0.0, 1.0, 1.7e308]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert exact_percentiles(df, {"v": [0.0, 0.25, 0.5, 0.75, 1.0]}) == {("v", s): x for s, x in zip((0.0, 0.25, 0.5, 0.75, 1.0), v)}


def flows(spark, labels):
    rows = [(i, "s", 80 + i % 2, l) for i, l in enumerate(labels)]
    return spark.createDataFrame(rows, "id int, src_ip string, dst_port int, label string").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )


@pytest.mark.parametrize(
    "labels, want, fails",
    [
        ([None, "x", "x"], "x", 3),
        ([None, None], UNKNOWN_ATTACK, 2),
        (["BENIGN", "BENIGN"], "BENIGN", 0),
        (["BENIGN", "b", "a"], "b", 2),
        ([None, "BENIGN"], UNKNOWN_ATTACK, 1),
    ],
)
def test_first_attack_label_skips_missing_ones(spark, labels, want, fails):
    row = flow_windows(flows(spark, labels), ["id"]).first()
    assert (row["true_label"], row["n_fail"], row["n_flows"]) == (want, fails, len(labels))


def test_flow_counts_are_hash_aggregates(spark):
    plan = flow_windows(flows(spark, ["BENIGN", "b"]), ["id"])._jdf.queryExecution().executedPlan().toString()
    counts = [line for line in plan.split("\n") if "sum(is_fail" in line or "n_rows" in line and "Aggregate" in line]
    assert counts and not any("SortAggregate" in line for line in counts)


def test_login_rows_from_text(spark, tmp_path):
    names = [RBA_COLUMNS[c] for c in ("ts", "user", "src_ip", "country", "result")] + [RBA_ATTACK]
    lines = [",".join(names)]
    for ok, bad in (("True", "False"), ("false", "TRUE"), ("1", "0"), ("0", "1"), ("", ""), (" true ", "x")):
        lines.append(f"2024-01-01 00:00:00,u,1.2.3.4,DE,{ok},{bad}")
    (tmp_path / "logins.csv").write_text("\n".join(lines) + "\n")
    rows = login_records(spark.read.csv(str(tmp_path / "logins.csv"), header=True)).collect()
    assert [(r["is_fail"], r["is_attack"]) for r in rows] == [(0, 0), (1, 1), (0, 0), (1, 1), (0, 0), (0, 0)]


def test_class_report_scans_once(spark, tmp_path):
    spark.createDataFrame([(0, 0)] * 5 + [(0, 1), (1, 0), (1, 1), (1, 1)], "y int, is_anomaly int").write.parquet(f"{tmp_path}/t")
    report = class_report(spark.read.parquet(f"{tmp_path}/t"))
    assert report._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = {r["name"]: r for r in report.collect()}
    assert rows["accuracy"]["f1"] == pytest.approx(7 / 9) and rows["ATTACK"]["recall"] == pytest.approx(2 / 3)
    assert rows["macro avg"]["precision"] == pytest.approx((5 / 6 + 2 / 3) / 2) and rows["weighted avg"]["support"] == 9
    empty = class_report(spark.createDataFrame([], "y int, is_anomaly int")).collect()
    assert all(r["f1"] == 0 and r["support"] == 0 for r in empty)


def test_running_totals_shuffle_once(spark, tmp_path):
    rows = [(i * 7 % 500, None if i % 11 == 0 else i) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, v long").repartition(4)
    out = prefix.running_totals(df, ["a"], {"t": "v", "u": "a"})
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    seen, t, u = {r["a"]: (r["t"], r["u"]) for r in out.collect()}, 0, 0
    for a, v in sorted(rows):
        t, u = t + (v or 0), u + a
        assert seen[a] == (t, u)
    assert prefix.running_totals(df.where("a < 0"), ["a"], {"t": "v"}).count() == 0
    assert [r["t"] for r in prefix.running_totals(df.orderBy("a").limit(3), [F.desc("a")], {"t": "a"}).orderBy("a").collect()] == [3, 3, 2]


def test_features_read_the_log_once(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i % 9}:00", "s", f"u{i % 3}", "A", None, "DE", "fail") for i in range(20)]
    names = ("ts", "src_ip", "user", "app", "user_agent", "country", "result")
    spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/l")
    logs = spark.read.parquet(f"{tmp_path}/l")
    out = features.window_features(logs, "1d")
    assert str(tmp_path) not in out._jdf.queryExecution().executedPlan().toString()  # only the written windows are read
    row = out.first()
    assert (row["n_users"], row["n_apps"], row["n_user_agents"], row["n_countries"]) == (3, 1, 1, 1)
    sketch = features.window_features(logs, "1d", approx_distinct=True).first()
    assert sketch["user_entropy"] == pytest.approx(row["user_entropy"]) and row["user_entropy"] > 1.5


def test_approximate_counts_stay_near_in_very_many_windows(spark):
    """The users of one source in 3,000, whose number was once given as 4,615."""
    users = spark.range(4000).select(F.concat(F.lit("user"), F.col("id") * 3000 + 2168).alias("user"))
    logs = users.withColumns({"ts": F.timestamp_seconds(F.lit(0)), "src_ip": F.lit("a"), "result": F.lit("fail")})
    logs = logs.withColumns({c: F.lit(None).cast("string") for c in ("app", "user_agent", "country")})
    found = features.window_features(logs, "1d", approx_distinct=True).first()
    assert abs(found["n_users"] - 4000) < 250 and found["n_apps"] == 0


def test_routes_without_harmless_rows_measure_nothing(spark):
    """Every window holds an attack, so nothing can be fitted: no rows are flagged, and none are counted."""
    rows = [(f"2024-01-0{1 + i % 3} 00:00:00", i, "ip", "FR", "Chrome", False, True) for i in range(12)]
    names = "`Login Timestamp` string, `User ID` long, `IP Address` string, Country string, `User Agent String` string, `Login Successful` boolean, `Is Attack IP` boolean"
    found = evaluation.risk_logins(spark.createDataFrame(rows, names), window="1 day")
    assert [tuple(r) for r in found.recalls.collect()] == [("logins", "Is Attack IP", 0.0, 0)]
    assert found.model is None and found.flags.count() == 0 and found.report.where("support > 0").count() == 0
    logs = spark.range(9).select(
        F.timestamp_seconds("id").alias("ts"), F.lit("u").alias("user"), F.lit("ip").alias("src_ip"), F.lit("VPN").alias("app"), F.lit("fail").alias("result")
    )
    assert [tuple(r) for r in evaluation.auth_logs(logs).recalls.collect()] == [("logs", "attack", 0.0, 0)]
    flows = spark.createDataFrame([(i, float(i), "atk_a") for i in range(9)], "id long, v double, label string")
    assert evaluation.raw_flows(flows, ["id"], drop=["id"]).recalls.count() == 0


def test_forest_flags_scores_each_row_once(spark, monkeypatch):
    """The training rows are among those to flag, and are not scored for the cut beside that."""
    from authscope.operators import forest
    from registry.queries import QUERIES

    scored, score = [], forest.score
    monkeypatch.setattr(forest, "score", lambda df, *a, **k: scored.append(df.count()) or score(df, *a, **k))
    QUERIES["forest_flags"](spark, "/root/testdata/sf0.001").collect()
    assert sum(scored) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_eval_split_draws_each_row_once(spark, monkeypatch):
    """Passes of the model read the drawn rows, without a digest for the split; the text of the key is kept for fitted rows."""
    from authscope.functions.draws import key_text
    from authscope.sources import adapters
    from registry.queries import QUERIES

    given, run = [], evaluation.split_flows
    monkeypatch.setattr(evaluation, "split_flows", lambda train, test, *a, **k: given.extend([train, test]) or run(train, test, *a, **k))
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    sf = "/root/testdata/sf0.001"
    QUERIES["eval_split"](spark, sf).collect()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
    assert not any("md5" in x._jdf.queryExecution().optimizedPlan().toString() for x in given)
    flows = adapters.flows(adapters.table(spark, sf, "lineitem"))
    drawn = flows.where(adapters.train_draw() < 0.7)
    assert given[0].count() == drawn.count() and given[1].count() == flows.count() - drawn.count()
    fitted = drawn.where("label = 'BENIGN'").select(key_text(*adapters.FLOW_KEY).alias("row"))
    kept = given[0].where("label = 0").select("row")
    assert kept.count() == fitted.count() and kept.exceptAll(fitted).isEmpty()


def test_draws_of_a_tree_are_those_of_the_division():
    import numpy as np

    from authscope.operators.forest import PRIME, _drawn

    ends = [0, 1, 2, PRIME - 2, PRIME - 1]
    x = np.concatenate([ends, np.random.default_rng(51).integers(0, PRIME, 5000)]).astype(np.int64)
    for a in [1, 2, PRIME - 2, PRIME - 1, 1234567891]:
        for b in [*ends, 987654321]:
            assert np.array_equal(_drawn(x, a, b), (a * x + b) % PRIME)
