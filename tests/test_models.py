"""One-class boundary, grid, detection on planted attacks, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from authscope import sinks
from authscope.operators import evaluate
from authscope.operators.forest import score
from authscope.operators.oneclass import fit_one_class, score_one_class
from authscope.plans import evaluation, grid
from authscope.plans.detect import detect
from authscope.sources import readers
from tests import generated_logs as generated


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    x[:40] = rng.normal(size=(40, 2)) * 0.3 + 6
    rows = [(i, float(a), float(b), int(i < 40)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, y int").cache()


def test_one_class_leaves_the_asked_share_outside(planted):
    train = planted.where("y = 0")
    low, high = fit_one_class(train, ["a", "b"], (0.05, 0.4), steps=15)
    for model in (low, high):
        share = score_one_class(train, model).agg(F.avg("is_anomaly")).first()[0]
        assert share == pytest.approx(model.nu, abs=0.02)
    found = score_one_class(planted.where("y = 1"), low).agg(F.avg("is_anomaly")).first()[0]
    assert found == 1.0


def test_grid_chooses_a_forest_that_reproduces_its_line(planted):
    train = planted.where("y = 0")
    choice = grid.choose(
        train, planted, ["a", "b"], ["id"], estimators=(3, 6), shares=(0.5, 1.0), contaminations=(0.1, 0.3),
        neighbors=(5, 20), nus=(0.1,),
    )
    rows = [r.asDict() for r in choice.grid.collect()]
    assert len(rows) == 2 * 2 * 2 + 2 + 1
    assert {r["model"] for r in rows} == {"IsolationForest", "LOF", "OneClassSVM"}
    assert choice.best["f1"] == max(r["f1"] for r in rows)
    best = max((r for r in rows if r["model"] == "IsolationForest"), key=lambda r: r["f1"])
    flagged = score(planted, choice.forest).withColumn("is_anomaly", (F.col("anomaly_score") > choice.forest.cut).cast("int"))
    again = evaluate.quality(evaluate.cells(flagged)).first()
    assert round(again["f1"], 4) == best["f1"]


def test_all_lines_of_a_choice_are_measured_on_the_same_rows(planted, monkeypatch, spark, tmp_path):
    seen = []
    real = grid.measured

    def watched(scored, lines, *more):
        seen.append((scored.count(), scored.agg(F.sum("y")).first()[0]))
        return real(scored, lines, *more)

    monkeypatch.setattr(grid, "measured", watched)
    choice = grid.choose(
        planted.where("y = 0"), planted, ["a", "b"], ["id"], estimators=(3,), shares=(1.0,), contaminations=(0.1,),
        neighbors=(5,), nus=(0.1,), test_rows=150, one_class_rows=100,
    )
    assert choice.tested.count() == 150 and choice.tested.dropDuplicates(["id"]).count() == 150
    assert seen == [(150, choice.tested.agg(F.sum("y")).first()[0])] * 3
    path = sinks.write_table(evaluate.top_of_grid(choice.grid), str(tmp_path / "grid"), "csv")
    back = spark.read.schema(choice.grid.schema).option("header", True).csv(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, choice.grid.collect()))


def test_spray_source_is_found_in_a_generated_log(spark, tmp_path):
    log = generated.generated_logs(spark)
    found = detect(log, n_estimators=50, contamination=0.02)
    flagged = {r["src_ip"] for r in found.alerts.select("src_ip").distinct().collect()}
    assert generated.SPRAY_SOURCE in flagged and generated.BRUTE_SOURCE in flagged
    paths = sinks.write_detection(found, str(tmp_path / "run"))
    back = readers.read_results(spark, paths.alerts)
    assert back.columns == found.alerts.columns and back.count() == found.alerts.count()
    model = sinks.load_forest(spark, paths.model)
    assert model.cut == found.model.cut and model.scaler == found.model.scaler
    one = {(r["src_ip"], r["ts"]): r["anomaly_score"] for r in found.scored.collect()}
    two = {(r["src_ip"], r["ts"]): r["anomaly_score"] for r in score(found.features, model).collect()}
    assert one == two


def test_planted_scenario_is_a_better_label_than_failure(spark):
    log = generated.generated_logs(spark, generated.LogPlan(minutes=430)).withColumn(
        "planted", (F.col("scenario") == "spray").cast("int")
    )
    out = evaluation.auth_logs(log, attack_column="planted", fit=evaluation.Fit(trees=50))
    line = out.recalls.first()
    assert line["n"] > 0 and line["recall"] == 1.0


def test_generated_log_has_its_scenarios_whatever_the_partitioning(spark):
    log = generated.generated_logs(spark)
    rows = {r["scenario"]: r for r in log.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users"), F.countDistinct("src_ip").alias("ips"),
        F.avg((F.col("result") == "fail").cast("int")).alias("fail")).collect()}
    assert abs(rows["spray"]["n"] - 45 * 18) < 120 and rows["spray"]["ips"] == 1 and rows["spray"]["users"] > 120
    assert rows["brute"]["users"] == 1 and rows["brute"]["fail"] == 1.0 and abs(rows["brute"]["n"] - 1100) < 150
    assert rows["outage"]["fail"] == 1.0 and rows["outage"]["users"] <= 60
    assert 0.03 < rows["normal"]["fail"] < 0.1
    slots = generated.minute_slots(spark, generated.MINUTES).repartition(5)
    other = generated.generated_logs(spark, slots=slots)
    assert log.exceptAll(other).isEmpty() and other.exceptAll(log).isEmpty()


def test_no_attack_rows_give_recall_zero(planted):
    none = planted.where("y = 0").withColumn("is_anomaly", F.lit(1))
    line = evaluate.overall_recall(none, "d", "a").first()
    assert line["recall"] == 0.0 and line["n"] == 0
    assert [r["n"] for r in evaluate.confusion(none).orderBy("actual", "predicted").collect()] == [0, 360, 0, 0]


def test_curve_with_ties_and_its_area(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "anomaly_score double, y int")
    rows = evaluate.pr_curve(df).orderBy(F.desc_nulls_last("score")).collect()
    assert [(r["score"], r["precision"], r["recall"]) for r in rows] == [
        (0.9, 0.5, 0.5), (0.5, 2 / 3, 1.0), (0.1, 0.5, 1.0), (None, 1.0, 0.0)]
    assert evaluate.average_precision(df).first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_averaged_boundary_is_near_the_one_of_all_passes(spark):
    from authscope.operators.oneclass import fit_one_class, score_one_class

    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 3))
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)
    far = spark.createDataFrame([(i, 9.0, -9.0, 9.0) for i in range(20)], df.schema)
    whole = fit_one_class(df, ["a", "b", "c"], [0.1, 0.3], features=64)
    parts = fit_one_class(df, ["a", "b", "c"], [0.1, 0.3], features=64, batch_rows=300, key=["id"])
    again = fit_one_class(df.coalesce(1), ["a", "b", "c"], [0.1, 0.3], features=64, batch_rows=300, key=["id"])
    for one, two, three in zip(whole, parts, again):
        out = score_one_class(df, two)
        assert abs(out.where("is_anomaly = 1").count() / 1200 - two.nu) <= 0.02
        assert score_one_class(far, two).where("is_anomaly = 0").count() == 0
        both = score_one_class(df, one).select("id", "is_anomaly").join(out.select("id", out.is_anomaly.alias("other")), "id")
        assert both.where("is_anomaly = other").count() >= 0.9 * 1200
        np.testing.assert_allclose(two.weights, three.weights, rtol=1e-6, atol=1e-9)
    with pytest.raises(ValueError, match="row key"):
        fit_one_class(df, ["a", "b", "c"], batch_rows=300)


def test_the_forest_grid_has_the_trees_of_the_reference(spark, tmp_path):
    """The registered query, on rows of its own: 100, 200 and 300 trees, every share and contamination."""
    import __spark_entry__ as driver

    rows = spark.range(240).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 7).alias("l_partkey"), (F.col("id") % 5).alias("l_suppkey"),
        (F.col("id") % 50).cast("double").alias("l_quantity"), (F.col("id") * 37 % 1000).cast("double").alias("l_extendedprice"),
        (F.col("id") % 11 / 100).alias("l_discount"), (F.col("id") % 9 / 100).alias("l_tax"),
        F.when(F.col("id") % 4 == 0, "R").otherwise("N").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
        F.expr("timestamp'1995-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("l_shipdate"),
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = driver.queries()["grid_forest"](spark, str(tmp_path)).collect()
    assert len(found) == 27 and {r["n_estimators"] for r in found} == {100, 200, 300}
    assert {r["max_samples"] for r in found} == {0.5, 0.8, 1.0} and {r["contamination"] for r in found} == {0.3, 0.4, 0.499}
