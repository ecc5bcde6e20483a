"""Draws, quantiles, running totals, samples, scaler."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from authscope.functions import draws
from authscope.operators import prefix, quantile, sampling, scaler


def test_draw_is_the_digest_of_its_text(spark):
    got = spark.range(3).select(draws.uniform(42, "x", "id")).collect()
    for i, r in enumerate(got):
        want = int(hashlib.md5(f"42:x:{i}".encode()).hexdigest()[:8], 16) / 2**32
        assert r[0] == want
    same = spark.range(3).select(F.expr(draws.uniform_sql(42, "x", "id"))).collect()
    assert [r[0] for r in same] == [r[0] for r in got]


def test_poisson_and_categorical_shares(spark):
    u = draws.uniform(1, "p", "id")
    rows = spark.range(20000).select(
        draws.poisson(u, 4).alias("n"), draws.categorical(draws.uniform(1, "c", "id"), ("a", "b"), (0.7, 0.3)).alias("c")
    )
    got = rows.agg(F.avg("n").alias("mean"), F.var_pop("n").alias("var"), F.avg((F.col("c") == "a").cast("int")).alias("a")).first()
    assert got["mean"] == pytest.approx(4, abs=0.1) and got["var"] == pytest.approx(4, abs=0.3)
    assert got["a"] == pytest.approx(0.7, abs=0.02)
    with pytest.raises(ValueError):
        draws.categorical(u, ("a", "b"), (0.5, 0.4))


@pytest.mark.parametrize("kind", ["normal", "ties", "wide"])
def test_percentile_equals_numpy(spark, kind):
    rng = np.random.default_rng(3)
    v = {
        "normal": rng.normal(size=3001),
        "ties": np.concatenate([np.full(1000, 2.5), rng.integers(0, 5, 2000)]).astype(float),
        "wide": np.concatenate([rng.normal(size=1000) * 1e-9, rng.normal(size=1000) * 1e9]),
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    shares = [0.0, 0.01, 0.333, 0.5, 0.501, 0.9, 1.0]
    got = quantile.exact_percentiles(df, {"v": shares})
    for s in shares:
        assert got["v", s] == pytest.approx(np.percentile(v, 100 * s), rel=1e-12, abs=1e-15)


def test_percentile_of_nothing(spark):
    assert quantile.exact_percentile(spark.createDataFrame([], "v double"), "v", 0.5) is None


def test_bounded_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    got = quantile.bounded_rows(df, "id", 100)
    assert sorted(r[0] for r in got.collect()) == list(range(100))
    assert quantile.bounded_rows(df, "id", 5000).count() == 1000


def test_positions_and_totals_with_a_hot_leading_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"), "id")
    got = {r["id"]: r for r in prefix.row_positions(df, ["a", "id"]).collect()}
    want = sorted((0 if i % 3 == 0 else i, i) for i in range(3000))
    assert [got[i]["pos"] for _, i in want] == list(range(3000))
    sums = {r["id"]: r["t"] for r in prefix.running_totals(df, ["a", "id"], {"t": "id"}).collect()}
    run = 0
    for _, i in want:
        run += i
        assert sums[i] == run


def test_sequence_time(spark):
    rows = prefix.sequence_time(spark.range(5), ["id"], "2021-01-01").orderBy("id").collect()
    assert [(r["ts"] - rows[0]["ts"]).seconds for r in rows] == [0, 1, 2, 3, 4]


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000)
    one = sorted(r[0] for r in sampling.sample_rows(df, 300, ["id"]).collect())
    two = sorted(r[0] for r in sampling.sample_rows(df.repartition(5), 300, ["id"]).collect())
    assert one == two and len(set(one)) == 300
    assert sampling.sample_rows(df, 9000, ["id"]).count() == 5000


def test_scaler_uses_population_deviation_and_scale_one_for_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, float("inf")), (5.0, 5.0, 2.0)], "a double, b double, c double")
    fitted = scaler.fit_scaler(df, ["a", "b", "c"])
    assert fitted.means == pytest.approx((3.0, 5.0, 2 / 3))
    assert fitted.scales == pytest.approx((np.std([1, 3, 5]), 1.0, np.std([0, 0, 2])))
    out = fitted.transform(df).collect()
    assert [r["b"] for r in out] == [0.0, 0.0, 0.0]
    assert sum(r["a"] for r in out) == pytest.approx(0)
