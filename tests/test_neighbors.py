import numpy as np
import pytest
from pyspark.sql import functions as F

from authscope.operators import neighbors as nb


def brute(x, k):
    """Factor by comparing everything with everything; ties by the first equal row."""
    first = {}
    name = np.array([first.setdefault(tuple(r), i) for i, r in enumerate(x)])
    d = nb._distances(x, x)
    np.fill_diagonal(d, np.inf)
    order = np.stack([np.lexsort((name, r))[:k] for r in d])
    near = np.take_along_axis(d, order, axis=1)
    reach = np.maximum(near[:, -1][order], near)
    density = 1 / (reach.mean(axis=1) + 1e-10)
    return density[order].mean(axis=1) / density, near


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, x array<double>")


@pytest.mark.parametrize("k", [3, 12])
def test_factor_equals_brute_force_over_many_regions_and_copies(spark, monkeypatch, k):
    """A third of the rows are copies of one vector; regions and blocks are small."""
    monkeypatch.setattr(nb, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.05, (120, 3)), rng.normal(5, 0.5, (80, 3)), rng.uniform(-9, 9, (60, 3))])
    x = np.concatenate([x, np.tile([[1.0, 2.0, 3.0]], (130, 1))])
    want, _ = brute(x, k)
    got = nb.local_outlier_factor(table(spark, x), k).toPandas().sort_values("vec_id")["lof"].to_numpy()
    assert len(got) == len(x)
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize(("k", "most"), [(3, 8), (12, 3), (5, 1)])
def test_two_levels_of_pivots_give_the_same_as_brute_force(spark, monkeypatch, k, most):
    """More pivots than one level takes; a third of the rows are copies, many distances tie."""
    monkeypatch.setattr(nb, "BLOCK_ROWS", 24)
    monkeypatch.setattr(nb, "MAX_PIVOTS", most)
    rng = np.random.default_rng(4)
    grid = np.stack(np.meshgrid(np.arange(8.0), np.arange(8.0), [0.0]), -1).reshape(-1, 3)
    x = np.concatenate([rng.normal(0, 0.05, (70, 3)), rng.normal(5, 0.5, (60, 3)), grid, np.tile([[1.0, 2.0, 3.0]], (90, 1))])
    points = nb.cut_lineage(nb.fold_copies(table(spark, x), "vec_id", "x"))
    found = nb.neighbors_of_points(points, k).toPandas()
    assert (found.groupby("point")["weight"].sum() == k).all() and not found.duplicated(["point", "neighbor"]).any()
    want, near = brute(x, k)
    for p, g in found.groupby("point"):
        np.testing.assert_allclose(np.sort(np.repeat(g["distance"], g["weight"])), near[p])
    if k == 3:
        factors = nb.with_factor(table(spark, x), points, nb.outlier_factor(nb.cut_lineage(spark.createDataFrame(found))), "x")
        np.testing.assert_allclose(factors.toPandas().sort_values("vec_id")["lof"].to_numpy(), want, rtol=1e-9)


def test_leaves_rule_out_most_of_the_points(spark, monkeypatch):
    """Groups far apart: what a point is compared with is its own surroundings, on both levels."""
    monkeypatch.setattr(nb, "BLOCK_ROWS", 8)
    monkeypatch.setattr(nb, "MAX_PIVOTS", 16)
    asked, search = [], nb._search
    monkeypatch.setattr(nb, "_search", lambda a, p, k: asked.append((a.count(), p.groupBy("region").count().count())) or search(a, p, k))
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(0, 0.1, (20, 2)) for c in rng.uniform(-100, 100, (12, 2))])
    nb.nearest_neighbors(table(spark, x), 3).collect()
    (own, leaves), (more, _) = asked
    assert own == len(x) and leaves > 16
    assert more < 0.2 * leaves * len(x)


def test_neighbours_are_exact_and_weights_add_up(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 5))
    _, near = brute(x, 7)
    out = nb.nearest_neighbors(table(spark, x), 7).toPandas()
    assert (out.groupby("point")["weight"].sum() == 7).all()
    for p, g in out.groupby("point"):
        np.testing.assert_allclose(np.sort(g["distance"]), near[p])


def test_fewer_rows_than_neighbours(spark):
    out = nb.nearest_neighbors(table(spark, np.eye(3)), 10)
    assert {r["point"]: r["w"] for r in out.groupBy("point").agg(F.sum("weight").alias("w")).collect()} == {0: 2, 1: 2, 2: 2}


def test_flagged_share(spark):
    x = np.random.default_rng(3).normal(size=(100, 2))
    factors = nb.local_outlier_factor(table(spark, x), 5)
    assert nb.flag_outliers(factors, 0.1).where("is_anomaly = 1").count() == 10


def test_best_candidates_by_distance_then_name_until_k():
    far = np.array([[0.0, 2.0, 1.0, 1.0, 5.0], [2.0, 0.0, 3.0, 3.0, 3.0]])
    names, copies = np.array([10, 11, 13, 12, 14]), np.array([1, 1, 2, 1, 4])
    row, at, d = nb._best(far, np.array([10, 11]), names, copies, 3)
    assert [(int(r), int(names[a]), float(x)) for r, a, x in zip(row, at, d)] == [
        (0, 12, 1.0), (0, 13, 1.0), (1, 10, 2.0), (1, 12, 3.0), (1, 13, 3.0),
    ]
    row, at, _ = nb._best(far[:1], np.array([10]), names, np.array([3, 1, 2, 1, 4]), 2)
    assert names[at].tolist() == [10]  # its own copies come first


def test_approximate_lists_miss_little_and_more_tables_less(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 4, (12, 16))
    x = np.concatenate([c + rng.normal(size=(70, 16)) for c in centres] + [np.tile(centres[:1], (300, 1))])
    points = nb.cut_lineage(nb.fold_copies(table(spark, x), "vec_id", "x"))
    exact = nb.cut_lineage(nb.neighbors_of_points(points, 8))
    share = [nb.recall(nb.approximate_neighbors(points, 8, t, p, bits=5), exact) for t, p in ((1, 0), (12, 3))]
    assert share[0] < share[1] and share[1] >= 0.9
    assert nb.recall(nb.approximate_neighbors(points, 8, 1, 0, bits=0), exact) == 1.0  # one bucket: all pairs
    factors = nb.local_outlier_factor(table(spark, x), 8, approximate=True)
    assert factors.count() == len(x)
    for bad in ((0, 1, 0), (1, 0, 0), (1, 1, -1)):
        with pytest.raises(ValueError):
            nb.approximate_neighbors(points, *bad)
    with pytest.raises(ValueError, match="no rows"):
        nb.approximate_neighbors(points.where("false"), 3)


def test_factors_come_back_to_copies_and_to_both_zeros(spark):
    rows = [(i, [float(i % 7), 0.0]) for i in range(20)] + [(30, [1.0, -0.0]), (31, [50.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, x array<double>")
    found = {r["vec_id"]: r["lof"] for r in nb.local_outlier_factor(df, 4).collect()}
    assert len(found) == 22 and found[30] == found[1] == found[8]
    assert found[31] == max(found.values())


@pytest.mark.parametrize(("meet", "most"), [(64, 4096), (500, 4096), (100, 6)])
def test_dense_requests_are_shared_by_blocks_and_exact(spark, monkeypatch, meet, most):
    """No structure, so nearly every region may hold neighbours: vectors are not written once per request."""
    monkeypatch.setattr(nb, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nb, "MAX_PIVOTS", most)
    monkeypatch.setattr(nb, "FEW_REGIONS", 2, raising=False)
    monkeypatch.setattr(nb, "MEET_ROWS", meet, raising=False)
    rng = np.random.default_rng(8)
    x = np.concatenate([1e4 + rng.normal(size=(200, 12)), np.tile(1e4 + rng.normal(size=(1, 12)), (40, 1)), np.round(1e4 + rng.normal(size=(60, 12)))])
    points = nb.cut_lineage(nb.fold_copies(table(spark, x), "vec_id", "x"))
    written, plain = [], nb.cut_lineage
    def recorded(df):
        out = plain(df)
        written.append(out.count() if "x" in out.columns else 0)
        return out
    monkeypatch.setattr(nb, "cut_lineage", recorded)
    found = nb.neighbors_of_points(points, 6).toPandas()
    assert max(written) <= points.count()
    _, near = brute(x, 6)
    assert (found.groupby("point")["weight"].sum() == 6).all() and not found.duplicated(["point", "neighbor"]).any()
    for p, g in found.groupby("point"):
        np.testing.assert_allclose(np.sort(np.repeat(g["distance"], g["weight"])), near[p], rtol=1e-12)


def test_lists_from_pieces_are_those_of_all_at_once():
    """Ties go by name over all pieces, a point's own copies count, undefined vectors are no neighbours."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(150, 3)) * 2)
    names, copies = rng.permutation(150).astype(np.int64), rng.integers(1, 4, 150)
    lists = nb._Lists(names[:50], x[:50], np.full(50, np.inf), 7)
    bad = np.array([[np.nan, 0.0, 0.0], [np.inf, 0.0, 0.0]])
    for part in np.array_split(np.arange(150), 4):
        lists.meet(np.append(names[part], [900, 901]), np.concatenate([x[part], bad]), np.append(copies[part], [1, 1]))
    row, at, far = nb._best(nb._distances(x[:50], x), names[:50], names, copies, 7)
    assert lists.row.tolist() == row.tolist() and lists.name.tolist() == names[at].tolist()
    np.testing.assert_allclose(lists.far, far)


def test_buckets_grow_until_nine_tenths_are_found(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 64)
    x = np.random.default_rng(10).normal(size=(3000, 32))
    points = nb.cut_lineage(nb.fold_copies(table(spark, x), "vec_id", "x"))
    found = nb.cut_lineage(nb.approximate_neighbors(points, 10))
    assert nb.recall(found, nb.neighbors_of_points(points, 10)) >= 0.9


@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e15])
def test_points_with_a_limit_compare_products_once(scale, monkeypatch):
    """No row of distances is parted once ten neighbours bound it; the lists are those of all distances."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8)) * scale
    x[:40] = np.round(rng.normal(size=(40, 8))) * scale  # equal distances as well
    names, copies = np.arange(3000), rng.integers(1, 4, size=3000)
    lists = nb._Lists(names[:700], x[:700], np.full(700, np.inf), 10)
    lists.meet(names[:1000], x[:1000], copies[:1000])
    assert np.isfinite(lists.limit).all()

    def parted(*_, **__):
        raise AssertionError("a row of distances was parted")

    monkeypatch.setattr(nb.np, "partition", parted)
    lists.meet(names[1000:], x[1000:], copies[1000:])
    monkeypatch.undo()
    far = np.sqrt(((x[:700, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    row, at, want = nb._best(far, names[:700], names, copies, 10)
    got = sorted(zip(*[c.to_pylist() for c in lists.table().columns[:2]]))
    assert got == sorted(zip(row.tolist(), at.tolist()))
    assert np.allclose(sorted(lists.far), sorted(want), rtol=1e-12)
