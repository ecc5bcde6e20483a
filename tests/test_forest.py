import numpy as np
import pytest
from pyspark.sql import functions as F

from authscope.operators import forest as fo


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    x[:5] += 12
    rows = [(i, *map(float, r), 1.0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, flat double").repartition(4)


COLUMNS = ["a", "b", "c", "flat"]


def nodes(forest):
    """Node table; thresholds rounded, since the scaler's sums depend on their order in the last bit."""
    rounded = forest.nodes.withColumn("threshold", F.round("threshold", 9))
    return sorted(tuple(r) for r in rounded.collect())


@pytest.fixture(scope="module")
def fitted(points):
    return fo.fit_forest(points, COLUMNS, ["id"], 20, 64)


def test_shape_of_the_trees(fitted):
    t = fitted.nodes.toPandas()
    assert fitted.depth == 6 and t["depth"].max() <= 6
    assert set(t["tree"]) == set(range(20))
    root = t[t["node"] == 0]
    assert (root["size"] == 64).all()
    for _, one in t.groupby("tree"):
        assert one[one["is_leaf"]]["size"].sum() == 64
        inner = one[~one["is_leaf"]]
        have = set(one["node"])
        assert all({2 * n + 1, 2 * n + 2} <= have for n in inner["node"])
    assert not (t["feature"] == COLUMNS.index("flat")).any()


def test_same_forest_on_any_partitioning_and_prefix(points, fitted):
    again = fo.fit_forest(points.coalesce(1), COLUMNS, ["id"], 30, 64)
    assert nodes(again.first_trees(20)) == nodes(fitted)
    other = fo.fit_forest(points, COLUMNS, ["id"], 20, 64, seed=7)
    assert nodes(other) != nodes(fitted)


def test_walk_and_joins_agree(points, fitted):
    walk = {r["id"]: r["anomaly_score"] for r in fo.score(points, fitted).collect()}
    joined = {r["id"]: r["anomaly_score"] for r in fo.score_by_joins(points, fitted, ["id"]).collect()}
    assert walk.keys() == joined.keys()
    assert max(abs(walk[k] - joined[k]) for k in walk) < 1e-12
    assert all(0 < v <= 1 for v in walk.values())
    top = sorted(walk, key=walk.get)[-5:]
    assert set(top) == set(range(5))


def test_cut_flags_the_asked_share(points, fitted):
    model = fo.fit_cut(fitted, points, 0.05)
    out = fo.score_and_flag(points, model)
    s = np.array([r[0] for r in out.select("anomaly_score").collect()])
    assert model.cut == pytest.approx(np.percentile(s, 95), rel=1e-12)
    assert out.where("is_anomaly = 1").count() == (s > model.cut).sum()
    with pytest.raises(ValueError):
        fo.fit_cut(fitted, points, 0.7)
    with pytest.raises(ValueError):
        fo.score_and_flag(points, fitted)


def test_scores_do_not_move_when_a_column_is_rescaled(points, fitted):
    wide = points.withColumn("a", F.col("a") * 1024)
    other = fo.fit_forest(wide, COLUMNS, ["id"], 20, 64)
    one = {r["id"]: r["anomaly_score"] for r in fo.score(points, fitted).collect()}
    two = {r["id"]: r["anomaly_score"] for r in fo.score(wide, other).collect()}
    assert max(abs(one[k] - two[k]) for k in one) < 1e-9


def test_level_route_builds_valid_trees_on_all_rows(points):
    """Samples above the window bound: levels by aggregates, then windows."""
    big = fo.fit_forest(points, COLUMNS, ["id"], 4, 1.0, group_rows=100)
    small = fo.fit_forest(points, COLUMNS, ["id"], 4, 1.0)
    assert nodes(big) == nodes(small)
    t = big.nodes.toPandas()
    assert (t[t["node"] == 0]["size"] == 600).all()


def test_several_sizes_at_once(points):
    half, all_rows = fo.fit_forests(points, COLUMNS, ["id"], 3, [0.5, 1.0])
    assert half.sample == 300 and all_rows.sample == 600
    alone = fo.fit_forest(points, COLUMNS, ["id"], 3, 0.5)
    assert nodes(alone) == nodes(half)
    assert set(all_rows.nodes.toPandas()["tree"]) == {0, 1, 2}


def test_identical_rows_give_one_leaf(spark):
    same = spark.range(50).select("id", F.lit(2.0).alias("a"))
    f = fo.fit_forest(same, ["a"], ["id"], 3, 16)
    t = f.nodes.toPandas()
    assert len(t) == 3 and t["is_leaf"].all() and (t["size"] == 16).all()
    assert fo.score(same, f).select("anomaly_score").distinct().count() == 1


def test_missing_numbers_count_as_zero(spark):
    rows = [(i, v) for i, v in enumerate([None, float("nan"), float("inf"), 0.0] * 10 + [5.0] * 10)]
    df = spark.createDataFrame(rows, "id long, a double")
    f = fo.fit_forest(df, ["a"], ["id"], 5, 32)
    s = fo.score(df, f).where("id < 40").select("anomaly_score").distinct().count()
    assert s == 1


def test_large_samples_are_drawn_by_the_same_rule(spark):
    """More rows than one task ranks: exact sizes, and the same trees alone or in a joint fit."""
    df = spark.range(3000).select("id", (F.col("id") % 100).cast("double").alias("a"))
    alone = fo.fit_forest(df, ["a"], ["id"], 3, 0.2)
    joint, whole = fo.fit_forests(df, ["a"], ["id"], 3, [0.2, 0.7], group_rows=100)
    ranked = fo.fit_forest(df, ["a"], ["id"], 3, 0.7)
    assert nodes(alone) == nodes(joint) and nodes(whole) == nodes(ranked)
    for f, size in ((joint, 600), (whole, 2100)):
        assert (f.nodes.where("node = 0").toPandas()["size"] == size).all()


def test_draws_beyond_the_former_pool(spark):
    """Every row can enter a tree, whatever their number."""
    df = spark.range(150_000).select("id", F.col("id").cast("double").alias("a"))
    f = fo.fit_forest(df, ["a"], ["id"], 20, 70_000, group_rows=1000)
    t = f.nodes.where("node = 0").toPandas()
    assert len(t) == 20 and (t["size"] == 70_000).all()


def test_rows_that_share_keys_cannot_fill_a_tree(spark):
    same = spark.range(5000).select(F.lit(1).alias("id"), F.col("id").cast("double").alias("a"))
    with pytest.raises(ValueError, match="share their keys"):
        fo.fit_forest(same, ["a"], ["id"], 3, 16)


def test_sample_size():
    assert fo.sample_size("auto", 100) == 100 and fo.sample_size("auto", 10**6) == 256
    assert fo.sample_size(0.5, 1001) == 500 and fo.sample_size(64, 10) == 10
    with pytest.raises(ValueError):
        fo.sample_size(1.5, 10)
    assert fo.average_path_number(256) == pytest.approx(10.2447, abs=1e-3)


def test_repeated_keys_are_reported(points):
    assert fo.check_key(points, ["id"]) is points
    twice = points.withColumn("id", F.floor(F.col("id") / 2))
    with pytest.raises(ValueError, match="300 values.*600 rows"):
        fo.check_key(twice, ["id"])


@pytest.mark.parametrize("limit", [40, 400])
def test_a_forest_of_any_size_is_scored_cut_and_flagged(points, fitted, monkeypatch, limit):
    """Parts that hold a piece of a tree, several trees, or nearly all: the same numbers as in one walk."""
    walk = {r["id"]: r["anomaly_score"] for r in fo.score(points, fitted).collect()}
    cut, flagged = fo.score_cut_and_flag(points.select("id", *COLUMNS), fitted, 0.05)
    flags = {r["id"]: r["is_anomaly"] for r in flagged.collect()}
    assert len(fo._part_starts(fitted, limit)) >= fitted.nodes.count() / limit > 1
    with monkeypatch.context() as m:
        m.setattr(fo, "BROADCAST_NODES", limit)
        assert {r["id"]: r["anomaly_score"] for r in fo.score(points, fitted).collect()} == walk
        if limit == 400:
            assert fo.fit_cut(fitted, points, 0.05).cut == cut.cut
            again, out = fo.score_cut_and_flag(points.select("id", *COLUMNS), fitted, 0.05)
            assert again.cut == cut.cut and {r["id"]: r["is_anomaly"] for r in out.collect()} == flags
    prefixes = fo.scores_in_parts(points, fitted, [1, 7, 20], "s", limit).select("id", "s").collect()
    want = {r["id"]: r["s"] for r in points.select("id", fo.prefix_scores(fitted, [1, 7, 20]).alias("s")).collect()}
    assert {r["id"]: r["s"] for r in prefixes} == want


def test_parts_hold_few_nodes_and_all_of_them(fitted):
    for limit in (1, 50, 500, 10**6):
        starts = fo._part_starts(fitted, limit)
        sizes = [fo._part(fitted.nodes, a, b).count() for a, b in zip(starts, [*starts[1:], None])] if limit > 50 else []
        assert starts == sorted(starts) and sum(sizes) == (fitted.nodes.count() if sizes else 0) and max([0, *sizes]) <= limit


def test_large_samples_write_no_row_per_tree(points, monkeypatch):
    """Rows are written once; what else is written are nodes."""
    written = []
    plain = fo.cut_lineage
    monkeypatch.setattr(fo, "cut_lineage", lambda df: written.append(df.columns) or plain(df))
    fo.fit_forest(points, COLUMNS, ["id"], 4, 1.0, group_rows=100)
    assert [c for c in written if "f0" in c] == [["_key", "f0", "f1", "f2", "f3", "_x"]]
    assert all("tree" not in c or "node" in c for c in written)


def test_ties_at_a_cut_go_by_key(points, monkeypatch):
    """Few different draws, so that every cut has rows tied at it: both ways take the same rows."""
    monkeypatch.setattr(fo, "PRIME", 31)
    monkeypatch.setattr(fo, "CUT_BINS", 4)
    ranked = fo.fit_forest(points, COLUMNS, ["id"], 5, 300)
    assert nodes(fo.fit_forest(points, COLUMNS, ["id"], 5, 300, group_rows=20)) == nodes(ranked)


def test_parts_go_over_the_rows_together(points, fitted, monkeypatch):
    """One pass for several parts, written between passes alone; the driver is given one part at a time."""
    written, sizes = [], []
    plain, part = fo.cut_lineage, fo._part
    monkeypatch.setattr(fo, "cut_lineage", lambda df: written.append(df.columns) or plain(df))
    monkeypatch.setattr(fo, "_part", lambda *a: sizes.append(part(*a).count()) or part(*a))
    want = {r["id"]: r["s"] for r in points.select("id", fo.prefix_scores(fitted, [1, 7, 20]).alias("s")).collect()}
    for limit in (60, 600):
        written.clear(), sizes.clear()
        found = {r["id"]: r["s"] for r in fo.scores_in_parts(points, fitted, [1, 7, 20], "s", limit).select("id", "s").collect()}
        assert found == want and max(sizes) <= limit
        assert len(written) == (len(sizes) - 1) // 8


def test_levels_write_only_rows_that_a_tree_may_take(spark, monkeypatch):
    df = spark.range(20_000).select("id", (F.col("id") % 997).cast("double").alias("a"))
    ranked = fo.fit_forest(df, ["a"], ["id"], 4, 100)
    written, plain = [], fo.cut_lineage
    monkeypatch.setattr(fo, "cut_lineage", lambda d: written.append(d.count() if "f0" in d.columns else 0) or plain(d))
    assert nodes(fo.fit_forest(df, ["a"], ["id"], 4, 100, group_rows=20)) == nodes(ranked)
    assert 400 < max(written) < 3000
    monkeypatch.setattr(fo, "_likely", lambda s, n: fo.PRIME // 400)  # too low: some tree's sample lies beyond
    assert nodes(fo.fit_forest(df, ["a"], ["id"], 4, 100, group_rows=20)) == nodes(ranked)


def test_a_row_goes_once_to_a_bundle_of_trees(points, monkeypatch):
    """Not once to every tree that takes it; bundles of any size give the same trees."""
    shapes, plain = [], fo._finished
    def counted(grown):
        shapes.append(grown)
        return plain(grown)
    monkeypatch.setattr(fo, "_finished", counted)
    whole = fo.fit_forest(points, COLUMNS, ["id"], 60, 1.0)
    plan = shapes[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "bundle" in plan and plan.count("MapInArrow") == 2
    monkeypatch.setattr(fo, "BUNDLE_VALUES", 100)  # a tree each
    assert nodes(fo.fit_forest(points, COLUMNS, ["id"], 60, 1.0)) == nodes(whole)


def test_samples_whose_rows_fit_a_bundle_are_grown_there(spark, monkeypatch):
    """Not level by level with a row sent to each tree, however many rows a tree has."""
    df = spark.range(70_000).select("id", (F.col("id") % 1009).cast("double").alias("a"))

    def by_levels(*_):
        raise AssertionError("rows go to every tree")

    monkeypatch.setattr(fo, "_grow_large", by_levels)
    t = fo.fit_forest(df, ["a"], ["id"], 3, 1.0).nodes.where("node = 0").toPandas()
    assert len(t) == 3 and (t["size"] == 70_000).all()


def test_rows_of_small_nodes_leave_a_batch_tree_by_tree():
    """A batch of rows makes no batch larger than itself, whatever the number of trees that take them."""
    trees, n = 6, 50

    class Rows:
        mapInArrow = staticmethod(lambda run, schema: run)

    class Sent:
        value = [fo._Upper(np.array([0]), np.array([-1]), np.array([np.nan]))] * trees

    class Members:
        of = staticmethod(lambda batch: ((t, np.arange(batch.num_rows)) for t in range(trees)))

    run = fo._small_rows(Rows, Members, Sent, ["f0"], {t: np.array([0]) for t in range(trees)}, 3)
    batches = list(run([fo.pa.RecordBatch.from_arrays([fo.pa.array(np.arange(n, dtype=np.float64))], ["f0"])]))
    assert sum(b.num_rows for b in batches) == trees * n and max(b.num_rows for b in batches) == n


def _tree_by_rows(own, x, limit, seed):
    """A tree's nodes row by row: {node: (depth, feature, threshold, size)}."""
    import hashlib

    def draw(purpose, node):
        return int(hashlib.md5(f"{seed}:{purpose}:{own}:{node}".encode()).hexdigest()[:8], 16) / 2**32

    found, left = {}, [(0, 0, x)]
    while left:
        node, depth, rows = left.pop()
        usable = [f for f in range(x.shape[1]) if rows[:, f].max() > rows[:, f].min()]
        if depth == limit or not usable:
            found[node] = (depth, -1, None, len(rows))
            continue
        f = usable[int(draw("feature", node) * len(usable))]
        low, high = rows[:, f].min(), rows[:, f].max()
        cut = low + draw("threshold", node) * (high - low)
        found[node] = (depth, f, cut, len(rows))
        beyond = rows[:, f] > cut
        left += [(node * 2 + 1 + s, depth + 1, rows[beyond == s]) for s in (0, 1) if (beyond == s).any()]
    return found


@pytest.mark.parametrize("values", ["real", "few", "late", "one"])
def test_a_tree_is_that_of_its_rows(values):
    """Also where the first rows of a node do not tell that a feature varies."""
    rng = np.random.default_rng(3)
    x = {
        "real": rng.normal(size=(400, 6)), "few": rng.integers(0, 2, size=(400, 3)).astype(float),
        "late": np.vstack([np.zeros((200, 3)), np.eye(3)]), "one": np.ones((9, 2)),
    }[values]
    taken = np.flatnonzero(rng.random(len(x)) < 0.9)
    t = fo._subtree(8, 2, 0, x, 9, 42, taken)
    got = {n: (d, f, None if f < 0 else c, s) for n, d, f, c, s in zip(*[t[c].tolist() for c in ("node", "depth", "feature", "threshold", "size")])}
    assert got == _tree_by_rows(2, x[taken], 9, 42) and set(t["tree"].tolist()) == {8}
