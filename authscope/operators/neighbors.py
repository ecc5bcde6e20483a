"""Nearest neighbours, exact and approximate, and the local outlier factor.

The search never pairs all rows. Equal rows are folded into one point with a count, so a
large group of copies is a single point. Points are assigned to the nearest of a set of
pivots drawn from the data (dense regions get more pivots; many pivots form two levels), and
each region is cut into blocks of bounded size. A point is sent only to regions that the triangle inequality cannot
rule out, given a bound on its k-th distance that is refined by a first search in its own
region. Tasks compare a block of points with a block of candidates and emit the k best.

Distances are Euclidean. For data without structure in many dimensions the bounds rule out
little and the work approaches all pairs, still in bounded blocks; ``approximate_neighbors`` or a
sample is the way then. It compares a point only with those that fall on the same side of
random planes, in several tables, and with the sides that the point is nearest to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authscope.functions.draws import uniform
from authscope.operators.quantile import exact_percentile
from authscope.session import arrow_batches, cut_lineage, shuffle_width, spread

BLOCK_ROWS = 1024
MAX_PIVOTS = 2048
PAIRS_PER_BATCH = 16
SLACK = 1e-9  # relative room for rounding when a region is ruled out
TALL, WIDE = 256, 2048  # products of points and candidates taken at once stay in the processor's cache
FIRST_MET = 512
MEET_ROWS = 32768  # asked points that a task holds at once with their lists
RECALL_ROWS, RECALL_SHARE = 256, 0.94  # points whose exact lists tell how large buckets must be
FEW_REGIONS = 8  # a point that asks for more regions than this on average shares them with its block


def fold_copies(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One point per distinct vector: smallest key as its name, and the number of copies."""
    return df.groupBy(F.col(vector).cast("array<double>").alias("x")).agg(
        F.min(key).alias("point"), F.count(F.lit(1)).alias("copies")
    )


def vector_digest(vector: Column) -> Column:
    """128 bits that stand for a vector in joins, so that rows need not be dealt by the whole of it."""
    plain = F.transform(vector.cast("array<double>"), lambda v: v + F.lit(0.0))  # one zero
    return F.struct(F.xxhash64(plain).alias("a"), F.xxhash64(F.lit(1), plain).alias("b"))


def with_factor(df: DataFrame, points: DataFrame, factors: DataFrame, vector: str) -> DataFrame:
    """Rows of ``df`` with the columns that ``factors`` has beside ``point``, by their vectors' points.

    The points have one row a vector, so adaptive execution can split the rows of a very frequent one.
    """
    named = [c for c in factors.columns if c != "point"]
    held = points.select("point", vector_digest(F.col("x")).alias("_digest")).join(factors, "point").select("_digest", *named)
    return df.withColumn("_digest", vector_digest(F.col(vector))).join(held.hint("merge"), "_digest").drop("_digest")


def _pivots(points: DataFrame, total: int, wanted: int, seed: int) -> np.ndarray:
    """Vectors of a keyed draw of ``wanted`` points, at most ``MAX_PIVOTS``, which reach the driver."""
    rows = (
        points.withColumn("_d", uniform(seed, "pivot", "point"))
        .where(F.col("_d") < min(1.0, (2 * wanted + 64) / total))
        .orderBy("_d", "point")
        .limit(wanted)
        .select("x")
        .collect()
    )
    return np.array([r["x"] for r in rows], dtype=np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two small sets, by differences: exact for equal rows."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _matrix(vectors: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _assign(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot of each point and the distance to it."""
    sent = points.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("region int, off double")
    def nearest(x: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(x), sent.value)
        best = d.argmin(axis=1)
        return pd.DataFrame({"region": best.astype(np.int32), "off": d[np.arange(len(d)), best]})

    return points.withColumn("_n", nearest("x")).select(
        "point", "x", "copies", F.col("_n.region").alias("region"), F.col("_n.off").alias("off")
    )


def _blocks_of(rows: DataFrame, region: str) -> DataFrame:
    """Blocks of every region, as a table: there may be very many regions."""
    parts = F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int")
    return cut_lineage(rows.groupBy(F.col(region).alias("_r")).agg(parts.alias("_parts")))


def _search(asked: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Best k candidates of each asked point in its target region. Written at once.

    ``asked`` has point, x, target. Both sides are cut into blocks; every block of asked
    points meets every block of the target region, each such pair under its own join key.
    """
    spark = asked.sparkSession
    blocks, slots = _blocks_of(points, "region"), _blocks_of(asked, "target")
    have = (
        points.join(blocks, F.col("region") == F.col("_r"))
        .withColumn("block", F.pmod(F.hash("point"), F.col("_parts")))
        .groupBy("region", "block")
        .agg(F.collect_list(F.struct("point", "x", "copies")).alias("h"))
        .select("region", "block", F.col("h.point").alias("hp"), F.col("h.x").alias("hx"), F.col("h.copies").alias("hc"))
    )
    ask = (
        asked.join(slots, F.col("target") == F.col("_r"))
        .withColumn("slot", F.pmod(F.hash("point"), F.col("_parts")))
        .groupBy("target", "slot")
        .agg(F.collect_list(F.struct("point", "x")).alias("a"))
        .join(blocks, F.col("target") == F.col("_r"))
        .select(
            F.col("target").alias("region"),
            F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("block"),
            F.col("a.point").alias("ap"),
            F.col("a.x").alias("ax"),
        )
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ap, ax, hp, hx, hc in zip(*[batch[c] for c in ("ap", "ax", "hp", "hx", "hc")]):
                ap, names, copies = np.asarray(ap), np.asarray(hp), np.asarray(hc)
                row, at, far = _best(_distances(_matrix(ax), _matrix(hx)), ap, names, copies, k)
                weight = copies[at] - (names[at] == ap[row])
                yield pd.DataFrame({"point": ap[row], "neighbor": names[at], "distance": far, "weight": weight})

    pairs = ask.join(have, ["region", "block"]).select("ap", "ax", "hp", "hx", "hc")
    met = slots.withColumnRenamed("_parts", "_slots").join(blocks, "_r")
    tasks = min(shuffle_width(spark), met.agg(F.sum(F.col("_slots") * F.col("_parts"))).first()[0] or 1)
    with arrow_batches(spark, PAIRS_PER_BATCH):
        return cut_lineage(
            pairs.repartition(max(1, tasks)).mapInPandas(
                run, "point bigint, neighbor bigint, distance double, weight bigint"
            )
        )


class _Products:
    """Candidates made ready for products with points: half the digits do where lengths leave them room.

    One product a block gives the square of a distance without that of the point's own length, and is compared
    once; rounding is allowed for.
    """

    def __init__(self, x: np.ndarray, size: np.ndarray, own: np.ndarray) -> None:
        self.longest, most = np.fmax.reduce(size), np.fmax.reduce(own)
        half = 1e-12 < self.longest < 1e12 and 1e-12 < most < 1e12 and np.isfinite(size).all() and np.isfinite(own).all()
        self.kind, unit = (np.float32, 1.2e-7) if half else (np.float64, 2.3e-16)
        self.unit = (x.shape[1] + 16) * unit
        right = np.column_stack([-2.0 * x, size**2]).astype(self.kind).T
        self.parts = [np.ascontiguousarray(right[:, j : j + WIDE]) for j in range(0, len(x), WIDE)]

    def within(self, a: np.ndarray, own: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of ``a``, of lengths ``own``, and of candidates that may lie within the limit of the former."""
        bound = (limit**2 * (1 + SLACK) + 2 * self.unit * (own + self.longest) ** 2 - own**2).astype(self.kind)
        left = np.column_stack([a, np.ones(len(a))]).astype(self.kind)
        row, at = [], []
        for j, part in enumerate(self.parts):
            near = np.flatnonzero(left @ part <= bound[:, None])
            r, c = np.divmod(near, part.shape[1])
            row.append(r)
            at.append(c + j * WIDE)
        return np.concatenate(row), np.concatenate(at)


def _first(row: np.ndarray, name: np.ndarray, far: np.ndarray, weight: np.ndarray, k: int) -> tuple:
    """Candidates in order by row until their weights reach k, ties by name, and which of them reach it."""
    order = np.lexsort((name, far, row))
    row, name, far, weight = row[order], name[order], far[order], weight[order]
    before = np.cumsum(weight) - weight
    before -= before[np.searchsorted(row, row)]
    kept = before < k
    return (row[kept], name[kept], far[kept], weight[kept]), (before + weight >= k)[kept]


class _Lists:
    """The nearest candidates so far of a block of asked points, whose candidates come in pieces."""

    def __init__(self, names: np.ndarray, x: np.ndarray, limit: np.ndarray, k: int) -> None:
        self.names, self.x, self.limit, self.k = names, x, limit.copy(), k
        self.size = np.sqrt(np.einsum("ij,ij->i", x, x))
        self.row, self.name, self.far, self.weight = np.zeros(0, np.intp), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def meet(self, names: np.ndarray, x: np.ndarray, copies: np.ndarray) -> None:
        """Candidates that lie near each other; points too far from all of them are passed over."""
        centre = x.mean(axis=0)
        away, reach = _distances(self.x, centre[None, :])[:, 0], _distances(x, centre[None, :]).max()
        rows = np.flatnonzero(~(away - reach > self.limit + SLACK * (1.0 + away + reach)))  # undefined: not ruled out
        first, end = 0, 0
        while first < len(x) and len(rows):
            # Points without a limit get one from a few candidates, and a nearer one from some more.
            end = min(len(x), max(FIRST_MET, 4 * end)) if np.isinf(self.limit[rows]).any() or first else len(x)
            self._add(rows, names[first:end], x[first:end], copies[first:end])
            first = end

    def _add(self, rows: np.ndarray, names: np.ndarray, x: np.ndarray, copies: np.ndarray) -> None:
        """Lists of ``rows`` with some candidates more; only those that a candidate may enter are put in order anew."""
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        products = _Products(x, size, self.size[rows]) if np.isfinite(self.limit[rows]).all() else None
        step = max(1, TALL * WIDE * 4 // len(x))
        found = [self._near(rows[i : i + step], names, x, copies, size, products) for i in range(0, len(rows), step)]
        new = [np.concatenate(c) for c in zip(*found)]
        if not len(new[0]):
            return
        met = np.zeros(len(self.names), bool)
        met[new[0]] = True
        held = (self.row, self.name, self.far, self.weight)
        again = met[self.row]
        listed, full = _first(*(np.concatenate([c[again], n]) for c, n in zip(held, new)), self.k)
        self.limit[listed[0][full]] = np.minimum(self.limit[listed[0][full]], listed[2][full])
        both = [np.concatenate([c[~again], n]) for c, n in zip(held, listed)]
        order = np.argsort(both[0], kind="stable")  # two runs in order
        self.row, self.name, self.far, self.weight = (c[order] for c in both)

    def _near(self, rows: np.ndarray, names: np.ndarray, x: np.ndarray, copies: np.ndarray, size: np.ndarray, products: _Products | None) -> tuple:
        """Candidates that may be among the k nearest by products of vectors, with their exact distances."""
        a, own = self.x[rows], self.size[rows]
        if products is not None:
            row, at = products.within(a, own, self.limit[rows])
        else:
            square = own[:, None] ** 2 + size[None, :] ** 2 - 2.0 * (a @ x.T)
            error = (x.shape[1] + 16) * 2.3e-16 * (own + np.fmax.reduce(size)) ** 2  # more than rounding can make of it
            most = self.limit[rows] ** 2 * (1 + SLACK)
            if len(x) > self.k + 1:  # the point itself may be one of them
                most = np.fmin(most, np.partition(square, self.k, axis=1)[:, self.k] + error)
            row, at = np.nonzero(square <= (most + error)[:, None])
        weight = copies[at] - (names[at] == self.names[rows[row]])
        row, at, weight = row[weight > 0], at[weight > 0], weight[weight > 0]
        far = np.empty(len(row))
        step = max(1, 1_000_000 // x.shape[1])
        for i in range(0, len(row), step):
            diff = a[row[i : i + step]] - x[at[i : i + step]]
            far[i : i + step] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        kept = np.isfinite(far) & (far <= self.limit[rows[row]])
        # Far limits let many pass: no more than the lists hold leave a block.
        return _first(rows[row[kept]], names[at[kept]], far[kept], weight[kept], self.k)[0]

    def table(self) -> pa.RecordBatch:
        columns = [pa.array(self.names[self.row]), pa.array(self.name), pa.array(self.far), pa.array(self.weight)]
        return pa.RecordBatch.from_arrays(columns, ["point", "neighbor", "distance", "weight"])


def _meet(asked: DataFrame, have: DataFrame, tasks: int, k: int, numbered: bool) -> DataFrame:
    """Best k candidates of each asked point in its cell: point, neighbor, distance, weight.

    ``asked`` has cell, point, x, limit and ``have`` has cell, region, point, x, copies. The rows of a cell come
    to one task, first the asked points, of which a cell has a bounded number; the others pass by in
    pieces and are never held. ``numbered`` says that cells are the numbers of the tasks.
    """
    rows = asked.select("cell", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("region"), "point", "x", F.lit(0).cast("long").alias("copies"), "limit")
    rows = rows.unionByName(have.select("cell", F.lit(1).alias("kind"), F.col("region").cast("long").alias("region"), "point", "x", "copies", F.lit(math.inf).alias("limit")))
    dealt = rows.repartitionById(tasks, F.col("cell").cast("int")) if numbered else rows.repartition(tasks, "cell")

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, met, lists = None, [], None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("cell", "kind", "region")])
            ends = [*(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for first, end in zip([0, *ends], ends):
                part = batch.slice(first, end - first)
                if cell != at[0, first]:
                    if lists is not None:
                        yield lists.table()
                    cell, met, lists = at[0, first], [], None
                names, x = part.column("point").to_numpy(), vectors(part)
                if not at[1, first]:
                    met.append((names, x, part.column("limit").to_numpy()))
                    continue
                if lists is None and met:
                    lists = _Lists(*[np.concatenate(c) for c in zip(*met)], k)
                    met = []
                if lists is not None:
                    lists.meet(names, x, part.column("copies").to_numpy())
        if lists is not None:
            yield lists.table()

    return dealt.sortWithinPartitions("cell", "kind", "region").mapInArrow(
        run, "point bigint, neighbor bigint, distance double, weight bigint"
    )


def _sweep(asked: DataFrame, points: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """Best k candidates of points that ask for many regions each, ``found`` beside their own.

    Blocks of asked points from regions that lie along each other share what they ask for: a point of a region
    goes once to a block, not once to every point that asks. There are as many blocks as tasks, so
    what is shuffled grows with the points until a block has ``MEET_ROWS``, and from there with the square
    of their number divided by it.
    """
    spark = points.sparkSession
    counts = {r["region"]: r["count"] for r in asked.groupBy("region").count().collect()}  # a row a pivot
    total = sum(counts.values())
    blocks = max(1, min(spark.sparkContext.defaultParallelism, total // BLOCK_ROWS), math.ceil(total / MEET_ROWS))
    centred = pivots - pivots.mean(axis=0)
    along = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
    places, before = [], 0
    for region in along.tolist():
        places.append((region, before / total, counts.get(region, 0) / total))
        before += counts.get(region, 0)
    starts = spark.createDataFrame(places, "_r int, _start double, _share double")
    share = F.col("_start") + F.col("_share") * uniform(0, "block", "point")
    cell = F.least(F.floor(share * blocks), F.lit(blocks - 1)).cast("long")
    dealt = asked.join(F.broadcast(starts), F.col("region") == F.col("_r")).withColumn("cell", cell)
    wanted = dealt.select("cell", F.explode(F.array_union("found", F.array("region"))).alias("_w")).distinct()
    have = points.join(wanted, F.col("region") == F.col("_w")).select("cell", "region", "point", "x", "copies")
    return _meet(dealt, have, blocks, k, numbered=True)


def _best(far: np.ndarray, asked: np.ndarray, names: np.ndarray, copies: np.ndarray, k: int) -> tuple:
    """Of each row of distances the nearest candidates until their weights reach k, ties by name.

    A point is no neighbour of itself, its other copies are. Gives rows, candidates and distances.
    """
    weight = copies[None, :] - (names[None, :] == asked[:, None])
    far = np.where(weight > 0, far, np.inf)
    limit = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(far), np.inf)
    row, at = np.nonzero((far <= limit[:, None]) & np.isfinite(far))
    order = np.lexsort((names[at], far[row, at], row))
    row, at = row[order], at[order]
    before = np.cumsum(weight[row, at]) - weight[row, at]
    first = np.searchsorted(row, row)  # place of each row's first candidate
    kept = before - before[first] < k if len(row) else np.zeros(0, bool)
    row, at = row[kept], at[kept]
    return row, at, far[row, at]


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The first k candidates of each point counting copies, the last one cut to fit.

    A candidate comes from one block only, so none repeats; each weighs at least one, so no
    more than k rows of a point matter and the ranking drops the rest before the shuffle.
    """
    order = W.partitionBy("point").orderBy("distance", "neighbor")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        found.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k)
        .withColumn("_before", before)
        .where(F.col("_before") < k)
        .select("point", "neighbor", "distance", F.least(F.col("weight"), F.lit(k) - F.col("_before")).alias("weight"))
    )


def _sure(d: np.ndarray, copies: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """For each row of distances to pivots, one within which k other rows lie, wherever in their regions."""
    if copies.sum() < k + 1:
        return np.full(len(d), np.inf)
    reach = np.where(copies > 0, d + high, np.inf)
    order = np.argsort(reach, axis=1)
    enough = (np.cumsum(copies[order], axis=1) >= k + 1).argmax(axis=1)
    return np.take_along_axis(reach, order, axis=1)[np.arange(len(d)), enough]


def _open(d: np.ndarray, pivots: np.ndarray, copies: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which regions may hold something within the limit of each row of distances to their pivots.

    What a region holds is nearer to its pivot than to any other one of the same draw, so it lies
    beyond the plane halfway to the pivot that is nearest to the row.
    """
    near, back = np.unique(d.argmin(axis=1), return_inverse=True)
    own_d = d.min(axis=1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d**2 - own_d**2) / (2 * _distances(pivots[near], pivots)[back])
    plane = np.where(np.isfinite(plane), plane, 0.0)
    nearest = np.maximum(np.maximum(d - high, low - d), plane)
    return (copies > 0) & (nearest <= limit[:, None] + SLACK * (1.0 + d + own_d))


def _extents(points: DataFrame, *by: str) -> DataFrame:
    """Of each region the rows it stands for and its least and largest distance from the pivot."""
    return points.groupBy(*by).agg(F.sum("copies").alias("copies"), F.min("off").alias("low"), F.max("off").alias("high"))


def _targets(
    points: DataFrame, bounds: DataFrame, pivots: np.ndarray, stats: list, k: int, own: bool = False, kept: Sequence[str] = ()
) -> DataFrame:
    """The regions that may hold one of the k nearest of a point, as ``found``, with the point's limit.

    A point's own region is among them only with ``own``. Columns ``kept`` of the bounds stay.
    """
    size = len(pivots)
    copies, low, high = np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)
    for s in stats:
        copies[s["region"]], low[s["region"]], high[s["region"]] = s["copies"], s["low"], s["high"]
    sent = points.sparkSession.sparkContext.broadcast((pivots, copies, low, high))

    @F.pandas_udf("found array<int>, limit double")
    def reachable(x: pd.Series, region: pd.Series, bound: pd.Series) -> pd.DataFrame:
        pivots, copies, low, high = sent.value
        x, own_region, bound = _matrix(x), region.to_numpy(), bound.fillna(np.inf).to_numpy()
        found, limits = [], []
        for i in range(0, len(x), BLOCK_ROWS):  # rows times pivots several times over
            d = _distances(x[i : i + BLOCK_ROWS], pivots)
            limit = np.minimum(_sure(d, copies, high, k), bound[i : i + BLOCK_ROWS])
            ok = _open(d, pivots, copies, low, high, limit)
            ok[np.arange(len(d)), own_region[i : i + BLOCK_ROWS]] = own
            found += [np.flatnonzero(r).astype(np.int32) for r in ok]
            limits.append(limit)
        return pd.DataFrame({"found": found, "limit": np.concatenate(limits) if limits else np.zeros(0)})

    reachable = reachable.asNondeterministic()  # else it is taken once more for the rows that are kept
    met = points.join(bounds, "point", "left").withColumn("_r", reachable("x", "region", "bound"))
    return met.select("point", "x", "region", *kept, F.col("_r.limit").alias("limit"), F.col("_r.found").alias("found")).where(F.size("found") > 0)


def _leaves(points: DataFrame, seed: int) -> DataFrame:
    """Pivots within each region, as many as its points ask for: a row (top, pivots) each."""
    sizes = points.groupBy(F.col("region").alias("top")).agg(F.count(F.lit(1)).alias("_rows"))
    wanted = F.least(F.lit(MAX_PIVOTS), F.ceil(F.col("_rows") / BLOCK_ROWS) * 4, F.col("_rows"))
    drawn = (
        points.join(F.broadcast(sizes), F.col("region") == F.col("top"))  # a row a pivot of the first level
        .withColumn("_d", uniform(seed, "leaf", "point"))
        .where(F.col("_d") * F.col("_rows") < 2 * wanted + 64)
        .withColumn("_i", F.row_number().over(W.partitionBy("top").orderBy("_d", "point")))
        .where(F.col("_i") <= wanted)
    )
    ordered = F.array_sort(F.collect_list(F.struct("_i", "x")))
    return drawn.groupBy("top").agg(F.transform(ordered, lambda p: p["x"]).alias("pivots"))


def _in_blocks(rows: DataFrame, region: str, *columns: str) -> DataFrame:
    """Rows (top, h), ``h`` the structs of a block of bounded size of the rows of one region."""
    blocks = _blocks_of(rows, region)
    held = rows.join(blocks, F.col(region) == F.col("_r")).withColumn("_block", F.pmod(F.hash("point"), F.col("_parts")))
    return held.groupBy(F.col(region).alias("top"), "_block").agg(F.collect_list(F.struct(*columns)).alias("h")).drop("_block")


def _assign_leaves(points: DataFrame, leaves: DataFrame) -> DataFrame:
    """Points with the nearest pivot of their region: ``region`` is the leaf now, ``top`` the region."""

    @F.pandas_udf("leaf array<int>, off array<double>")
    def nearest(x: pd.Series, pivots: pd.Series) -> pd.DataFrame:
        leaf, off = [], []
        for a, p in zip(x, pivots):
            d = _distances(_matrix(a), _matrix(p))
            leaf.append(d.argmin(axis=1).astype(np.int32))
            off.append(d.min(axis=1))
        return pd.DataFrame({"leaf": leaf, "off": off})

    met = _in_blocks(points, "region", "point", "x", "copies").join(leaves, "top").withColumn("_n", nearest("h.x", "pivots"))
    held = met.select("top", "h", F.col("_n.leaf").alias("leaf"), F.col("_n.off").alias("off"))
    both = held.select("top", F.explode(F.arrays_zip("h", "leaf", "off")).alias("z"))
    leaf = F.col("top").cast("long") * MAX_PIVOTS + F.col("z.leaf")
    return both.select("z.h.point", "z.h.x", "z.h.copies", "top", leaf.alias("region"), "z.off")


def _leaf_targets(asked: DataFrame, points: DataFrame, leaves: DataFrame, k: int) -> DataFrame:
    """Leaves, other than a point's own, of the regions asked for that may hold one of its k nearest.

    ``asked`` has point, x, leaf, limit and the region as target.
    """
    extents = _extents(points, "top", "region").groupBy("top").agg(F.collect_list(F.struct("region", "copies", "low", "high")).alias("s"))
    known = leaves.join(extents, "top").select("top", "pivots", "s")

    @F.pandas_udf("array<array<bigint>>")
    def reachable(x: pd.Series, own: pd.Series, limit: pd.Series, pivots: pd.Series, leaf: pd.Series, copies: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        out = []
        for a, mine, most, p, *held in zip(x, own, limit, pivots, leaf, copies, low, high):
            names, p = np.asarray(held[0]), _matrix(p)
            at = names % MAX_PIVOTS
            n, lo, hi = np.zeros(len(p)), np.full(len(p), np.inf), np.full(len(p), -np.inf)
            n[at], lo[at], hi[at] = held[1:]
            d = _distances(_matrix(a), p)
            ok = _open(d, p, n, lo, hi, np.minimum(np.asarray(most), _sure(d, n, hi, k)))
            first = names[0] - at[0]
            out.append([f[f != m] for f, m in zip((np.flatnonzero(r) + first for r in ok), mine)])
        return pd.Series(out)

    met = _in_blocks(asked, "target", "point", "x", "leaf", "limit").join(known, "top")
    found = reachable("h.x", "h.leaf", "h.limit", "pivots", "s.region", "s.copies", "s.low", "s.high")
    both = met.select("h", found.alias("found")).select(F.explode(F.arrays_zip("h", "found")).alias("z"))
    return both.select("z.h.point", "z.h.x", F.explode("z.found").alias("target"))


def neighbors_of_points(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Neighbour table of points with copies: point, neighbor, distance, weight.

    There are four pivots for every ``BLOCK_ROWS`` points. Where that is more than ``MAX_PIVOTS`` the
    pivots form two levels: about the root of their number part the points into regions, and each
    region is parted by pivots of its own, which are joined by region and never sent to all tasks.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    total = points.count()
    if not total:
        raise ValueError("no rows")
    wanted = min(math.ceil(total / BLOCK_ROWS) * 4, total)
    deep = wanted > MAX_PIVOTS
    pivots = _pivots(points, total, min(MAX_PIVOTS, math.ceil(math.sqrt(wanted))) if deep else wanted, seed)
    points = cut_lineage(_assign(spread(points), pivots))
    stats = _extents(points, "region").collect()
    if deep:
        tops, leaves = points, cut_lineage(_leaves(points, seed))
        with arrow_batches(points.sparkSession, PAIRS_PER_BATCH):
            points = cut_lineage(_assign_leaves(points, leaves))
    own = _search(points.select("point", "x", F.col("region").alias("target")), points, k)
    near = first_k(own, k)
    if len(stats) == 1 and not deep:
        return near
    full = F.sum("weight") >= k
    bounds = near.groupBy("point").agg(F.when(full, F.max("distance")).alias("bound"))
    if deep:
        bounds = points.select("point", F.col("region").alias("leaf")).join(bounds, "point", "left")
        asked = cut_lineage(_targets(tops, bounds, pivots, stats, k, own=True, kept=("leaf",)))
    else:
        tops, asked = points, cut_lineage(_targets(points, bounds, pivots, stats, k))
    requests = asked.agg(F.sum(F.size("found"))).first()[0]
    if not requests:
        return near
    if requests > FEW_REGIONS * total:
        rest = own.join(asked.select("point"), "point", "left_anti")
        return first_k(rest.unionByName(cut_lineage(_sweep(asked, tops, pivots, k))), k)
    asked = asked.withColumn("target", F.explode("found")).drop("found", "region")
    if deep:
        with arrow_batches(points.sparkSession, PAIRS_PER_BATCH):
            asked = cut_lineage(_leaf_targets(asked, points, leaves, k))
        if asked.isEmpty():
            return near
    return first_k(own.unionByName(_search(asked, points, k)), k)


def _planes(points: DataFrame, tables: int, bits: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions for every table and bit, and where each plane lies: at the points' mean."""
    random = np.random.default_rng(seed)
    means = points.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()
    centre = np.zeros(width)
    for r in means:  # one row a component
        centre[r["i"]] = r["m"]
    directions = random.normal(size=(width, tables * bits))
    return directions, centre @ directions


def _lists_of_few(few: list, points: DataFrame, k: int) -> DataFrame:
    """Exact neighbour table of a few (point, x) given on the driver: one pass over the points."""
    names, x = np.array([r["point"] for r in few], dtype=np.int64), np.array([r["x"] for r in few], dtype=np.float64)
    sent = points.sparkSession.sparkContext.broadcast((names, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists(*sent.value, np.full(len(sent.value[0]), np.inf), k)
        for batch in batches:
            if batch.num_rows:
                held = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                lists.meet(batch.column("point").to_numpy(), held, batch.column("copies").to_numpy())
        yield lists.table()

    found = spread(points.select("point", "x", "copies")).mapInArrow(run, "point bigint, neighbor bigint, distance double, weight bigint")
    return first_k(found, k)


def _enough_bits(points: DataFrame, planes: tuple, k: int, tables: int, probes: int, bits: int, total: int, seed: int) -> int:
    """The most planes a table, up to ``bits``, with which the lists of a draw of points miss few neighbours."""
    drawn = points.withColumn("_d", uniform(seed, "recall", "point")).where(F.col("_d") < min(1.0, (2 * RECALL_ROWS + 64) / total))
    few = drawn.orderBy("_d", "point").limit(RECALL_ROWS).select("point", "x").collect()
    listed = _lists_of_few(few, points, k).select(F.col("point").alias("asked"), "neighbor", "weight")
    near = points.select("point", "x").join(F.broadcast(listed), F.col("point") == F.col("neighbor")).collect()  # k a point drawn
    if not near:
        return bits
    directions, shift = planes
    place = {r["point"]: i for i, r in enumerate(few)}
    asked = np.array([place[r["asked"]] for r in near])
    weight = np.array([r["weight"] for r in near])
    sides = [(_matrix([r["x"] for r in rows]) @ directions - shift).reshape(len(rows), tables, -1) for rows in (few, near)]
    for b in range(bits, 0, -1):
        own, theirs = sides[0][asked, :, :b], sides[1][:, :, :b]
        apart = (own > 0) != (theirs > 0)
        probed = np.argsort(np.argsort(np.abs(own), axis=2, kind="stable"), axis=2, kind="stable") < probes
        met = ((apart.sum(axis=2) == 0) | ((apart.sum(axis=2) == 1) & (apart & probed).any(axis=2))).any(axis=1)
        if weight[met].sum() >= RECALL_SHARE * weight.sum():
            return b
    return 0


def approximate_neighbors(
    points: DataFrame, k: int, tables: int = 12, probes: int = 3, bits: int | None = None, seed: int = 42
) -> DataFrame:
    """Neighbour table like ``neighbors_of_points``, in which a neighbour may be missed.

    In each table ``bits`` random planes part the points into buckets; a point is compared exactly
    with its own bucket and with those beyond the ``probes`` planes nearest to it. Without ``bits``
    a bucket holds about a quarter of a block of points, or more where the exact lists of a small draw of
    points would miss more than six in a hundred: without structure in many dimensions buckets grow with the points. What is
    shuffled is tables * (probes + 2) times the points in any case. ``recall`` measures what was found. With
    fewer points near a point than k its list is short.
    """
    if k < 1 or tables < 1 or probes < 0:
        raise ValueError("k and tables are at least 1, probes at least 0")
    shape = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    if not shape["n"]:
        raise ValueError("no rows")
    given, most = bits is not None, min(40, max(0, round(math.log2(shape["n"] / (BLOCK_ROWS / 4)))))
    bits = bits if given else most
    planes = _planes(points, tables, max(1, bits), shape["width"], seed)
    if not given:
        bits = _enough_bits(points, planes, k, tables, probes, bits, shape["n"], seed)
    probes = min(probes, bits)
    sent = points.sparkSession.sparkContext.broadcast(planes)

    @F.pandas_udf("array<array<bigint>>")
    def buckets(x: pd.Series) -> pd.Series:
        directions, shift = sent.value
        side = (_matrix(x) @ directions - shift).reshape(len(x), tables, -1)
        power = np.int64(1) << np.arange(bits, dtype=np.int64)
        own = (side[:, :, :bits] > 0).astype(np.int64) @ power + (np.arange(tables, dtype=np.int64) << bits)
        found = own[:, :, None]
        if probes:
            near = np.argsort(np.abs(side[:, :, :bits]), axis=2, kind="stable")[:, :, :probes]
            found = np.concatenate([found, own[:, :, None] ^ power[near]], axis=2)
        return pd.Series([list(v) for v in found])

    dealt = cut_lineage(spread(points).withColumn("buckets", buckets("x")))
    have = dealt.select("point", "x", "copies", F.explode(F.transform("buckets", lambda b: b[0])).alias("region"))
    asked = dealt.select("point", "x", F.explode(F.flatten("buckets")).alias("region"))
    # Only a bucket that very many points ask for is met by several blocks of them.
    slots = asked.groupBy(F.col("region").alias("_r")).agg(F.ceil(F.count(F.lit(1)) / F.lit(MEET_ROWS // 4)).cast("long").alias("_parts"))
    slots = F.broadcast(cut_lineage(slots.where("_parts > 1")))
    first = F.col("region") * F.lit(2**18)
    slot = F.coalesce(F.pmod(F.hash("point"), F.col("_parts")), F.lit(0))
    asked = asked.join(slots, F.col("region") == F.col("_r"), "left").select((first + slot).alias("cell"), "point", "x", F.lit(math.inf).alias("limit"))
    each = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    have = have.join(slots, F.col("region") == F.col("_r"), "left").select("region", "point", "x", "copies", F.explode(each).alias("_slot"))
    have = have.select((first + F.col("_slot")).alias("cell"), "region", "point", "x", "copies")
    found = _meet(asked, have, shuffle_width(points.sparkSession), k, numbered=False)
    return first_k(found.repartition(shuffle_width(points.sparkSession), "point").dropDuplicates(["point", "neighbor"]), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours, by weight, whose distance the found lists reach as well.

    A neighbour as far away as an exact one is as good, so ties at the end of a list count.
    """
    ends = exact.groupBy("point").agg(F.max("distance").alias("end"), F.sum("weight").alias("all"))
    near = found.join(ends.drop("all"), "point").where(F.col("distance") <= F.col("end") * (1 + SLACK))
    return near.agg(F.sum("weight")).first()[0] / ends.agg(F.sum("all")).first()[0]


def nearest_neighbors(df: DataFrame, k: int, key: str = "vec_id", vector: str = "x", seed: int = 42) -> DataFrame:
    """The k nearest other rows of each distinct vector.

    Returns point, neighbor, distance, weight: a vector is named by the smallest key among
    its copies, and a neighbour stands for ``weight`` rows. The weights of a point add up to
    k, or to all other rows when there are fewer.
    """
    return neighbors_of_points(cut_lineage(fold_copies(df, key, vector)), k, seed)


def outlier_factor(neighbors: DataFrame) -> DataFrame:
    """Local outlier factor of each point of a neighbour table.

    Each neighbour's own reach and density come by an equi-join on its name. A point that
    is near to very many others makes that key hot on the list side; the other side has one
    row per point, so adaptive execution can split the hot part.
    """
    reach = neighbors.groupBy(F.col("point").alias("neighbor")).agg(F.max("distance").alias("k_distance"))
    listed = neighbors.join(reach, "neighbor")
    spaced = F.sum(F.col("weight") * F.greatest("k_distance", "distance")) / F.sum("weight")
    density = listed.groupBy("point").agg((F.lit(1.0) / (spaced + F.lit(1e-10))).alias("density"))
    density = cut_lineage(density)
    around = neighbors.join(density.select(F.col("point").alias("neighbor"), F.col("density").alias("theirs")), "neighbor")
    mean = around.groupBy("point").agg((F.sum(F.col("weight") * F.col("theirs")) / F.sum("weight")).alias("theirs"))
    return mean.join(density, "point").select("point", (F.col("theirs") / F.col("density")).alias("lof"))


def local_outlier_factor(
    df: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "x", seed: int = 42, approximate: bool = False
) -> DataFrame:
    """Rows of ``df`` with their factor; copies of a vector share it."""
    points = cut_lineage(fold_copies(df, key, vector))
    search = approximate_neighbors if approximate else neighbors_of_points
    factors = outlier_factor(cut_lineage(search(points, k, seed=seed)))
    return with_factor(df, points, factors, vector)


def flag_outliers(factors: DataFrame, contamination: float, name: str = "lof") -> DataFrame:
    """Flag the share of rows with the largest factor; the sample is judged by its own cut."""
    held = cut_lineage(factors)
    cut = exact_percentile(held, name, 1 - contamination)
    return held.withColumn("is_anomaly", (F.col(name) > F.lit(cut)).cast("int"))


def vector_of(df: DataFrame, columns: Sequence[str], name: str = "x") -> DataFrame:
    """Columns gathered into one vector column."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))
