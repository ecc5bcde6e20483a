"""Isolation forest: sampling, growing, scoring and the cut, as Spark jobs.

Two ways to grow, chosen by the size of a tree's sample:

* up to ``GROUP_ROWS`` rows per tree (the default of 256 is far below), or where all rows fit a bundle: the samples are
  partitioned by bundles of trees of bounded size and grown tree by tree. The whole forest is one job, and
  a row goes once to a bundle however many of its trees take it.
* larger samples are drawn by the same rule, but no row is ever written once per tree: the rows are
  kept once, and for each level every task walks its rows down the nodes chosen so far, tree by
  tree in numpy, and hands on counts and ranges by ``(tree, node)``, which merge. A node is left alone
  once it is small, and the rows of all small nodes then go to the first way in one shuffle.

A forest of any size scores, cuts and flags: a small one in one walk, a large one in parts of its node
table of bounded size, with the path lengths so far carried along by the rows.

All draws are keyed by seed, tree and node, so the forest is the same on any partitioning,
and the first k trees of a larger forest are the forest of k trees.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authscope.functions.draws import digest32, key_text, numbered_draws, uniform, uniform_sql
from authscope.operators.quantile import exact_percentile
from authscope.operators.scaler import Scaler, fit_scaler
from authscope.operators.sketches import sketched_quantile
from authscope.schemas import AUTO_SAMPLE, DEFAULT_SEED, DEFAULT_TREES
from authscope.session import cut_lineage, shuffle_width, spread

GROUP_ROWS = 65536
BROADCAST_NODES = 500_000  # of a forest sent to the tasks at once; the driver holds no more of them
PARTS_A_PASS = 8  # parts of so many nodes that a task may hold
UPPER_NODES = 4_000_000  # above the groups of a large sample
BUNDLE_VALUES = 2**23  # numbers of the rows of a bundle of trees: 64 MB
NODES_A_BATCH = 2**16
LOOKED_AT = 4  # rows of a node that are compared before all are
CUT_BINS = 2048
ROWS_PER_TASK = 20_000
PRIME = 2147483647  # 2 ** 31 - 1
EULER = 0.5772156649015329
PATH_PLACES = 9

GROWN = "tree int, node long, depth int, feature int, threshold double, size long"
NODE_TYPES = {"tree": "int32", "node": "int64", "depth": "int32", "feature": "int32", "threshold": "float64", "size": "int64"}
NODE_COLUMNS = ("tree", "node", "depth", "feature", "threshold", "size", "is_leaf")


@dataclass(frozen=True)
class Forest:
    """Node table with everything needed to score."""

    nodes: DataFrame
    scaler: Scaler
    trees: int
    sample: int
    depth: int
    seed: int
    cut: float | None = None

    def first_trees(self, n: int) -> Forest:
        """The forest of the first ``n`` trees; its cut has to be taken anew."""
        return replace(self, nodes=self.nodes.where(F.col("tree") < n), trees=n, cut=None)


def average_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    d = n.cast("double")
    long = 2.0 * (F.log(F.greatest(d - 1.0, F.lit(1.0))) + F.lit(EULER)) - 2.0 * (d - 1.0) / F.greatest(d, F.lit(1.0))
    return F.when(d <= 1, 0.0).when(d == 2, 1.0).otherwise(long)


def average_path_number(n: int) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def sample_size(max_samples: str | int | float, rows: int) -> int:
    """Rows per tree: ``auto``, a number of rows, or a share of them."""
    if max_samples == "auto":
        return min(AUTO_SAMPLE, rows)
    if isinstance(max_samples, float):
        if not 0 < max_samples <= 1:
            raise ValueError("a share of rows lies in (0, 1]")
        return max(1, int(max_samples * rows))
    return min(int(max_samples), rows)


def _multipliers(seed: int, trees: int) -> list[tuple[int, int, int]]:
    """Per tree, the two numbers of a linear hash modulo the prime."""

    def number(purpose: str, tree: int) -> int:
        return int(hashlib.md5(f"{seed}:{purpose}:{tree}".encode()).hexdigest()[:8], 16)

    return [(t, number("mul", t) % (PRIME - 1) + 1, number("add", t) % PRIME) for t in range(trees)]


def _drawn(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """(a * x + b) modulo the prime, for 64-bit integers below it, as 32-bit ones without a sign.

    2 ** 31 leaves 1, so the upper bits count once more as lower ones; the sum is below twice the prime. A
    division takes some thirty times as long.
    """
    draw = x.view(np.uint64) * np.uint64(a)
    draw += np.uint64(b)
    upper = draw >> np.uint64(31)
    draw &= np.uint64(PRIME)
    draw += upper
    draw = draw.astype(np.uint32)
    return np.minimum(draw, draw - np.uint32(PRIME))  # below zero is above all


def _with_digest(rows: DataFrame, seed: int) -> DataFrame:
    """One digest a row, from which its draws in all trees follow."""
    return rows.withColumn("_x", digest32(F.lit(f"{seed}:row"), "_key") % F.lit(PRIME))


def _by_group(values: Sequence[int], trees: int) -> str:
    """A number per group of trees, as SQL."""
    if len(values) == 1:
        return str(values[0])
    return f"get(array({', '.join(str(v) for v in values)}), cast(tree div {trees} as int))"


def _tasks(rows: int, df: DataFrame) -> int:
    """Tasks for a known number of rows, whatever the size of the cluster."""
    return min(shuffle_width(df.sparkSession), max(8, rows // ROWS_PER_TASK))


def _likely(sample: int, total: int) -> int:
    """Draw below which a tree's sample lies, all but surely."""
    return int(min(1.0, (4 * sample + 64) / total) * PRIME) + 1


def _grow_samples(rows: DataFrame, total: int, width: int, samples: Sequence[int], limits: Sequence[int], trees: int, seed: int) -> DataFrame:
    """Draws a sample per tree without replacement, the rows first by (draw, key), and grows it. Returns the nodes.

    A linear hash per tree of a row's digest is its draw there. A row goes once to each bundle of trees in one
    of which its draw is low enough to count, not once to each tree; a bundle takes up to
    ``BUNDLE_VALUES`` numbers, or the candidates of one tree, and grows tree by tree. Tree numbers run on over
    the groups; the same tree of two groups has the same draws, so its smaller sample lies within
    the larger one.
    """
    count, cols = trees * len(samples), _names(width)
    likely = [_likely(s, total) for s in samples]
    held = sum(trees * min(total, 4 * s + 64) * width for s in samples)
    bundles = min(count, max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-held // BUNDLE_VALUES) if total * width > BUNDLE_VALUES else 1))
    numbers, samples, limits = _multipliers(seed, trees), list(samples), list(limits)
    own = [range(b, count, bundles) for b in range(bundles)]  # large samples and small ones in each
    names = rows.columns
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def emitted(batches):
        for batch in batches:
            x = batch.column("_x").to_numpy()
            low = np.zeros((bundles, len(x)), bool)
            for t, a, b in numbers:
                draw = _drawn(x, a, b)
                for g, bound in enumerate(likely):
                    low[(g * trees + t) % bundles] |= draw < bound
            bundle, at = np.nonzero(low)
            for i in range(0, len(at), len(x)):  # no batch grows with the number of bundles
                found = batch.select(names).take(pa.array(at[i : i + len(x)]))
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(bundle[i : i + len(x)].astype(np.int32))], [*names, "bundle"])

    def grown(batches):
        keys, digests, values, bundle = [], [], [], None
        for batch in batches:
            if batch.num_rows:
                bundle = batch.column("bundle")[0].as_py()
                keys.append(batch.column("_key"))
                digests.append(batch.column("_x").to_numpy())
                values.append(_matrix(batch, cols))
        if bundle is None:
            return
        order = pc.sort_indices(pa.chunked_array(keys)).to_numpy()  # ties of draws go by key
        x = np.concatenate(digests)[order]
        place = np.empty(len(order), np.int64)  # where in its order each row goes
        place[order] = np.arange(len(order))
        sorted_values, first = np.empty((len(order), width)), 0
        for i, part in enumerate(values):
            sorted_values[place[first : first + len(part)]] = part
            first, values[i] = first + len(part), None  # rows are not held twice
        keys.clear(), digests.clear()
        for tree in own[bundle]:
            g, (_, a, b) = tree // trees, numbers[tree % trees]
            draw = _drawn(x, a, b)
            candidates = np.flatnonzero(draw < likely[g])
            taken = candidates[np.argsort(draw[candidates], kind="stable")[: samples[g]]]
            if len(taken):
                yield from _node_batches(_subtree(tree, tree % trees, 0, sorted_values, limits[g], seed, taken))

    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", bundle int"
    dealt = rows.mapInArrow(emitted, schema).repartitionById(bundles, F.col("bundle"))
    return _finished(dealt.mapInArrow(grown, GROWN))


@dataclass(frozen=True)
class _Members:
    """Which rows each tree's sample holds: those below its cut, and up to a key those at it."""

    numbers: list[tuple[int, int, int]]
    trees: int
    cuts: list[int]
    last: list[str | None]

    def of(self, batch: pa.RecordBatch):
        """(tree, places of its rows in the batch), for all trees."""
        x, keys = batch.column("_x").to_numpy(), batch.column("_key")
        for t, a, b in self.numbers:
            draw = _drawn(x, a, b)
            for tree in range(t, len(self.cuts), self.trees):
                held = draw < self.cuts[tree]
                for i in np.flatnonzero(draw == self.cuts[tree]).tolist():
                    held[i] = self.last[tree] is not None and keys[i].as_py() <= self.last[tree]
                yield tree, np.flatnonzero(held)


def _members(rows: DataFrame, samples: Sequence[int], trees: int, seed: int) -> _Members:
    """The same samples as ``_grow_samples``, told by each tree's exact draw at which it is full.

    Every pass counts ``CUT_BINS`` ranges of draws for all trees, task by task, and goes on in the
    range that holds the cut; only rows tied at it are ranked. Counts alone leave the tasks.
    """
    numbers = _multipliers(seed, trees)
    wanted = [samples[t // trees] for t in range(trees * len(samples))]
    first, width, before = [0] * len(wanted), [PRIME] * len(wanted), [0] * len(wanted)
    while max(width) > 1:
        step = -(-max(width) // CUT_BINS)

        def counted(batches, first=tuple(first), step=step):
            counts = np.zeros((len(first), CUT_BINS), np.int64)
            for batch in batches:
                x = batch.column("_x").to_numpy()
                for t, a, b in numbers:
                    draw = _drawn(x, a, b)
                    for tree in range(t, len(first), trees):
                        at = (draw - first[tree]) // step
                        at = at[(at >= 0) & (at < CUT_BINS)]
                        counts[tree] += np.bincount(at, minlength=CUT_BINS)
            slot = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts.ravel()[slot])], ["slot", "n"])

        found = rows.select("_x").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        counts = np.zeros((len(wanted), CUT_BINS), np.int64)
        for r in found.collect():  # trees x bins
            counts.ravel()[r["slot"]] = r["n"]
        for t, row in enumerate(counts):
            upto = before[t] + np.cumsum(row)
            at = int(np.searchsorted(upto, wanted[t]))
            if at == CUT_BINS:
                raise ValueError(f"tree {t} has {upto[-1]} rows to draw from, not {wanted[t]}: do rows share their keys?")
            before[t] = int(upto[at] - row[at])
            first[t], width[t] = first[t] + at * step, step

    def tied(batches, cuts=tuple(first)):
        for batch in batches:
            x, keys = batch.column("_x").to_numpy(), batch.column("_key")
            at, of = [], []
            for t, a, b in numbers:
                draw = _drawn(x, a, b)
                for tree in range(t, len(cuts), trees):
                    at.append(np.flatnonzero(draw == cuts[tree]))
                    of.append(np.full(len(at[-1]), tree, np.int32))
            keys = keys.take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(of)), keys], ["tree", "_key"])

    left = f"get(array({', '.join(str(w - n) for w, n in zip(wanted, before))}), tree)"
    ranked = rows.select("_x", "_key").mapInArrow(tied, "tree int, _key string")
    ranked = ranked.withColumn("_rank", F.row_number().over(W.partitionBy("tree").orderBy("_key")))
    last: list[str | None] = [None] * len(wanted)
    for r in ranked.where(f"_rank = {left}").collect():  # a row for each tree
        last[r["tree"]] = r["_key"]
    return _Members(numbers, trees, first, last)


def _likely_rows(rows: DataFrame, seed: int, trees: int, bound: int) -> DataFrame:
    """The rows with a draw below ``bound`` in some tree."""
    numbers = _multipliers(seed, trees)

    def held(batches):
        for batch in batches:
            x = batch.column("_x").to_numpy()
            kept = np.zeros(len(x), bool)
            for _, a, b in numbers:
                kept |= _drawn(x, a, b) < bound
            yield batch.filter(pa.array(kept))

    return rows.mapInArrow(held, rows.schema)


def _kept_rows(rows: DataFrame, total: int, samples: Sequence[int], trees: int, seed: int) -> tuple[DataFrame, _Members]:
    """The rows written once, and which of them each tree takes.

    Where samples are few of all rows only rows low in some tree's draws are written; should a tree's cut lie
    beyond those, all are.
    """
    bound = max(_likely(s, total) for s in samples)
    if bound <= PRIME:
        few = cut_lineage(_likely_rows(rows, seed, trees, bound))
        try:
            members = _members(few, samples, trees, seed)
        except ValueError:
            members = None  # a tree has too few below the bound
        if members is not None and max(members.cuts) < bound:
            return few, members
    rows = cut_lineage(rows)
    return rows, _members(rows, samples, trees, seed)


def _split_sql(seed: int, width: int, trees: int) -> tuple[str, str]:
    """Split of a node as SQL over lo*, hi*, size and depth.

    The feature is a random one among those that are not constant in the node, -1 if there
    is none or the node may not be split; the threshold is a random value in its range. A
    tree's draws are those of its number within its forest, ``trees`` to a forest.
    """
    own = f"tree % {trees}"
    usable = "array_compact(array(" + ", ".join(f"if(hi{i} > lo{i}, {i}, null)" for i in range(width)) + "))"
    pick = f"cast(floor({uniform_sql(seed, 'feature', own, 'node')} * size({usable})) as int)"
    feature = f"coalesce(if(size > 1 and depth < {{limit}}, get({usable}, {pick}), -1), -1)"
    lows = "array(" + ", ".join(f"lo{i}" for i in range(width)) + ")"
    highs = "array(" + ", ".join(f"hi{i}" for i in range(width)) + ")"
    u = uniform_sql(seed, "threshold", own, "node")
    threshold = f"get({lows}, feature) + {u} * (get({highs}, feature) - get({lows}, feature))"
    return feature, threshold


def _names(width: int) -> list[str]:
    return [f"f{i}" for i in range(width)]


def _value_sql(width: int) -> str:
    return f"get(array({', '.join(_names(width))}), feature)"


def _varied(x: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which features are not constant, for each node. Where the first rows of a node do not tell, all do."""
    found = np.zeros((len(starts), x.shape[1]), bool)
    left = np.flatnonzero(sizes > 1)
    for i in range(1, LOOKED_AT):
        found[left] |= x[rows[starts[left]]] != x[rows[starts[left] + i]]
        left = left[(sizes[left] > i + 1) & ~found[left].all(axis=1)]
        if not len(left):
            return found
    ends = np.cumsum(sizes[left])
    own = x[rows[np.arange(ends[-1]) + np.repeat(starts[left] - ends + sizes[left], sizes[left])]]
    first = ends - sizes[left]
    found[left] = np.maximum.reduceat(own, first) > np.minimum.reduceat(own, first)
    return found


def _subtree(
    tree: int, own: int, root: int, x: np.ndarray, limit: int, seed: int, taken: np.ndarray | None = None
) -> dict[str, np.ndarray]:
    """Nodes below ``root`` for the rows of one group, or those ``taken`` of them, level by level, as columns.

    ``own`` is the tree's number within its forest, which keys its draws. Of a node's features only the one
    that splits it is ranged over its rows; two rows mostly tell that the others are not constant.
    """
    met = []
    depth = (root + 1).bit_length() - 1
    rows = np.arange(len(x)) if taken is None else np.sort(taken)
    names, sizes = np.array([root]), np.array([len(rows)])
    while len(names):
        starts = np.cumsum(sizes) - sizes
        feature, threshold = np.full(len(names), -1), np.full(len(names), np.nan)
        split = np.zeros(len(names), bool)
        if depth < limit:
            varied = _varied(x, rows, starts, sizes)
            usable = varied.sum(axis=1)
            split = usable > 0
        if split.any():
            varied, named = varied[split], names[split]
            pick = (numbered_draws(f"{seed}:feature:{own}:", named) * usable[split]).astype(np.int64)
            feature[split] = (np.cumsum(varied, axis=1) > pick[:, None]).argmax(axis=1)
            rows = rows[np.repeat(split, sizes)]
            size = sizes[split]
            start = np.cumsum(size) - size
            value = x[rows, np.repeat(feature[split], size)]
            low, high = np.minimum.reduceat(value, start), np.maximum.reduceat(value, start)
            threshold[split] = low + numbered_draws(f"{seed}:threshold:{own}:", named) * (high - low)
        met.append((names, np.full(len(names), depth), feature, threshold, sizes))
        if not split.any():
            break
        beyond = value > np.repeat(threshold[split], size)
        right = np.add.reduceat(beyond, start, dtype=np.int64)
        left = size - right
        # The rows of a node go on to its two children in order; those of all nodes keep theirs.
        parted = np.empty_like(rows)
        at = np.flatnonzero(~beyond)
        parted[np.arange(len(at)) + np.repeat(np.cumsum(right) - right, left)] = rows[at]
        at = np.flatnonzero(beyond)
        parted[np.arange(len(at)) + np.repeat(np.cumsum(left), right)] = rows[at]
        rows, depth = parted, depth + 1
        names = np.stack([named * 2 + 1, named * 2 + 2], axis=1).ravel()
        sizes = np.stack([left, right], axis=1).ravel()
        names, sizes = names[sizes > 0], sizes[sizes > 0]
    columns = [np.concatenate(c) for c in zip(*met)]
    return {"tree": np.full(len(columns[0]), tree), **dict(zip(("node", "depth", "feature", "threshold", "size"), columns))}


def _node_batches(columns: dict[str, np.ndarray]):
    """Nodes as batches of bounded size."""
    for i in range(0, len(columns["node"]), NODES_A_BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(columns[c][i : i + NODES_A_BATCH].astype(t)) for c, t in NODE_TYPES.items()], list(NODE_TYPES))


def _grow(rows: DataFrame, width: int, limits: Sequence[int], trees: int, seed: int) -> DataFrame:
    """Finish all subtrees whose rows share ``(tree, root)``. Returns their nodes.

    A group holds at most a tree's sample, or a node already small, so it fits a task; the
    groups are what Spark spreads.
    """
    cols, limits = _names(width), list(limits)

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree, root = int(key[0]), int(key[1])
        return pd.DataFrame(_subtree(tree, tree % trees, root, group[cols].to_numpy(dtype=np.float64), limits[tree // trees], seed))

    return _finished(rows.select("tree", "root", *cols).groupBy("tree", "root").applyInPandas(grow, GROWN))


def _finished(grown: DataFrame) -> DataFrame:
    return grown.select(
        "tree", "node", "depth", "feature",
        F.when(F.col("feature") >= 0, F.col("threshold")).alias("threshold"),
        "size", (F.col("feature") < 0).alias("is_leaf"),
    )


class _Upper:
    """The nodes of one tree so far; a row ends in a leaf, in a small node or beyond them."""

    def __init__(self, node: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> None:
        self.node, self.feature = node, np.maximum(feature, 0).astype(np.intp)
        self.threshold = np.where(feature >= 0, threshold, np.inf)
        self.inner = feature >= 0
        own = np.arange(len(node))
        child = []  # a child that is not here is the node itself: the row stays
        for side in (1, 2):
            at = np.minimum(np.searchsorted(node, node * 2 + side), max(0, len(node) - 1))
            here = self.inner & (node[at] == node * 2 + side)
            child.append(np.where(here, at, own))
        self.child = np.stack(child, axis=1).ravel()  # the two children of a node side by side

    def walk(self, x: np.ndarray, at: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where the rows end, from places ``at``, and the nodes they go on to: -1 where they rest."""
        first, x = np.arange(len(x)) * x.shape[1], x.ravel()
        for _ in range(steps):
            beyond = x.take(first + self.feature.take(at)) > self.threshold.take(at)
            new = self.child.take(2 * at + beyond)
            if (new == at).all():
                break
            at = new
        beyond = x.take(first + self.feature.take(at)) > self.threshold.take(at)
        return at, np.where(self.inner[at], self.node[at] * 2 + 1 + beyond, -1)


def _uppers(nodes: pd.DataFrame, trees: int) -> list[_Upper | None]:
    """A tree's nodes so far, for each tree; nodes left to their groups end a walk like leaves."""
    out: list[_Upper | None] = [None] * trees
    for tree, own in nodes.sort_values(["tree", "node"]).groupby("tree"):
        feature = np.where(own["small"], -1, own["feature"]).astype(np.int64)
        out[int(tree)] = _Upper(own["node"].to_numpy(), feature, own["threshold"].to_numpy(dtype=np.float64, na_value=np.inf))
    return out


def _matrix(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in cols])


def _open_nodes(rows: DataFrame, members: _Members, uppers, cols: Sequence[str], steps: int) -> DataFrame:
    """Counts and ranges, by task, of the nodes that the rows go on to: mergeable, not yet merged."""
    low, high = [f"lo{i}" for i in range(len(cols))], [f"hi{i}" for i in range(len(cols))]
    schema = "tree int, node long, size long, " + ", ".join(f"{c} double" for c in low + high)

    def counted(batches):
        model = uppers.value
        for batch in batches:
            x = _matrix(batch, cols)
            found = []
            for tree, at in members.of(batch):
                if model[tree] is None:
                    node = np.zeros(len(at), np.int64)
                else:
                    node = model[tree].walk(x[at], np.zeros(len(at), np.intp), steps)[1]
                    at, node = at[node >= 0], node[node >= 0]
                if not len(at):
                    continue
                order = np.argsort(node, kind="stable")
                names, start, size = np.unique(node[order], return_index=True, return_counts=True)
                own = x[at[order]]
                found.append((np.full(len(names), tree), names, size, np.minimum.reduceat(own, start), np.maximum.reduceat(own, start)))
            if found:
                tree, node, size, lows, highs = (np.concatenate(c) for c in zip(*found))
                columns = [pa.array(tree.astype(np.int32)), pa.array(node), pa.array(size), *map(pa.array, lows.T), *map(pa.array, highs.T)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "size", *low, *high])

    return rows.mapInArrow(counted, schema)


def _small_rows(rows: DataFrame, members: _Members, uppers, cols: Sequence[str], small: dict, steps: int) -> DataFrame:
    """The rows of the small nodes, as ``_grow`` takes them."""

    def emitted(batches):
        model = uppers.value
        for batch in batches:
            x = _matrix(batch, cols)
            for tree, at in members.of(batch):  # a batch each: no more than the rows read, however many trees
                end = model[tree].walk(x[at], np.zeros(len(at), np.intp), steps)[0]
                node = model[tree].node[end]
                held = np.isin(node, small.get(tree, []))
                at, node = at[held], node[held]
                columns = [pa.array(np.full(len(at), tree, np.int32)), pa.array(node), *map(pa.array, x[at].T)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "root", *cols])

    return rows.mapInArrow(emitted, "tree int, root long, " + ", ".join(f"{c} double" for c in cols))


def _grow_large(
    rows: DataFrame, members: _Members, width: int, limits: Sequence[int], trees: int, seed: int, group_rows: int
) -> DataFrame:
    """Level by level for nodes above ``group_rows`` rows, then the rest as groups.

    The nodes so far, at most some two for every ``group_rows`` rows of all samples, are sent to the tasks.
    """
    limit, levels, count = _by_group(limits, trees), max(limits), trees * len(limits)
    cols, sc = _names(width), rows.sparkSession.sparkContext
    feature, threshold = _split_sql(seed, width, trees)
    finished, known, small_rows = [], pd.DataFrame(), 0
    for level in range(levels + 1):
        uppers = sc.broadcast(_uppers(known, count) if len(known) else [None] * count)
        stats = (
            _open_nodes(rows, members, uppers, cols, level)
            .groupBy("tree", "node")
            .agg(
                F.sum("size").alias("size"),
                *[F.min(f"lo{i}").alias(f"lo{i}") for i in range(width)],
                *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(width)],
            )
            .withColumn("depth", F.lit(level))
        )
        stats = stats.withColumn("feature", F.expr(feature.format(limit=limit))).withColumn(
            "threshold", F.when(F.col("feature") >= 0, F.expr(threshold))
        )
        # A small node is left for its group, split or not; a large one is decided here.
        picked = cut_lineage(
            stats.select(
                "tree", "node", "depth", "feature", "threshold", "size",
                (F.col("feature") < 0).alias("is_leaf"),
                (F.col("size") <= group_rows).alias("small"),
            )
        )
        uppers.destroy()
        new = picked.select("tree", "node", "feature", "threshold", "size", "small").toPandas()
        if not len(new):
            break
        if len(known) + len(new) > UPPER_NODES:
            raise ValueError(f"more than {UPPER_NODES} nodes above {group_rows} rows: let a task take larger nodes")
        known = pd.concat([known, new], ignore_index=True)
        small_rows += int(new.loc[new["small"], "size"].sum())
        finished.append(picked.where(~F.col("small")).select(*NODE_COLUMNS))
        if not (~new["small"] & (new["feature"] >= 0)).any():
            break
    small = {int(t): own["node"].to_numpy() for t, own in known[known["small"]].groupby("tree")}
    held = _small_rows(rows, members, sc.broadcast(_uppers(known, count)), cols, small, levels + 1)
    finished.append(_grow(held.repartition(_tasks(small_rows, rows), "tree", "root"), width, limits, trees, seed))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Row keys that occur more than once, with their counts. Such rows share their draws."""
    return df.groupBy(*key).count().where("count > 1")


def check_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Raise if ``key`` does not name single rows, else return ``df``."""
    seen = repeated_keys(df, key).agg(F.count(F.lit(1)).alias("keys"), F.sum("count").alias("rows")).first()
    if seen["keys"]:
        raise ValueError(f"{seen['keys']} values of the key {list(key)} stand for {seen['rows']} rows")
    return df


def _check_roots(nodes: DataFrame, samples: Sequence[int], trees: int) -> None:
    """Every tree must have been grown on exactly its sample."""
    size = F.expr(_by_group(samples, trees))
    short = nodes.where((F.col("node") == 0) & (F.col("size") != size)).count()
    grown = nodes.where(F.col("node") == 0).count()
    if short or grown != trees * len(samples):
        raise ValueError(f"{short + trees * len(samples) - grown} trees lack rows: do rows share their keys?")


def fit_forests(
    df: DataFrame,
    columns: Sequence[str],
    key: Sequence[str | Column],
    n_estimators: int,
    sizes: Sequence[str | int | float],
    seed: int = DEFAULT_SEED,
    scaler: Scaler | None = None,
    group_rows: int | None = None,
) -> list[Forest]:
    """One forest per sample size, grown together in the same jobs.

    Samples go whole to tasks up to ``group_rows`` rows; without it up to ``GROUP_ROWS`` rows, or where all rows have
    ``BUNDLE_VALUES`` numbers at most.
    """
    scaler = scaler or fit_scaler(df, columns)
    total = scaler.rows
    samples = [sample_size(m, total) for m in sizes]
    limits = [math.ceil(math.log2(max(s, 2))) for s in samples]
    width = len(columns)
    rows = df.select(
        key_text(*key).alias("_key"), *[scaler.expr(c).alias(f"f{i}") for i, c in enumerate(columns)]
    )
    rows = _with_digest(spread(rows), seed)
    if max(samples) <= (group_rows or GROUP_ROWS) or (group_rows is None and total * width <= BUNDLE_VALUES):
        nodes = _grow_samples(rows, total, width, samples, limits, n_estimators, seed)
    else:
        rows, members = _kept_rows(rows, total, samples, n_estimators, seed)
        nodes = _grow_large(rows, members, width, limits, n_estimators, seed, group_rows or GROUP_ROWS)
    nodes = cut_lineage(nodes)
    _check_roots(nodes, samples, n_estimators)
    out = []
    for g, (sample, depth) in enumerate(zip(samples, limits)):
        own = nodes.where((F.col("tree") >= g * n_estimators) & (F.col("tree") < (g + 1) * n_estimators))
        own = own.withColumn("tree", F.col("tree") - g * n_estimators) if g else own
        out.append(Forest(own, scaler, n_estimators, sample, depth, seed))
    return out


def fit_forest(
    df: DataFrame,
    columns: Sequence[str],
    key: Sequence[str | Column],
    n_estimators: int = DEFAULT_TREES,
    max_samples: str | int | float = "auto",
    seed: int = DEFAULT_SEED,
    scaler: Scaler | None = None,
    group_rows: int | None = None,
) -> Forest:
    """Fit on the rows of ``df``. ``key`` names a row; rows that share it share their draws.

    The scaler is fitted on the same rows unless one is given.
    """
    return fit_forests(df, columns, key, n_estimators, [max_samples], seed, scaler, group_rows)[0]


def node_paths(forest: Forest) -> DataFrame:
    """Path length each leaf stands for."""
    return forest.nodes.withColumn(
        "path", F.when(F.col("is_leaf"), F.col("depth") + average_path(F.col("size")))
    )


def _score_of(mean_path: Column, sample: int) -> Column:
    norm = average_path_number(sample)
    # Rounded, so that rows with the same paths tie in whatever order those were added.
    return F.lit(0.5) if norm == 0 else F.pow(F.lit(2.0), -F.round(mean_path, PATH_PLACES) / F.lit(norm))


def _packed(forest: Forest) -> dict[str, np.ndarray]:
    """Flat arrays of a forest whose size was checked; the two children lie side by side."""
    t = (
        node_paths(forest)
        .select("tree", "node", "feature", "threshold", F.coalesce("path", F.lit(0.0)).alias("path"))
        .toPandas()
    )
    order = np.lexsort((t["node"].to_numpy(), t["tree"].to_numpy()))
    tree, node = t["tree"].to_numpy()[order], t["node"].to_numpy()[order]
    feature = t["feature"].to_numpy()[order].astype(np.int32)
    threshold = t["threshold"].to_numpy(dtype=np.float64, na_value=np.inf)[order]
    threshold[feature < 0] = np.inf
    starts = np.searchsorted(tree, np.arange(forest.trees))
    left = np.arange(len(tree), dtype=np.int64)
    for t0, t1 in zip(starts, np.append(starts[1:], len(tree))):
        inner = feature[t0:t1] >= 0
        left[t0:t1][inner] = t0 + np.searchsorted(node[t0:t1], node[t0:t1][inner] * 2 + 1)
    return {
        "root": starts.astype(np.intp),
        "feature": np.maximum(feature, 0).astype(np.intp),
        "threshold": threshold,
        "left": left.astype(np.intp),
        "path": t["path"].to_numpy(dtype=np.float64)[order],
    }


def prefix_scores(forest: Forest, prefixes: Sequence[int]) -> Column:
    """Scores by the first k trees for each k in ``prefixes``, as an array, in one walk.

    Needs a forest of checked size.
    """
    spark = forest.nodes.sparkSession
    held = forest.nodes.count()
    if held > BROADCAST_NODES:
        raise ValueError(f"{held} nodes are too many to send to every task; use scores_in_parts")
    if sorted(prefixes) != list(prefixes) or not 0 < prefixes[0] <= prefixes[-1] <= forest.trees:
        raise ValueError("prefixes rise and end within the forest")
    model = spark.sparkContext.broadcast(_packed(forest))
    steps, norm = forest.depth, average_path_number(forest.sample)
    marks = list(prefixes)

    @F.pandas_udf("array<double>")
    def walk(*columns: pd.Series) -> pd.Series:
        m = model.value
        x = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
        first = np.arange(len(x)) * x.shape[1]
        x = x.ravel()
        total = np.zeros(len(first))
        out = np.full((len(first), len(marks)), 0.5)
        # Tree by tree, so that the arrays of one tree stay in the processor's cache.
        for t, root in enumerate(m["root"][: marks[-1]], start=1):
            at = np.full(len(first), root)
            for _ in range(steps):
                beyond = x.take(first + m["feature"].take(at)) > m["threshold"].take(at)
                at = m["left"].take(at) + beyond
            total += m["path"].take(at)
            if norm and t in marks:
                out[:, marks.index(t)] = np.power(2.0, -np.round(total / t, PATH_PLACES) / norm)
        return pd.Series(list(out))

    return walk(*[forest.scaler.expr(c) for c in forest.scaler.columns])


def _part_starts(forest: Forest, limit: int) -> list[tuple[int, int]]:
    """First (tree, node) of parts of the node table, in order, of at most ``limit`` nodes each.

    Several trees may share a part, and a tree may go over several: a node's number is above its
    parent's, so a row only ever goes on to a later part. A level too large for one part is cut
    at numbers.
    """
    levels = forest.nodes.groupBy("tree", "depth").count().orderBy("tree", "depth").collect()  # trees x depths
    starts, held = [], limit + 1
    for r in levels:
        first, width = 2 ** r["depth"] - 1, 2 ** r["depth"]
        step = width if r["count"] <= limit else limit
        for lo in range(first, first + width, step):
            most = min(r["count"], step)
            if held + most > limit:
                starts.append((r["tree"], lo))
                held = 0
            held += most
    return starts


def _part(nodes: DataFrame, start: tuple[int, int], end: tuple[int, int] | None) -> DataFrame:
    tree, node = F.col("tree"), F.col("node")
    held = (tree > start[0]) | ((tree == start[0]) & (node >= start[1]))
    if end is not None:
        held &= (tree < end[0]) | ((tree == end[0]) & (node < end[1]))
    return nodes.where(held)


def _walk_parts(parts: list, forest: Forest, marks: list[int], first: bool, last: bool):
    """Takes rows on over parts of the node table: sums of paths, nodes come to, scores at the marks.

    The first pass takes no ``walk`` of an earlier one, the last gives the scores alone.
    """
    norm, steps = average_path_number(forest.sample), forest.depth

    def go_on(x: np.ndarray, total: np.ndarray, at: np.ndarray, scores: np.ndarray) -> None:
        for start, end, model in parts:
            for tree, upper, path in model.value:
                if (tree, 0) >= start:
                    at[:] = 0
                place = np.minimum(np.searchsorted(upper.node, at), len(upper.node) - 1)
                here = np.flatnonzero(upper.node[place] == at)
                place, goes_on = upper.walk(x[here], place[here], steps)
                total[here] += np.where(goes_on < 0, path[place], 0.0)
                at[here] = goes_on
                if tree + 1 in marks and (end is None or end[0] > tree):
                    mean = np.round(total / (tree + 1), PATH_PLACES)
                    scores[:, marks.index(tree + 1)] = np.power(2.0, -mean / norm) if norm else 0.5

    def begin(walk: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return walk["total"].to_numpy().copy(), walk["at"].to_numpy().copy(), np.stack([np.asarray(v, dtype=np.float64) for v in walk["scores"]])

    def passed(columns: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.column_stack([c.to_numpy(dtype=np.float64) for c in (columns if first else columns[1:])])
        none = np.zeros(len(x)), np.zeros(len(x), np.int64), np.full((len(x), len(marks)), np.nan)
        held = none if first else begin(columns[0])
        go_on(x, *held)
        return held

    @F.pandas_udf("array<double>")
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(passed(columns)[2]))

    @F.pandas_udf("struct<total:double,at:bigint,scores:array<double>>")
    def carried(*columns: pd.Series) -> pd.DataFrame:
        total, at, scores = passed(columns)
        return pd.DataFrame({"total": total, "at": at, "scores": list(scores)})

    return scored if last else carried


def scores_in_parts(df: DataFrame, forest: Forest, prefixes: Sequence[int], name: str, limit: int | None = None) -> DataFrame:
    """Scores by the first k trees for each k in ``prefixes``, as an array column, for a forest of any size.

    The node table goes to the tasks in parts of at most ``limit`` nodes, one after the other through the
    driver, and the rows pass over ``PARTS_A_PASS`` of them at a time. Between passes each row carries the
    sum of its path lengths so far and, in a tree that goes on in the next part, the node it has
    come to; the rows are then written with the columns of ``df``, so select those needed.
    """
    if sorted(prefixes) != list(prefixes) or not 0 < prefixes[0] <= prefixes[-1] <= forest.trees:
        raise ValueError("prefixes rise and end within the forest")
    starts = _part_starts(forest, limit or BROADCAST_NODES)
    nodes = node_paths(forest).select(
        "tree", "node", "feature", "threshold", F.coalesce("path", F.lit(0.0)).alias("path")
    )
    inputs = [forest.scaler.expr(c) for c in forest.scaler.columns]
    bounds = list(zip(starts, [*starts[1:], None]))
    held = df
    for i in range(0, len(bounds), PARTS_A_PASS):
        parts = [(start, end, df.sparkSession.sparkContext.broadcast(_part_trees(nodes, start, end))) for start, end in bounds[i : i + PARTS_A_PASS]]
        first, last = i == 0, i + PARTS_A_PASS >= len(bounds)
        walk = _walk_parts(parts, forest, list(prefixes), first, last)
        if last:
            return held.withColumn("_walk", walk(*([] if first else ["_walk"]), *inputs)).withColumnRenamed("_walk", name)
        held = cut_lineage(held.withColumn("_walk", walk(*([] if first else ["_walk"]), *inputs)))
        for _, _, model in parts:
            model.destroy()  # the rows are written
    raise ValueError("a forest without nodes")


def _part_trees(nodes: DataFrame, start: tuple[int, int], end: tuple[int, int] | None) -> list:
    """The trees of one part, each with its nodes and what paths they stand for."""
    t = _part(nodes, start, end).toPandas().sort_values(["tree", "node"])
    trees = []
    for tree, own in t.groupby("tree"):
        threshold = own["threshold"].to_numpy(dtype=np.float64, na_value=np.inf)
        upper = _Upper(own["node"].to_numpy(), own["feature"].to_numpy().astype(np.int64), threshold)
        trees.append((int(tree), upper, own["path"].to_numpy(dtype=np.float64)))
    return trees


def fits_one_walk(forest: Forest) -> bool:
    """Whether the whole node table may be sent to every task."""
    return forest.nodes.count() <= BROADCAST_NODES


def score_column(forest: Forest) -> Column:
    """Anomaly score in (0, 1] as a column, higher is stranger. Needs a forest of checked size."""
    return prefix_scores(forest, [forest.trees])[0]


def score(df: DataFrame, forest: Forest, name: str = "anomaly_score") -> DataFrame:
    """Add the score to every row: in one walk, or in parts when the forest is too large for one.

    A stream is scored batch by batch in the second case, see ``streaming.windows.write_alerts``.
    """
    if fits_one_walk(forest):
        return spread(df).withColumn(name, score_column(forest))
    if df.isStreaming:
        raise ValueError("a forest of this size goes over a stream batch by batch: use write_alerts")
    return scores_in_parts(spread(df), forest, [forest.trees], name).withColumn(name, F.col(name)[0])


def score_by_joins(df: DataFrame, forest: Forest, key: Sequence[str], name: str = "anomaly_score") -> DataFrame:
    """The same scores by one join per level. ``key`` must be unique. Exact on any forest size."""
    width = len(forest.scaler.columns)
    cols = _names(width)
    beyond = (F.expr(_value_sql(width)) > F.col("threshold")).cast("long")
    at = df.select(
        *key, *[forest.scaler.expr(c).alias(f"f{i}") for i, c in enumerate(forest.scaler.columns)]
    ).withColumns(
        {"tree": F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))), "node": F.lit(0).cast("long"),
         "path": F.lit(None).cast("double")}
    )
    nodes = node_paths(forest).select("tree", "node", "feature", "threshold", F.col("path").alias("leaf_path"))
    for level in range(forest.depth + 1):
        here = nodes.where((F.col("node") >= 2**level - 1) & (F.col("node") < 2 ** (level + 1) - 1))
        # Near the root all rows meet few nodes; those go to the rows. Deeper, rows spread out.
        if forest.trees * 2**level <= BROADCAST_NODES // 4:
            here = F.broadcast(here)
        at = at.join(here, ["tree", "node"], "left").select(
            *key,
            *cols,
            "tree",
            F.when(F.col("feature") >= 0, F.col("node") * 2 + 1 + beyond).otherwise(F.col("node")).alias("node"),
            F.coalesce("path", "leaf_path").alias("path"),
        )
    return at.groupBy(*key).agg(_score_of(F.sum("path") / F.lit(forest.trees), forest.sample).alias(name))


def fit_cut(forest: Forest, train: DataFrame, contamination: float, approximate: bool = False) -> Forest:
    """Set the cut at the score quantile of the training rows."""
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination lies in (0, 0.5]")
    scored = score(train.select(*forest.scaler.columns), forest, "s").select("s")
    return replace(forest, cut=score_cut(scored, "s", contamination, approximate))


def score_cut(scored: DataFrame, name: str, contamination: float, approximate: bool = False) -> float:
    """Score above which a row is flagged; ``approximate`` is one pass, off by 0.1 % of the rows at most."""
    if approximate:
        return sketched_quantile(scored, name, 1 - contamination)
    # The search reads the scores several times; each is one double per row.
    return exact_percentile(cut_lineage(scored.select(name)), name, 1 - contamination)


def score_and_flag(df: DataFrame, forest: Forest) -> DataFrame:
    """Scored rows with ``is_anomaly`` 0 / 1, flagged strictly above the cut."""
    if forest.cut is None:
        raise ValueError("take the cut first")
    return score(df, forest).withColumn(
        "is_anomaly", (F.col("anomaly_score") > F.lit(forest.cut)).cast("int")
    )


def score_cut_and_flag(
    df: DataFrame, forest: Forest, contamination: float, fitted: Column | None = None, keep: Sequence[str] | None = None
) -> tuple[Forest, DataFrame]:
    """Score once, cut at the quantile over the fitted rows of ``df``, flag all of it.

    For data that holds its own training rows: those are the rows where ``fitted`` holds, or
    all. The scored rows are written with the columns ``keep``, or all; ``fitted`` reads those.
    """
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination lies in (0, 0.5]")
    scored = score(df, forest)
    scored = cut_lineage(scored if keep is None else scored.select(*keep, "anomaly_score"))
    cut = exact_percentile(scored if fitted is None else scored.where(fitted), "anomaly_score", 1 - contamination)
    flagged = scored.withColumn("is_anomaly", (F.col("anomaly_score") > F.lit(cut)).cast("int"))
    return replace(forest, cut=cut), flagged
