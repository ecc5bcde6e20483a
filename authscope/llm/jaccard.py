"""Near duplicates: an LSH forest of minimum hashes finds candidates, exact similarity decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.llm.components import connected_components
from authscope.llm.text import mix, shingle_hashes, slices, word_hashes
from authscope.session import cut_lineage

TREES = 24
DEPTH = 6
#: A block of a component has about this many shingles and sets; blocks are compared in pairs.
BLOCK_SHINGLES = 1 << 18
BLOCK_SETS = 512


def found_chance(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """Chance that two sets of this similarity share a prefix of ``depth`` labels in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float, target: float, trees: int, depth: int) -> int:
    """Length below which prefixes need not be shortened: a link at the threshold, the hardest
    one to find, is found there with the target chance."""
    while depth > 1 and found_chance(threshold, depth, trees) < target:
        depth -= 1
    return depth


class _Forest:
    """Labels of the trees: for each one ``depth`` minimum hashes, 16 bits each."""

    def __init__(self, trees: int, depth: int) -> None:
        random = np.random.default_rng(77)
        n = trees * depth
        self.times = random.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.plus = random.integers(0, 1 << 32, n, dtype=np.uint32)

    def labels(self, shingles: np.ndarray) -> bytes:
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.times), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(h), 2048):
            least = np.minimum(least, (h[i : i + 2048, None] * self.times + self.plus).min(axis=0))
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()


def set_id(shingles: np.ndarray) -> int:
    """64-bit hash of a set of shingles."""
    total = mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(shingles))]))[0].astype(np.int64))


def _sets(batches, k: int):
    """Key and shingle set of every text."""
    for piece in slices(batches):
        words, first = word_hashes(piece.column("text"))
        for i, key in enumerate(piece.column("key").to_pylist()):
            yield key, np.unique(shingle_hashes(words[first[i] : first[i + 1]], k))


def _signatures(batches, k: int, trees: int, depth: int, kind: pa.DataType):
    forest, types = _Forest(trees, depth), (kind, pa.string(), pa.int64(), pa.int32(), pa.binary())
    for piece in slices(batches):
        rows = [
            (key, of, set_id(s), len(s), forest.labels(s) if len(s) else None)
            for of, (key, s) in zip(piece.column("of").to_pylist(), _sets([piece], k))
        ]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "of", "sid", "n", "labels"])


def _payload(batches, k: int):
    """Shingles of the texts asked for; a text whose set is another one is left out."""
    for piece in slices(batches):
        at = {n: piece.column(n).to_pylist() for n in ("sid", "component", "copies", "blocks")}
        rows = [(i, s) for i, (_, s) in enumerate(_sets([piece], k)) if set_id(s) == at["sid"][i]]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([at[n][i] for i, _ in rows], pa.int64()) for n in at), pa.array([s.tobytes() for _, s in rows], pa.binary())],
                [*at, "shingles"],
            )


def _named(batches, k: int):
    """Texts with the ids of their sets; those without a shingle are left out."""
    for piece in slices(batches):
        ids = [set_id(s) if len(s) else None for _, s in _sets([piece], k)]
        some = [i for i, n in enumerate(ids) if n is not None]
        if some:
            texts = piece.column("text").take(pa.array(some))
            yield pa.RecordBatch.from_arrays([texts, pa.array([ids[i] for i in some], pa.int64())], ["text", "of"])


def _intersections(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the first ``split`` sets with the rest (with all, if 0)."""
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts > 1  # a shingle of one set alone meets no other one
    number = np.cumsum(shared) - 1
    rows, columns = rows[shared[columns]], number[columns[shared[columns]]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    n = len(sets)
    out = np.zeros((split or n, n - split), np.float32)
    width = max(64, min(4096, (1 << 23) // n))
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(columns, (lo, lo + width))
        part = np.zeros((n, width), np.float32)
        part[rows[a:b], columns[a:b] - lo] = 1
        out += part[: split or n] @ part[split:].T
    return out


def _links(group: pa.Table, threshold: float, trees: int, depth: int) -> pa.Table:
    """Exact similarities within a block, or between two blocks, of a component.

    Gives for each set with links the number of texts at its other ends, the least set that it
    is connected with here, the number of its links and, for each length of prefix from 1 to
    ``depth``, how many links stand behind these (each counts once over its chance of being found
    at that length), and how many of those behind the ones found by whole labels that length would
    reach. Pairs are not listed.
    """
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    group = group.sort_by([("block", "ascending"), ("sid", "ascending")])
    sid, copies, block = (group.column(c).to_numpy() for c in ("sid", "copies", "block"))
    first = np.concatenate([[True], sid[1:] != sid[:-1]])  # a set asked for through one key that occurs twice
    sid, copies, block = sid[first], copies[first], block[first]
    sets = [np.frombuffer(b.as_py(), np.uint64) for b, f in zip(group.column("shingles"), first) if f]
    split = int(np.searchsorted(block, j)) if i != j else 0
    n, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    links, root = np.zeros(n, np.int64), np.arange(n)
    pairs, behind, reached = np.zeros(n, np.int64), np.zeros((n, depth)), np.zeros((n, depth))
    if n > max(1, split) and (i == j or split):
        common = _intersections(sets, split).astype(np.float64)
        union = sizes[: split or n, None] + sizes[None, split:] - common
        near = common >= threshold * union - 1e-9
        if i == j:
            np.fill_diagonal(near, False)
            links = near @ copies
        else:
            links = np.concatenate([near @ copies[split:], copies[:split] @ near])
        u, v = np.nonzero(near)
        alike = np.minimum(1.0, common[u, v] / union[u, v])
        chance = [found_chance(alike, d + 1, trees) for d in range(depth)]
        for ends in (u,) if i == j else (u, v + split):
            pairs += np.bincount(ends, minlength=n)
            for d in range(depth):
                behind[:, d] += np.bincount(ends, 1 / chance[d], n)
                reached[:, d] += np.bincount(ends, chance[d] / chance[-1], n)
        while True:  # every set takes the least number among its neighbours'
            new = root.copy()
            top, low = root[: split or n], root[split:]
            new[: split or n] = np.minimum(top, np.where(near, low[None, :], n).min(axis=1))
            new[split:] = np.minimum(new[split:], np.where(near, new[: split or n, None], n).min(axis=0))
            new = new[new]
            if (new == root).all():
                break
            root = new
    some = links > 0
    component = pa.array(np.full(int(some.sum()), group.column("component")[0].as_py()), pa.int64())
    return pa.table(
        {
            "component": component,
            "sid": sid[some],
            "links": links[some],
            "other": sid[root[some]],
            "pairs": pairs[some],
            "behind": pa.array(list(behind[some]), pa.list_(pa.float64())),
            "reached": pa.array(list(reached[some]), pa.list_(pa.float64())),
        }
    )


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    target: float = 0.99999,
    trees: int = TREES,
    depth: int = DEPTH,
    report: list | None = None,
) -> DataFrame:
    """Classes of near duplicates: a row (key, class_id, n_links) for each row of ``docs``.

    Two texts are linked if the sets of their ``k``-word shingles have a Jaccard similarity of
    ``threshold`` or more; a text of fewer words has one shingle. A class is a connected
    component of the links, named by its least key; ``n_links`` counts the other rows linked
    to this one, copies included. Texts with equal sets are one set with a number of copies.

    Every set has a label of ``depth`` minimum hashes in each of the trees, and sets whose labels
    share a prefix meet in a node of the tree's trie. The search starts from whole labels. After
    the links there are verified, their similarities tell how many links there should be: a link
    of similarity s is found with chance 1 - (1 - s**d) ** trees at prefixes of length d, so each
    one found stands for one over that chance. While the share found is below ``target``, the prefixes
    are shortened: first to the longest at which those links would be found with it, then one by one.
    At the latest they end where even a link at the threshold is found with that chance, and there at
    once if nothing is found that tells. Tables of copies that are nearly
    equal so keep long prefixes and few candidates. ``report``, if given, gets a (depth, links, recall) for
    each length tried.

    Nodes hand on only an edge to their least set. The components of these edges are compared
    exactly, all pairs of a component that is new at this length: it is
    dealt into blocks of bounded size by a hash, each pair of blocks is a task of its own, and
    what it gives is a row for each set, never a list of pairs.

    A null or empty text, or one without a word, has no shingles: its class is its own key,
    without links. Repeated rows are copies of each other. Rows with equal keys are taken one
    by one. A null key stays null and names a class only if the class has no other key. No rows
    give no rows. Texts of any length count whole. Only the key and the text are read from ``docs``.
    """
    classes = _classes(docs, key, text, k, threshold, target, trees, depth, report)
    return classes.select(F.col("key").alias(key), "class_id", "n_links")


def _nodes(sets: DataFrame, d: int, trees: int, depth: int) -> DataFrame:
    """Edges from each set to the least set that has the same first ``d`` labels in a tree."""
    nodes = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.xxhash64(t, F.substring("labels", t * (2 * depth) + 1, F.lit(2 * d))),
    )
    entries = sets.select("sid", F.explode(nodes).alias("node"))
    shared = entries.groupBy("node").agg(F.count("*").alias("size"), F.min("sid").alias("head")).where("size > 1")
    shared = cut_lineage(shared)  # apart from the join, which can then part the sets of a large node
    # By shuffle at any size: what it is joined with grows with the input.
    met = entries.join(shared.hint("merge"), "node").where("sid <> head")
    return met.select(F.col("sid").alias("u"), F.col("head").alias("v"))


def _verified(rows: DataFrame, asked: DataFrame, k: int, threshold: float, trees: int, depth: int) -> DataFrame:
    """Links of the sets asked for, see ``_links``."""
    kind = rows.schema["key"].dataType.simpleString()
    wanted = ["text", "sid", "component", "copies", "blocks"]
    # A set without a key is found by its id; one text of it is enough.
    keyless = rows.where(F.col("key").isNull()).select("key", "text").mapInArrow(lambda b: _named(b, k), "text string, of long")
    keyless = keyless.dropDuplicates(["of"]).join(asked.where(F.col("least").isNull()).hint("merge"), F.col("of") == F.col("sid"))
    keyless = keyless.select(F.lit(None).cast(kind).alias("key"), *wanted)
    payload = (
        rows.join(asked.hint("merge"), rows["key"] == asked["least"])
        .select("key", *wanted)
        .union(keyless)
        .mapInArrow(lambda b: _payload(b, k), "sid long, component long, copies long, blocks long, shingles binary")
        .withColumn("block", F.expr("pmod(xxhash64(sid, 1), blocks)"))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "copies", "shingles")
    )
    return payload.groupBy("component", "i", "j").applyInArrow(
        lambda g: _links(g, threshold, trees, depth),
        "component long, sid long, links long, other long, pairs long, behind array<double>, reached array<double>",
    )


def _search(
    rows: DataFrame, sets: DataFrame, k: int, threshold: float, target: float, trees: int, depth: int, report: list | None
) -> DataFrame:
    """Links of all sets, from whole labels down to prefixes short enough for the target."""
    found = known = None
    d, least = depth, least_depth(threshold, target, trees, depth)
    while True:
        members = connected_components(_nodes(sets, d, trees, depth)).select(F.col("node").alias("sid"), "component")
        members = cut_lineage(members.join(sets.drop("labels"), "sid"))
        extent = cut_lineage(
            members.groupBy("component").agg(
                F.count("*").alias("members"),
                F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("long").alias("blocks"),
            )
        )
        # Shorter prefixes only merge components, so one of the same name and size is the same.
        new = extent if known is None else extent.join(known, ["component", "members"], "left_anti")
        asked = cut_lineage(members.join(new, "component").select("sid", "component", "copies", "least", "blocks"))
        more = cut_lineage(_verified(rows, asked, k, threshold, trees, depth))
        if found is None:
            found = more
        else:
            same = extent.join(known.select("component", "members"), ["component", "members"], "left_semi")
            found = found.join(same.select("component"), "component", "left_semi").unionByName(more)
        known = extent.select("component", "members")
        sums = [F.sum(F.element_at(c, e + 1)).alias(f"{c}{e + 1}") for c in ("behind", "reached") for e in range(depth)]
        told = found.agg(F.sum("pairs").alias("pairs"), *sums).first()
        recall = told["pairs"] / told[f"behind{d}"] if told["pairs"] else 0.0
        if report is not None:
            report.append((d, (told["pairs"] or 0) // 2, recall))
        if recall >= target or d == least:
            return found
        # The links found by whole labels tell how far prefixes must be shortened; later ones one by one.
        enough = [e for e in range(least, d) if told["pairs"] and told[f"reached{e}"] >= target * told[f"behind{depth}"]]
        d = max(enough, default=least) if d == depth else d - 1


def _classes(
    docs: DataFrame, key: str, text: str, k: int, threshold: float, target: float, trees: int, depth: int, report: list | None = None
) -> DataFrame:
    """A row for each row of ``docs``: (key, of, class_id, n_links), ``of`` the text's md5 digest."""
    kind = docs.schema[key].dataType.simpleString()
    alias = pa.type_for_alias({"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8"}[kind])
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.md5(F.coalesce(text, F.lit(""))).alias("of"))
    signed = cut_lineage(
        rows.mapInArrow(lambda b: _signatures(b, k, trees, depth, alias), f"key {kind}, of string, sid long, n int, labels binary")
    )
    sets = cut_lineage(
        signed.where("n > 0")
        .groupBy("sid")
        .agg(F.count("*").alias("copies"), F.min("key").alias("least"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    )
    found = _search(rows.select("key", "text"), sets, k, threshold, target, trees, depth, report)
    classes = connected_components(found.select(F.col("sid").alias("u"), F.col("other").alias("v")))
    linked = found.groupBy("sid").agg(F.sum("links").alias("links")).join(classes.withColumnRenamed("node", "sid"), "sid")
    linked = cut_lineage(linked.join(sets.select("sid", "least"), "sid"))
    names = linked.groupBy("component").agg(F.min("least").alias("class"))
    linked = linked.join(names, "component").select("sid", "links", "class")
    known = cut_lineage(sets.select("sid", "copies", "least").join(linked, "sid", "left"))
    return (
        signed.select("key", "of", F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
        .join(known, "sid", "left")
        .select(
            "key",
            "of",
            F.coalesce("class", "least", "key").alias("class_id"),
            F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
        )
    )


def keep_one_of_each(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    target: float = 0.99999,
    trees: int = TREES,
    depth: int = DEPTH,
) -> DataFrame:
    """The rows of ``docs``, all columns, less those whose class is named by another row.

    A row with a null key stays. Rows with equal keys stay or go by their own texts' classes: a
    row is told by key and text. Rows alike in both are one document and stay or go together. No
    rows give no rows.
    """
    classes = _classes(docs, key, text, k, threshold, target, trees, depth)
    kept = classes.where("key IS NULL OR class_id = key").select("key", "of").distinct()
    rows = docs.select(
        F.col(key).alias("k"), F.md5(F.coalesce(text, F.lit(""))).alias("o"), F.struct(*docs.columns).alias("row")
    )
    held = rows.join(kept, F.col("k").eqNullSafe(F.col("key")) & (F.col("o") == F.col("of")), "left_semi")
    return held.select(*(F.col(f"row.`{n}`").alias(n) for n in docs.columns))
