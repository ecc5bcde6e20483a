"""Ranked lexical search: the best documents for every item, by a dual-tree search.

Documents are vectors of term impacts, items vectors of term weights; a score is their dot
product in integers. A hierarchy over the items and one over each block of documents hold, in every
node, the largest value of each term below it, so the product of two nodes bounds all scores of
their pairs. Pairs of nodes whose bound is below the weakest kept score of every item in the node
are dropped whole; at the leaves the bound is the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authscope.llm.text import slices, term_hashes
from authscope.session import cut_lineage

CELLS = 1 << 22  # of a dense matrix: items by terms, documents by terms
FAN = 4  # children of a node
SEED_DOCS = 1 << 15  # documents, in expectation, from which the first weakest scores come


def _item_batches(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """Items with terms as (key, term hashes), in batches of ``CELLS`` items times terms."""
    batch, terms = [], set()
    rows = items.select(F.col(key).alias("key"), F.col(text).alias("body")).where("body IS NOT NULL").distinct()
    for row in rows.toLocalIterator():
        hashes = term_hashes(pa.array([row["body"]]))[0]
        if not len(hashes):
            continue
        more = set(hashes.tolist()) - terms
        if batch and (len(batch) + 1) * (len(terms) + len(more)) > CELLS:
            yield batch
            batch, terms, more = [], set(), set(hashes.tolist())
        batch.append((row["key"], hashes))
        terms |= more
    if batch:
        yield batch


def _counter(vocabulary: np.ndarray):
    """Of each document its number of terms, and those of the vocabulary with their counts."""

    def run(batches):
        for batch in slices(batches):
            hashes, first = term_hashes(batch.column("text"))
            at = np.searchsorted(vocabulary, hashes)
            at[at == len(vocabulary)] = 0
            known = vocabulary[at] == hashes
            rows = np.repeat(np.arange(batch.num_rows), np.diff(first))
            cells, tf = np.unique(rows[known] * len(vocabulary) + at[known], return_counts=True)
            row, term = np.divmod(cells, len(vocabulary))
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64))),
                ],
                ["key", "n", "terms", "tf"],
            )

    return run


def similar_order(points: np.ndarray) -> np.ndarray:
    """An order of the rows that halves them again and again between two far ones.

    Cuts are at powers of two, so that blocks of any such size hold rows that are alike.
    """
    order, todo = np.arange(len(points)), [(0, len(points))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= 2:
            continue
        p = points[order[lo:hi]]
        far = p[((p - p.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        other = p[((p - far) ** 2).sum(axis=1).argmax()]
        order[lo:hi] = order[lo:hi][np.argsort(p @ (far - other), kind="stable")]
        half = 1 << ((hi - lo - 1).bit_length() - 1)
        todo += [(lo, lo + half), (lo + half, hi)]
    return order


def maxima(rows: np.ndarray) -> list[np.ndarray]:
    """Levels of a hierarchy over the rows, root first: each node the largest values of its children."""
    levels = [rows]
    while len(levels[0]) > 1:
        levels.insert(0, np.maximum.reduceat(levels[0], np.arange(0, len(levels[0]), FAN), axis=0))
    return levels


def _children(nodes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node, in turn, its children of ``below`` nodes; and which node each is of."""
    first = nodes * FAN
    n = np.minimum(first + FAN, below) - first
    of = np.repeat(np.arange(len(nodes)), n)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


class ItemTree:
    """The hierarchy over the items of a batch and the weakest kept score of each item."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], terms: int, weakest: np.ndarray, k: int) -> None:
        dense = np.zeros((len(rows), terms), np.int64)
        for i, (at, weight) in enumerate(rows):
            dense[i, at] = weight
        # A score is below the sum of all weights times 10**6; float64 is exact below 2**53.
        self.kind = np.float64 if int(dense.sum(axis=1).max()) * 10**6 < 1 << 53 else np.int64
        self.order = similar_order(dense.astype(np.float64))
        self.levels = [x.astype(self.kind) for x in maxima(dense[self.order])]
        self.used = [[np.flatnonzero(row) for row in level] for level in self.levels]
        self.weakest = weakest[self.order]
        self.directions = next((x for x in reversed(self.levels) if len(x) <= 64), self.levels[0]).T.astype(np.float64)
        self.k = k
        self.kept: list[list[tuple]] = [[] for _ in rows]

    def search(self, docs: np.ndarray, keys: pa.Array) -> None:
        """Put the documents (dense impacts) that are among the best so far into ``kept``."""
        order = similar_order(docs @ self.directions)
        levels = maxima(docs[order].astype(self.kind))
        floors = [self.weakest]
        while len(floors[0]) > 1:
            floors.insert(0, np.minimum.reduceat(floors[0], np.arange(0, len(floors[0]), FAN)))
        i = j = 0
        item, doc = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            bound = np.empty(len(item), self.kind)
            by_item = np.argsort(item, kind="stable")
            for at in np.split(by_item, np.flatnonzero(np.diff(item[by_item])) + 1):
                if len(at):
                    node = item[at[0]]
                    used = self.used[i][node]
                    bound[at] = levels[j][np.ix_(doc[at], used)] @ self.levels[i][node, used]
            left = (bound > 0) & (bound >= floors[i][item])
            item, doc, bound = item[left], doc[left], bound[left]
            if i + 1 == len(self.levels) and j + 1 == len(levels):
                break
            if i + 1 < len(self.levels):
                i += 1
                item, of = _children(item, len(self.levels[i]))
                doc = doc[of]
            if j + 1 < len(levels):
                j += 1
                doc, of = _children(doc, len(levels[j]))
                item = item[of]
        self._keep(item, order[doc], bound.astype(np.int64), keys)

    def _keep(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, keys: pa.Array) -> None:
        by_item = np.argsort(item, kind="stable")
        for at in np.split(by_item, np.flatnonzero(np.diff(item[by_item])) + 1):
            if not len(at):
                continue
            s = score[at]
            if len(at) > self.k:  # ties with the last one stay, as the key decides among them
                at = at[s >= np.partition(s, len(s) - self.k)[len(s) - self.k]]
            found = zip((-score[at]).tolist(), keys.take(pa.array(doc[at])).to_pylist(), strict=True)
            node = item[at[0]]
            best = sorted([*self.kept[node], *((s, key is None, key) for s, key in found)], key=lambda x: x[: 2 + (not x[1])])
            self.kept[node] = best[: self.k]
            if len(best) >= self.k:
                self.weakest[node] = max(self.weakest[node], -best[self.k - 1][0])


def _searcher(make_tree, terms: int, base: tuple[int, int], key_type: pa.DataType):
    n_docs, n_terms = base

    def run(batches):
        tree = make_tree()
        step = max(16, CELLS // terms)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                n = part.column("n").to_numpy()
                found, tf = part.column("terms"), part.column("tf").flatten().to_numpy()
                row = np.repeat(np.arange(len(n)), np.diff(found.offsets.to_numpy()))
                m = 25 + (75 * n * n_docs) // n_terms
                docs = np.zeros((len(n), terms))
                docs[row, found.flatten().to_numpy()] = (10**9 * tf) // (1000 * tf + 8 * m[row])
                tree.search(docs, part.column("key"))
        rows = [(int(tree.order[i]), key, -s) for i, kept in enumerate(tree.kept) for s, _, key in kept]
        item, key, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(key, key_type), pa.array(score, pa.int64())], ["item", "key", "score"]
        )

    return run


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``k`` documents of the highest scores above 0 for each item, equal scores by key.

    Terms are runs of ASCII letters (A to Z as a to z), digits and other characters beyond
    ASCII. With N documents that have terms, L terms in all, n in a document, df documents
    with a term and tf of it in one, a term weighs floor(1000 ln((2N + 2) / (2 df + 1))); m is
    25 + (75 n N) div L, and a score sums weight * ((10**9 tf) div (1000 tf + 8 m)) over an item's
    terms with repeats, all in 64 bits.

    Items go in batches whose matrix of items and terms is bounded; for each batch one pass
    over the text leaves the counts of the batch's terms alone, and all else reads that table.
    A sample of the documents gives a first weakest score for each item, a lower bound of the
    true one, so the sample changes what is pruned and never what is found. Tasks build their
    hierarchies over blocks of documents and hand on ``k`` rows an item at most.

    Null and empty texts have no terms: such documents are never found, such items have no rows.
    Rows with equal keys are documents of their own; null keys come last among equals. Items of
    equal id and text are one; an id with other texts has a ranking for each. No documents or
    items give no rows. Only keys and texts are read, so other columns may have any names.
    """
    spark = docs.sparkSession
    key_type = docs.schema[key].dataType.simpleString()
    item_type = items.schema[item_key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = []
    for batch in _item_batches(items, item_key, item_text):
        vocabulary, at = np.unique(np.concatenate([h for _, h in batch]), return_inverse=True)
        each = np.split(at, np.cumsum([len(h) for _, h in batch])[:-1])
        schema = f"key {key_type}, n long, terms array<int>, tf array<long>"
        counted = cut_lineage(texts.mapInArrow(_counter(vocabulary), schema)).where("n > 0")
        total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            break
        held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        df = np.zeros(len(vocabulary), np.int64)
        for r in held:
            df[r["term"]] = r["count"]
        n = total["docs"]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        rows = []
        for terms in each:
            used, times = np.unique(terms, return_counts=True)
            rows.append((used, times * weight[used]))

        def search(table: DataFrame, weakest: np.ndarray, rows=rows, terms=len(vocabulary), total=total) -> DataFrame:
            run = _searcher(
                lambda: ItemTree(rows, terms, weakest.copy(), k), terms, (total["docs"], total["terms"]), _arrow(table, "key")
            )
            found = table.where(F.size("terms") > 0).mapInArrow(run, f"item int, key {key_type}, score long")
            best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
            return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

        sample = counted.sample(min(1.0, SEED_DOCS / n), seed=1).repartition(max(1, min(n, SEED_DOCS) // 2048))
        weakest = np.zeros(len(batch), np.int64)
        for r in search(sample, weakest).where(F.col("rank") == k).collect():
            weakest[r["item"]] = r["score"]
        named = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(batch)], f"item int, named {item_type}")
        found = cut_lineage(search(counted, weakest))  # k rows an item
        out.append(
            found.join(F.broadcast(named), "item").select(
                F.col("named").alias(item_key), "rank", F.col("key").alias(key), "score"
            )
        )
    if not out:
        return texts.where("false").select(
            F.lit(None).cast(item_type).alias(item_key),
            F.lit(0).alias("rank"),
            F.col("key").alias(key),
            F.lit(0).cast("long").alias("score"),
        )
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    return all_


def _arrow(table: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(table.schema[column].dataType)
