import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from authscope.llm import lexical
from authscope.llm.lexical import maxima, ranked_search, similar_order
from tests.llm.conftest import ODD, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """The contract over all pairs."""
    bags = [(key, Counter(t), len(t)) for key, text in docs if (t := terms_of(text))]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for key, bag, n in bags:
            m = 25 + (75 * n * n_docs) // n_terms
            score = 0
            for t in terms_of(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs_of, docs, items, **options):
    of = spark.createDataFrame([(*x, "x", "y") for x in items], "item_id long, text string, score string, key string")
    return sorted((tuple(r) for r in ranked_search(docs_of(docs), of, **options).collect()), key=repr)


def corpus(seed, n_docs=600, n_items=40):
    r = random.Random(seed)
    items = [(i, " ".join(words(r, r.randrange(1, 40), 300, "ABCé"[i % 4]))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        text = words(r, r.randrange(0, 80), 300, "ABCé"[i % 4])
        if i % 7 == 0:
            text += terms_of(r.choice(items)[1])
        docs.append((i, " ".join(text)))
    return docs + [(2000 + i, docs[i][1]) for i in range(60)], items  # exact copies tie


def test_equals_brute_force(spark, docs_of):
    docs, items = corpus(1)
    assert found(spark, docs_of, docs, items) == brute(docs, items)


def test_small_blocks_batches_and_samples(spark, docs_of, monkeypatch):
    """Several batches of items, blocks of few documents, and weakest scores from a few rows."""
    monkeypatch.setattr(lexical, "CELLS", 5000)
    monkeypatch.setattr(lexical, "SEED_DOCS", 100)
    docs, items = corpus(2)
    for k in (1, 3):
        assert found(spark, docs_of, docs, items, k=k) == brute(docs, items, k)


def test_node_values_bound_all_scores_below_them():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 100, (37, 12))
    order = similar_order(rows.astype(float))
    assert sorted(order.tolist()) == list(range(37))
    levels = maxima(rows[order])
    assert len(levels[0]) == 1 and (levels[0][0] == rows.max(axis=0)).all()
    for level, below in zip(levels, levels[1:], strict=False):
        for i, node in enumerate(level):
            assert (node == below[4 * i : 4 * i + 4].max(axis=0)).all()


def test_pairs_are_pruned_above_the_leaves(monkeypatch):
    """Documents of other words than the item's are dropped by few bounds."""
    asked = []
    plain = lexical._children
    monkeypatch.setattr(lexical, "_children", lambda nodes, below: asked.append(len(nodes)) or plain(nodes, below))
    import pyarrow as pa

    docs = np.zeros((256, 64))
    for i in range(256):
        docs[i, (i % 2) * 32 : (i % 2) * 32 + 32] = 5
    tree = lexical.ItemTree([(np.arange(32), np.full(32, 7))], 64, np.zeros(1, np.int64), 10)
    tree.search(docs, pa.array(range(256)))
    assert [x[2] for x in tree.kept[0]] == list(range(0, 20, 2))
    assert max(asked) <= 128 // 4 + 1  # half of the documents share no node's bound


def test_integers_beyond_float64(spark, docs_of):
    """A term so often in an item that scores pass 2**53."""
    docs = [(i, f"rare w{i} " + "w " * i) for i in range(40)]
    items = [(1, "rare " * 30 + "w7 " * 400_000)]
    assert lexical.ItemTree([(np.zeros(1, int), np.array([10**11]))], 1, np.zeros(1, np.int64), 1).kind is np.int64
    assert found(spark, docs_of, docs, items) == brute(docs, items)


def test_odd_rows(spark, docs_of):
    docs = [*ODD, (950, "needle " + "t " * 100_000), (951, "ÀÉ àé Straße"), (952, "Àé")]
    items = [(1, None), (2, ""), (3, "same text here"), (4, "x" * 5000), (4, "needle a"), (4, "needle a"), (None, "row key àé É")]
    assert found(spark, docs_of, docs, items) == brute(docs, items)


def test_nothing_to_find_or_to_search(spark, docs_of):
    assert found(spark, docs_of, [], [(1, "a")]) == []
    assert found(spark, docs_of, [(1, None)], [(1, "a")]) == []
    assert found(spark, docs_of, [(1, "a")], []) == []
    assert found(spark, docs_of, [(1, "a b")], [(1, "c")]) == []


def test_keys_may_be_text(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "x")], "item_id string, text string")
    assert [r["doc_id"] for r in ranked_search(docs, items).orderBy("rank").collect()] == ["a", "b", None]


@pytest.mark.parametrize("copies", [3000])
def test_a_large_group_of_copies(spark, docs_of, copies):
    docs = [(i, "one text in very many copies") for i in range(copies)] + [(9000 + i, f"other {i} text") for i in range(20)]
    items = [(1, "copies text"), (2, "other 7")]
    assert found(spark, docs_of, docs, items) == brute(docs, items)
