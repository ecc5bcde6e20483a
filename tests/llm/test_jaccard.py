"""Near-duplicate classes against all pairs."""

import random
import re

import pytest

from authscope.llm import jaccard
from authscope.llm.components import connected_components
from authscope.llm.jaccard import found_chance, keep_one_of_each, least_depth, near_duplicates

from .conftest import ODD, known, words


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def by_hand(rows):
    """Links and class of each row, by comparing all rows."""
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    names = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            names[find(i)] = min(names.get(find(i), k), k)
    return sorted((known(k), known(names.get(find(i))), n) for i, ((k, _), n) in enumerate(zip(rows, links)))


def edited(r, base, n):
    w = base.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture
def rows():
    r = random.Random(8)
    base = [" ".join(words(r, 200)) for _ in range(12)]
    out = base + [edited(r, b, r.randrange(1, 8)) for b in base for _ in range(6)] + base[:3] * 4
    out += [" ".join(words(r, 3)) for _ in range(10)] + ["one two three"] * 3
    r.shuffle(out)
    return list(enumerate(out)) + ODD


def test_links_and_classes_are_those_of_all_pairs(docs_of, rows):
    found = near_duplicates(docs_of(rows)).collect()
    assert sorted((known(x.doc_id), known(x.class_id), x.n_links) for x in found) == by_hand(rows)


def test_blocks_of_a_large_class_lose_nothing(docs_of, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    r = random.Random(9)
    base = " ".join(words(r, 150))
    chain = [(5000 + i, edited(r, base, i % 5)) for i in range(60)]
    found = near_duplicates(docs_of(rows + chain)).collect()
    assert sorted((known(x.doc_id), known(x.class_id), x.n_links) for x in found) == by_hand(rows + chain)


def test_one_of_each_group_stays(docs_of, rows):
    rows = [x for x in rows if x[0] is not None]
    kept = keep_one_of_each(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    want = sorted(k for k, name, _ in by_hand(rows) if k == name)
    assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == want
    assert keep_one_of_each(docs_of([(None, "a b c d e f"), (None, "a b c d e f")])).count() == 2
    assert near_duplicates(docs_of([])).count() == 0


def test_prefixes_are_shortened_until_the_target():
    assert least_depth(0.8, 0.99999, 24, 6) == 4
    assert least_depth(0.8, 0.9, 24, 6) == 6
    assert least_depth(0.1, 0.99999, 2, 6) == 1


def test_components_of_random_edges(spark):
    r = random.Random(10)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    found = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x.node: x.component for x in found} == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_paths_stars_and_odd_edges(spark):
    path = [(i * 7919 % 1009, (i + 1) * 7919 % 1009) for i in range(600)]
    star = [(-5, -100 - i) for i in range(50)]
    for edges in (path, [(i, i + 1) for i in range(200)], star):
        found = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
        ends = {n for e in edges for n in e}
        assert {x.node: x.component for x in found} == dict.fromkeys(ends, min(ends)) and len(found) == len(ends)
    odd = spark.createDataFrame([(1, 1), (None, 2), (3, None), (4, 3), (3, 4), (4, 3)], "u long, v long")
    assert sorted(tuple(x) for x in connected_components(odd).collect()) == [(3, 3), (4, 3)]


def test_near_copies_without_a_key_are_linked(docs_of):
    r = random.Random(31)
    a, b, c = (words(r, 120, 10**6, p) for p in "abc")
    near = [" ".join(w[:-1] + ["other"]) for w in (a, b)]
    rows = [(7, " ".join(a)), (None, near[0]), (None, near[0]), (None, " ".join(b)), (None, near[1]), (None, " ".join(c)), (None, None), (None, "")]
    found = sorted(((x.doc_id or 0, x.class_id or 0, x.n_links) for x in near_duplicates(docs_of(rows)).collect()))
    assert found == sorted([(7, 7, 2), (0, 7, 2), (0, 7, 2), (0, 0, 1), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)])


def alike(r, share, n, words_each=300):
    """Pairs of texts of which about this share of the shingles is equal."""
    out = []
    for i in range(n):
        a = words(r, words_each, 10**6, f"p{i}x")
        cut = round(words_each * share)
        out += [" ".join(a), " ".join(a[:cut] + words(r, words_each - cut, 10**6, f"q{i}x"))]
    return out


def test_prefixes_are_as_short_as_the_data_need(docs_of):
    """Pairs that are nearly equal are all found by whole labels; those near the threshold are not."""
    r, reports = random.Random(32), {}
    for name, share in (("near", 0.99), ("far", 0.905)):
        rows = list(enumerate(alike(r, share, 60)))
        report = []
        found = near_duplicates(docs_of(rows, clashing=False), report=report).collect()
        assert sorted((x.doc_id, x.class_id, x.n_links) for x in found) == by_hand(rows)
        assert report[0][0] == 6 and [d for d, _, _ in report] == sorted({d for d, _, _ in report}, reverse=True)
        reports[name] = report
    assert len(reports["near"]) == 1 and reports["near"][0][2] > 0.99999
    assert len(reports["far"]) > 1 and reports["far"][0][2] < 0.99999
    assert found_chance(0.8, 4, 24) > 0.99999 > found_chance(0.8, 5, 24)


def test_recall_at_each_length_is_the_share_of_links_found(docs_of):
    """With two trees most links are missed by long prefixes; the estimate must tell how many."""
    rows = list(enumerate(alike(random.Random(33), 0.95, 400, 100)))
    true = sum(n for _, _, n in by_hand(rows)) // 2
    report = []
    near_duplicates(docs_of(rows, clashing=False), trees=2, depth=6, report=report).collect()
    assert len(report) > 1
    for _, links, recall in report:
        assert abs(links / true - recall) < 0.12
    assert [n for _, n, _ in report] == sorted(n for _, n, _ in report)


def test_rows_with_one_key_go_by_their_own_texts(docs_of):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    kept = keep_one_of_each(docs_of([(1, a), (5, a), (5, b), (None, a)]))
    assert sorted((known(x.doc_id), x.text) for x in kept.collect()) == [(-1, a), (1, a), (5, b)]
