import hashlib
import random
import re

import pytest

from authscope.llm import decontaminate
from authscope.llm.decontaminate import contaminated
from tests.llm.conftest import ODD, known, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    """The contract, window by window."""
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                of = windows.get(tuple(w[s : s + n]))
                if of:
                    hit.update(range(s, s + n))
                    found |= of
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=lambda x: (known(x[0]), x))


def found(spark, docs_of, docs, items, **options):
    of = spark.createDataFrame([(*x, "x", "y") for x in items], "item_id long, text string, words string, item string")
    return sorted((tuple(r) for r in contaminated(docs_of(docs), of, **options).collect()), key=lambda x: (known(x[0]), x))


def corpus(seed, vocabulary=400):
    r = random.Random(seed)
    items = [(i, " ".join(words(r, r.choice([3, 7, 10, 11, 25, 60]), vocabulary))) for i in range(25)]
    docs = []
    for i in range(80):
        text = words(r, r.randrange(0, 150), vocabulary)
        for _ in range(r.randrange(3)):
            passage = words_of(r.choice(items)[1])
            lo = r.randrange(len(passage))
            at = r.randrange(len(text) + 1)
            text[at:at] = passage[lo : lo + r.choice([5, 9, 10, 12, 60])]
        docs.append((i, " ".join(text).title() if i % 3 else ",\n".join(text)))
    return docs, items


@pytest.mark.parametrize("sent", [100_000, 0])
def test_equals_brute_force(spark, docs_of, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "SENT", sent)
    docs, items = corpus(1)
    got = found(spark, docs_of, docs, items)
    assert got == brute(docs, items)
    assert 10 < sum(x[5] for x in got) < len(docs)


@pytest.mark.parametrize("span", [5, 13, 19])
def test_other_spans(spark, docs_of, span):
    docs, items = corpus(2, 60)
    assert found(spark, docs_of, docs, items, span=span) == brute(docs, items, span)


def test_repeated_words_and_passages(spark, docs_of):
    """Equal grams tie for the least hash within a window, and a passage occurs again 16 words on."""
    items = [(1, "a " * 12), (2, "a b a b a b a b a b a b"), (3, " ".join(f"w{i}" for i in range(10)))]
    passage = " ".join(f"w{i}" for i in range(10))
    gaps = [f"{passage} {'x ' * n}{passage}" for n in range(0, 23)]
    docs = [(1, "a " * 30), (2, "b a " * 20), (3, "a " * 9), *((10 + n, t) for n, t in enumerate(gaps))]
    got = found(spark, docs_of, docs, items)
    assert got == brute(docs, items)
    assert all(x[2] == 20 for x in got if x[0] >= 10)


def test_odd_rows(spark, docs_of):
    long_text = " ".join(f"t{i}" for i in range(60_000)) + " needle in this very long text that has nine more words"
    items = [(1, None), (2, ""), (3, "-- !"), (None, "same text here"), (5, "needle in this very long text that has nine more"), (5, "a"), (5, "a")]
    docs = [*ODD, (950, long_text), (951, "SAME text, here; same text here"), (951, "other")]
    assert found(spark, docs_of, docs, items) == brute(docs, items)


def test_nothing_to_find_or_to_search(spark, docs_of):
    assert found(spark, docs_of, [], [(1, "a b c")]) == []
    docs = [(1, "a b c"), (2, None)]
    assert found(spark, docs_of, docs, []) == brute(docs, [])
    assert found(spark, docs_of, docs, [(1, None)]) == brute(docs, [])


def test_many_copies_share_their_rows(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    docs = [(i, text) for i in range(3000)] + [(5000 + i, f"clean document number {i}") for i in range(50)]
    got = found(spark, docs_of, docs, [(1, text)])
    assert sum(x[2] == 40 for x in got) == 3000 and sum(x[5] for x in got) == 3000


def test_only_spark_functions(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = contaminated(docs_of([(1, "a b c")]), items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
