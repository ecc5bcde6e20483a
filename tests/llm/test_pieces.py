"""Sampled segmentations: round trips, chances by enumeration, reproducible draws."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from authscope.llm.pieces import Lattices, Vocabulary, decode_pieces, encode, model_path, sample_pieces

from .conftest import ODD, known, words

VOCABULARY = Vocabulary(model_path())
LATTICES = Lattices(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"])) | st.text("ab \n▁é中😀"), max_size=5))
def test_decoding_gives_the_text_back(texts):
    ids, first = encode(texts, np.arange(len(texts)), LATTICES)
    for t, a, b in zip(texts, first, first[1:]):
        raw = b"".join(VOCABULARY.bytes[i] for i in ids[a:b])
        assert raw.decode() == (" " + t if t else "")


def every_path(word):
    if not word:
        return [((), 1.0)]
    out = []
    for j in range(1, len(word) + 1):
        if piece := VOCABULARY.known.get(word[:j]):
            out += [((piece[0], *rest), piece[1] * p) for rest, p in every_path(word[j:])]
    return out


def test_paths_come_with_their_chance():
    n = 30_000
    chance = dict(every_path("▁those"))
    ids, first = encode(["those"] * n, np.arange(n), LATTICES)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(first, first[1:]))
    total = sum(chance.values())
    assert set(seen) <= set(chance)
    assert sum(abs(seen[p] / n - c / total) for p, c in chance.items()) / 2 < 0.01


def test_a_long_unit_does_not_underflow():
    text = "xyzq" * 2000 + "é中" * 300
    ids, _ = encode([text], np.array([1]), Lattices(VOCABULARY))
    assert b"".join(VOCABULARY.bytes[i] for i in ids).decode() == " " + text


def test_rows_keep_their_draws(docs_of):
    r = random.Random(7)
    rows = [(i, " ".join(words(r, 40)) + "\n") for i in range(60)] + ODD
    docs = docs_of(rows)
    once = sorted((known(x.doc_id), x.ids) for x in sample_pieces(docs).collect())
    again = sorted((known(x.doc_id), x.ids) for x in sample_pieces(docs.repartition(5)).collect())
    assert once == again and len(once) == len(rows)
    back = sample_pieces(docs).select("doc_id", "lossless", decode_pieces(F.col("ids")).alias("text")).collect()
    assert Counter((x.doc_id, x.text) for x in back) == Counter((k, t or "") for k, t in rows)
    assert all(x.lossless for x in back)
    assert sample_pieces(docs_of([])).count() == 0
