"""Tokens against the tokenizer itself, packing against best-fit decreasing done by hand."""

import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from authscope.llm.packing import WordIds, best_fit_decreasing, pack, tokenizer_path

from .conftest import ODD, words


def by_hand(sizes, length):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits)[1]] -= s
        else:
            free.append(length - s)
    return sorted(free)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120))
def test_plan_is_best_fit_decreasing(sizes):
    bins = {}
    for size, rank, n, first, each, offset in best_fit_decreasing(dict(Counter(sizes)), 30):
        for k in range(n):
            bins.setdefault(first + k // each, []).append((offset + k % each * size, size))
    free = []
    for pieces in bins.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        free.append(30 - at)
    assert sorted(free) == by_hand(sizes, 30)


def test_ids_are_the_tokenizers():
    ids, r = WordIds(tokenizer_path()), random.Random(5)
    odd = "aAbÉßµ İΣσς́̌\x1c\x1d　\xa0\x85 \n\t'sdtveml,.!?|<>09²中😀_-ªº"
    texts = ["".join(r.choice(odd) for _ in range(r.randrange(30))) for _ in range(3000)]
    texts += ["It's the<|endoftext|>foo I'LL 'd", "don't can've", "<|startoftext|>", " ".join(words(r, 50))]
    ids.KEPT = 50  # so that the generations change
    for t in texts:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_packed_rows(docs_of):
    r = random.Random(6)
    rows = [(i, " ".join(words(r, int(r.expovariate(1 / 300))))) for i in range(120)] + ODD
    found = pack(docs_of(rows)).collect()
    ids = WordIds(tokenizer_path())
    want = Counter()
    for key, text in rows:
        own = ids.of(text or "") + b"\0\0\0\0"
        for k, at in enumerate(range(0, len(own), 8192)):
            want[key, k, at // 4, len(own[at : at + 8192]) // 4, zlib.crc32(own[at : at + 8192])] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in found) == want
    bins = {}
    for x in found:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(2048 - sum(n for _, n in b) for b in bins.values()) == by_hand([x.length for x in found], 2048)
    assert pack(docs_of([])).count() == 0
