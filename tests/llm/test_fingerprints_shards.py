"""Fingerprints and shards against plain Python."""

import hashlib
import random
import zlib

from authscope.llm.fingerprints import both_fingerprints, fingerprint, fingerprint_with_edits
from authscope.llm.sharding import shard_by_bytes

from .conftest import ODD, words


def phrases(text):
    known, i, out = set(), 0, set()
    for j in range(1, len(text) + 1):
        if text[i:j] not in known:
            known.add(text[i:j])
            out.add(text[i:j])
            i = j
    return out


def test_fingerprint_estimates_the_likeness_of_phrase_sets():
    r = random.Random(1)
    a = " ".join(words(r, 400, 50))
    b = a[: len(a) // 2] + " ".join(words(r, 200, 50, "v"))
    one, two = fingerprint(a), fingerprint(b)
    same = sum(one[i : i + 4] == two[i : i + 4] for i in range(0, 512, 4)) / 128
    p, q = phrases(a), phrases(b)
    assert abs(same - len(p & q) / len(p | q)) < 0.15
    assert fingerprint(a) == one and len(one) == 512 and fingerprint("") == fingerprint(None)


def test_shared_half_is_parsed_once_with_the_same_result():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 50, 1001):
        text, other = "".join(r.choices("ab c", k=n)), "".join(r.choices("abcd", k=n // 3))
        edited, own, changed = both_fingerprints(text, other)
        assert own.tobytes().hex() == fingerprint(text)
        assert changed.tobytes().hex() == fingerprint(edited)


def test_edits_follow_descending_keys(docs_of):
    r = random.Random(3)
    rows = [(i * 7 % 101, " ".join(words(r, r.randrange(0, 60)))) for i in range(101)]
    for count in (1, 2, 101):
        some = dict(rows[:count])
        order = sorted(some, reverse=True)
        # Small buckets, so that most rows have a bucket's border next to them.
        found = {x.doc_id: x for x in fingerprint_with_edits(docs_of(rows[:count]), bucket_bytes=1).collect()}
        assert len(found) == count
        for i, k in enumerate(order):
            text, after = some[k], some[order[(i + 1) % count]]
            edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            x = found[k]
            assert x.n_chars == len(text) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert x.fingerprint == fingerprint(text) and x.edited_fingerprint == fingerprint(edited)
            assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
            assert (x.near_next == 1.0) == (fingerprint(text) == fingerprint(after))


def test_fingerprints_of_odd_rows(docs_of):
    rows = fingerprint_with_edits(docs_of(ODD)).collect()
    assert len(rows) == len(ODD)
    by_key = {x.doc_id: x for x in rows}
    assert by_key[900].n_chars == 0 and by_key[900].fingerprint == by_key[901].fingerprint == fingerprint("")
    assert by_key[905].fingerprint == by_key[906].fingerprint
    assert fingerprint_with_edits(docs_of([])).count() == 0
    assert fingerprint_with_edits(docs_of([(None, "a"), (None, None)])).count() == 2


def test_shards_are_contiguous_and_even(docs_of):
    r = random.Random(4)
    rows = [(i, "é" * r.randrange(0, 40)) for i in range(1000)]
    found = sorted(shard_by_bytes(docs_of(rows)).collect(), key=lambda x: x.doc_id)
    total, before, slots = sum(x["size"] for x in found), 0, {}
    for x, (i, text) in zip(found, rows):
        assert x["size"] == len(text.encode()) + 1 and x.text_crc32 == zlib.crc32(text.encode())
        assert x.shard == (2 * before + x["size"]) * 16 // (2 * total)
        before += x["size"]
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(s == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    sizes = [sum(x["size"] for x in found if x.shard == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= 2 * 81


def test_shards_of_odd_rows(docs_of):
    rows = shard_by_bytes(docs_of(ODD)).collect()
    assert len(rows) == len(ODD)
    assert {(x["size"], x.text_crc32) for x in rows if x.doc_id in (900, 901)} == {(1, 0)}
    assert all(x.law == "bytes" and x.grown_shard is None for x in rows)
    assert shard_by_bytes(docs_of([])).count() == 0
    assert [x.shard for x in shard_by_bytes(docs_of([(1, "a")])).collect()] == [8]


def expected(rows):
    """Edited texts by row, in descending order of (key, hash of the text)."""
    out = []
    for i, (_, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        out.append(hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest())
    return out


def test_edits_of_keys_beyond_doubles(docs_of):
    r = random.Random(34)
    for keys in (
        [2**60 + i for i in range(60)],
        [-(2**62) - i for i in range(60)],
        [r.randrange(-(2**63), 2**63) for _ in range(300)],
    ):
        rows = sorted(((k, " ".join(words(r, r.randrange(1, 40)))) for k in keys), reverse=True)
        found = {x.doc_id: x.edited_sha256 for x in fingerprint_with_edits(docs_of(rows), bucket_bytes=1).collect()}
        assert found == dict(zip([k for k, _ in rows], expected(rows), strict=True))


def test_one_key_of_very_many_texts_is_spread(spark, docs_of, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from authscope.llm import fingerprints

    monkeypatch.setattr(fingerprints, "SAMPLE", 4)
    rows = [(7, f"text number {i} of one key") for i in range(10_000)] + [(9, "above"), (3, "below"), (None, "no key")]
    hashes = {t: h for t, h in docs_of(rows).select("text", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]), reverse=True)
    cuts = fingerprints._cuts(docs_of(rows).select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("hash")), 16)
    assert 16 <= len(cuts) <= 17  # the highest row ends the last range
    docs_of(rows).coalesce(4).write.parquet(str(tmp_path / "docs"))  # its size is known, unlike that of rows in memory
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = fingerprint_with_edits(docs, bucket_bytes=1 << 14).select("doc_id", "edited_sha256").collect()
    assert sorted((x[0] or 0, x[1]) for x in found) == sorted((k or 0, e) for (k, _), e in zip(order, expected(order), strict=True))
