"""Fingerprints from the phrases of a Lempel-Ziv parse."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import chain, groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.llm.text import slices, span_hashes
from authscope.session import estimated_bytes

VALUES = 128
SAMPLE = 64
_RANDOM = np.random.default_rng(20240229)
_TIMES = _RANDOM.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_NONE = np.full(VALUES, 0xFFFFFFFF, np.uint32)


class Parse:
    """A growing phrase dictionary. Each phrase is the longest known one plus a character."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.node = self.root
        self.added: list[tuple[dict, str]] = []

    def feed(self, text: str) -> list[int]:
        """Ends of the phrases completed within ``text``."""
        root, node, added, ends = self.root, self.node, self.added, []
        for k, c in enumerate(text, 1):
            known = node.get(c)
            if known is None:
                node[c] = {}
                added.append((node, c))
                ends.append(k)
                node = root
            else:
                node = known
        self.node = node
        return ends

    def back_to(self, size: int, node: dict) -> None:
        """Forget the phrases after the first ``size`` ones and stand at ``node`` again."""
        for parent, c in reversed(self.added[size:]):
            del parent[c]
        del self.added[size:]
        self.node = node


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _minima(codes: np.ndarray, ends: list[int], first: int, so_far: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over the phrases that end at ``ends``."""
    if not ends:
        return so_far
    stops = np.array(ends, np.int64)
    starts = np.concatenate([[first], stops[:-1]])
    h = (span_hashes(codes, starts, stops) >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 4096):
        so_far = np.minimum(so_far, (h[i : i + 4096, None] * _TIMES + _PLUS).min(axis=0))
    return so_far


def _digest(minima: np.ndarray) -> np.ndarray:
    """16 bits of each minimum."""
    return ((minima * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")


def fingerprint(text: str | None) -> str:
    """Fingerprint of one text, as hexadecimal digits. The empty text has the one of no phrase."""
    text = text or ""
    return _digest(_minima(_codes(text), Parse().feed(text), 0, _NONE)).tobytes().hex()


def both_fingerprints(text: str, following: str) -> tuple[str, np.ndarray, np.ndarray]:
    """Edited text, and the signatures of the text and the edited text.

    The two share their first half, which is parsed once; the phrases of the text's second
    half are taken out of the dictionary again before the other half is parsed.
    """
    cut = len(text) - len(text) // 2
    edited = text[:cut] + following[: len(text) // 2]
    parse = Parse()
    codes, head = _codes(text), parse.feed(text[:cut])
    shared = _minima(codes, head, 0, _NONE)
    size, node, done = len(parse.added), parse.node, head[-1] if head else 0
    own = _minima(codes, [cut + k for k in parse.feed(text[cut:])], done, shared)
    parse.back_to(size, node)
    other = _minima(_codes(edited), [cut + k for k in parse.feed(edited[cut:])], done, shared)
    return edited, _digest(own), _digest(other)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values: an estimate of the Jaccard similarity of the phrase sets."""
    return float((a == b).mean())


_OUT = "key {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches):
    for piece in slices(batches):
        yield from zip(*(piece.column(c).to_pylist() for c in ("bucket", "tail", "key", "text")))


def _then_next(rows):
    """The rows of a bucket, then what follows its last row: the tail, or else its first row."""
    first = None
    for _, tail, key, text in rows:
        text = text or ""
        first = text if first is None else first
        yield key, text
        if tail:
            return
    yield None, first


def _finished(rows):
    """One result for each row of a bucket, made when the next row is known."""
    held = done = None
    for key, text in _then_next(rows):
        if held is not None:
            edited, own, other = both_fingerprints(held[1], text)
            if done:
                yield *done[0], likeness(done[1], own)
            sha = hashlib.sha256(edited.encode()).hexdigest()
            done = (held[0], len(held[1]), sha, own.tobytes().hex(), other.tobytes().hex(), likeness(own, other)), own
        held = key, text
    yield *done[0], likeness(done[1], _digest(_minima(_codes(text), Parse().feed(text), 0, _NONE)))


def _stream(batches, kind: str):
    """Rows come by bucket, in descending order of the key, then the row that follows the bucket."""
    fields = [pa.type_for_alias(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in _OUT.split(", ")]
    every = chain.from_iterable(_finished(rows) for _, rows in groupby(_rows(batches), key=lambda r: r[0]))
    while some := list(islice(every, 1000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*some), fields)], names)


def _orderable(keys) -> list[tuple[bool, int]]:
    """Keys given as text in ascending order of the numbers, null ones lowest."""
    return [(False, 0) if k is None else (True, int(k)) for k in keys]


def _cuts(rows: DataFrame, count: int) -> list[tuple]:
    """Up to ``count`` rows as (key, hash), ascending, that part the rows evenly; the last is the highest.

    The sample goes by a hash of the row, so it is the same on any partitioning.
    """
    order = F.struct("key", "hash")
    seen = rows.agg(F.count("*").alias("n"), F.max(order).alias("top")).first()
    if not seen["n"]:
        return []
    every = max(1, seen["n"] // (count * SAMPLE))
    some = rows.where(F.expr(f"pmod(xxhash64(key, hash), {every}) = 0")).select("key", "hash").distinct().collect()
    found = sorted(((r["key"] is not None, r["key"] or 0), r["hash"]) for r in some)
    top = ((seen["top"]["key"] is not None, seen["top"]["key"] or 0), seen["top"]["hash"])
    if len(found) > count:
        found = [found[(i + 1) * len(found) // count - 1] for i in range(count)]
    return sorted({*found, top})


def fingerprint_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = 1 << 23) -> DataFrame:
    """Fingerprints of every text and of the text with its second half replaced.

    The last ``n // 2`` code points give way to as many first ones (or all) of the next text,
    in descending order of ``key``; after the last row comes the first. The likeness to the
    edited text and to the next text is the share of equal signature values, 0 to 1.

    ``key`` is an integer of up to 64 bits. Rows are in order of (key, hash of the text, text), so
    that rows of one key spread over buckets as well. A keyed sample of that order, of at most some
    ``SAMPLE`` rows a bucket, gives cuts that are rows of the table; the text is shuffled once, each
    bucket sorted, and the first row of a bucket is sent to its neighbour as well, so no bucket waits
    for another one. Null keys come last; a null text is empty. The empty text's fingerprint is
    that of no phrase, fully like another one's. A single row is its own next. No rows give no rows.
    Only the key and the text are read, so other columns may have any names.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("key", F.xxhash64("text").alias("hash"), "text")
    count = int(min(1 << 14, max(8, estimated_bytes(docs) // bucket_bytes)))
    known = _cuts(rows, count)

    @F.pandas_udf("array<struct<bucket:int,tail:boolean>>")
    def places(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        out = []
        for row in zip(_orderable(keys), hashes.tolist()):
            at = bisect_left(known, row)
            out.append([(at, False), ((at + 1) % len(known), True)] if known[at] == row else [(at, False)])
        return pd.Series(out)

    # Strings for the keys, as a nullable integer column would pass through doubles.
    dealt = (
        rows.select("key", "hash", "text", F.inline(places(F.col("key").cast("string"), "hash")))
        .repartitionById(max(1, len(known)), F.col("bucket"))
        .sortWithinPartitions("bucket", "tail", F.col("key").desc_nulls_last(), F.desc("hash"), "text")
    )
    alias = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8"}[kind]
    return dealt.mapInArrow(lambda b: _stream(b, alias), _OUT.format(kind)).withColumnRenamed("key", key)
