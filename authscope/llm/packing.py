"""Best-fit decreasing packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authscope.llm.text import slices
from authscope.session import cut_lineage

LENGTH = 2048


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of a chunk of text between white space, as little-endian 32-bit integers.

    The tokenizer folds white space and lets no token cross it, so a text's ids are those of
    its chunks. Chunks seen lately are kept in two generations: when the newer one is full it
    becomes the older one, and what is met again moves on. Their size bounds the memory.
    """

    KEPT = 200_000
    #: How the tokenizer parts a chunk (fixed by its file); it works on lower case.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Blanks for Python that are symbols for the tokenizer.
    CONTROLS = regex.compile("[\x1c-\x1f]")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in own]
        #: The visible character that stands for each byte in the vocabulary.
        self.shown = {**{b: chr(b) for b in own}, **{b: chr(256 + n) for n, b in enumerate(other)}}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        known = self.parts.get(part)
        if known is None:
            known = self.older_parts.get(part)
            if known is None:
                shown = "".join(map(self.shown.__getitem__, part.encode()))
                ids = [t.id for t in self.model.tokenize(shown)]
                known = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.parts) >= self.KEPT:
                self.parts, self.older_parts = {}, self.parts
            self.parts[part] = known
        return known

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            # Below U+0100 normalisation changes nothing and lower case is plain; special tokens
            # and everything else go through the tokenizer as they are.
            if max(chunk) >= "Ā" or "<|" in chunk:
                ids = self._whole(chunk)
            elif chunk.isalpha():
                ids = self._part(chunk.lower())
            else:
                ids = b"".join(map(self._part, self.PARTS.findall(chunk.lower())))
        if len(chunk) <= 64:
            if len(self) >= self.KEPT:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        if self.CONTROLS.search(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.split()))


_WORD_IDS: dict[str, WordIds] = {}


def _pieces(batches, path: str, length: int):
    """Pieces of at most ``length`` ids, each with its number among the partition's equally long ones."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    words, part, seen = _WORD_IDS[path], TaskContext.get().partitionId(), Counter()
    for batch in slices(batches):
        key, rows = batch.column("key"), []
        for n, text in enumerate(batch.column("text").to_pylist()):
            ids = words.of(text or "") + b"\0\0\0\0"
            for k, at in enumerate(range(0, len(ids), 4 * length)):
                own = ids[at : at + 4 * length]
                size = len(own) // 4
                rows.append((n, k, at // 4, size, zlib.crc32(own), seen[size]))
                seen[size] += 1
        n, *columns = (np.array(c, np.int64) for c in zip(*rows))
        arrays = [key.take(pa.array(n)), *(pa.array(c) for c in columns), pa.array(np.full(len(n), part, np.int32))]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "piece", "start", "length", "ids_crc32", "nth", "part"])


class OpenBins:
    """Open bins by free space, under a segment tree that finds the tightest fit."""

    def __init__(self, length: int) -> None:
        self.size = 1 << (length + 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]

    def _change(self, free: int, by: int) -> None:
        i = free + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def add(self, free: int, first: int, count: int) -> None:
        if count:
            self.bins[free].append((first, count))
            self._change(free, 1)

    def take(self, free: int) -> tuple[int, int]:
        self._change(free, -1)
        return self.bins[free].pop()

    def tightest(self, need: int) -> int | None:
        """Least free space of at least ``need`` that an open bin has."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1 and not (i % 2 == 0 and self.tree[i + 1]):  # up to where a right neighbour has bins
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Where best-fit decreasing puts ``counts[size]`` pieces of each size.

    Pieces of one size are alike, so the rule is applied to runs of them: the tightest open
    bin takes pieces of the size until the next one does not fit, as it stays the tightest
    meanwhile; bins with equal contents are one run. The work and the result depend on the
    number of sizes, not on the number of pieces.

    Returns runs (size, first rank, pieces, first bin, pieces a bin, offset in the bin): the
    pieces of that size from that rank on fill the bins from that one on.
    """
    bins, opened, runs = OpenBins(length), 0, []
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0

        def put(free: int, first: int, count: int) -> None:
            """Fill up to ``count`` bins with ``free`` space each; the rest of them stay open."""
            nonlocal left, rank
            each = free // size
            whole = min(count, left // each)
            if whole:
                runs.append((size, rank, whole * each, first, each, length - free))
                bins.add(free - each * size, first, whole)
                left, rank = left - whole * each, rank + whole * each
            if left and whole < count:
                runs.append((size, rank, left, first + whole, left, length - free))
                bins.add(free - left * size, first + whole, 1)
                whole, rank, left = whole + 1, rank + left, 0
            bins.add(free, first + whole, count - whole)

        while left:
            free = bins.tightest(size)
            if free is None:
                new = -(-left // (length // size))
                opened += new
                put(length, opened - new, new)
            else:
                put(free, *bins.take(free))
    return runs


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Pack the tokens of all documents, each followed by id 0, into sequences of ``length``.

    Only a document of more than ``length`` ids is cut, into pieces of that many and a last
    shorter one. Which piece goes where depends on nothing but the number of pieces of every
    size: these counts, at most ``length`` of them, give the plan; a piece finds its place in
    it by its rank among equally long pieces. Ranks are sums of counts by partition, so no
    task sees all pieces of one size.

    A null or blank text is the id 0 alone. Equal keys and repeated rows are packed like any
    others. No rows give no rows. Only the key and the text are read.
    """
    path = path or tokenizer_path()
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, piece long, start long, length long, ids_crc32 long, nth long, part int"
    pieces = cut_lineage(rows.mapInArrow(lambda b: _pieces(b, path, length), schema))

    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("pieces"))
    counts = dict(by_part.groupBy("length").agg(F.sum("pieces")).collect())  # a row for each size up to length
    runs = sorted(best_fit_decreasing(counts, length))
    size, rank, _, first, each, offset = (np.array(c, np.int64) for c in zip(*runs)) if runs else [np.zeros(0, np.int64)] * 6
    keys = (size << 48) + rank

    @F.pandas_udf("sequence_id long, offset long")
    def place(sizes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (sizes.to_numpy() << 48) + ranks.to_numpy(), "right") - 1
        n = ranks.to_numpy() - rank[at]
        return pd.DataFrame({"sequence_id": first[at] + n // each[at], "offset": offset[at] + n % each[at] * size[at]})

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("before"))
    return (
        pieces.join(before, ["length", "part"])
        .withColumn("at", place("length", F.col("before") + F.col("nth")))
        .select(F.col("key").alias(key), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
    )
