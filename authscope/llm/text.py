"""Hashes of words and shingles over Arrow batches, in numpy.

A word is a run of bytes other than blank and tab to carriage return (``[^\\x20\\x09-\\x0D]+``).
A null text is an empty one. Work goes by blocks, so the arrays stay small whatever a text's
length; only the hashes of one slice of texts are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``symbols[start:end]``; equal spans have equal hashes.

    Spans are in order and do not overlap.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((symbols[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * down[a])
        i = j
    return out


def slices(batches, column: str = "text", limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches of about ``limit`` bytes of text; at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_buffer(batch.column(column))[1]
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the ``n + 1`` offsets of its texts."""
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def word_spans(
    data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the number of its first word.

    Starts and ends count from the start of ``data``. ``blank`` tells the bytes outside words.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = np.zeros(hi - lo + 2, bool)
    np.logical_not(blank[data[lo:hi]], out=inside[1:-1])
    flips = inside[1:] != inside[:-1]
    breaks = offsets[1:-1] - lo  # a text's end splits a run that goes on in the next text
    both = breaks[inside[breaks] & inside[breaks + 1]] if len(breaks) else breaks
    starts, ends = np.flatnonzero(flips & inside[1:]), np.flatnonzero(flips & inside[:-1])
    if len(both):
        both = np.unique(both)  # neither a start nor an end so far
        starts, ends = (np.insert(c, np.searchsorted(c, both), both) for c in (starts, ends))
    return starts + lo, ends + lo, np.searchsorted(starts + lo, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and for each text the number of its first word."""
    data, offsets = text_buffer(texts)
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


# Blank, word and other bytes; bytes from 0x80 on belong to letters of some script.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_NO_TERM = _CLASS != 1


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, and for each text the number of its first one.

    A term is a run of ASCII letters, digits and other than ASCII characters; A to Z count as
    a to z, and no other letter is folded.
    """
    data, offsets = text_buffer(texts)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = _LOWER[data[lo:hi]]
    starts, ends, first = word_spans(data, offsets - lo, _NO_TERM)
    return span_hashes(data, starts, ends), first


def token_hashes(texts: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and for each text the number of its first one.

    A token is a run of letters and digits or a run of other visible characters. ``fold``
    makes no difference between upper and lower case of Latin letters up to U+00FF.
    """
    data, offsets = text_buffer(texts)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = data[lo:hi]
    if fold:
        after = np.zeros(hi - lo, bool)
        after[1:] = data[:-1] == 0xC3  # the second byte of U+00C0 to U+00FF
        data = np.where(after & (data < 0x9F) & (data != 0x97), data | 0x20, _LOWER[data])
    kind = _CLASS[data]
    new = np.ones(hi - lo, bool)
    new[1:] = kind[1:] != kind[:-1]
    borders = offsets[:-1] - lo
    new[borders[borders < hi - lo]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], hi - lo) if len(starts) else starts
    seen = kind[starts] > 0
    starts, ends = starts[seen], ends[seen]
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets - lo)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word windows of one text; its whole text if it has fewer words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    up = powers(k + 1)[0]
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * up[j + 1]
    return mix(total + np.uint64(k))


def draws(keys: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each 64-bit key, the same in every run."""
    h = mix(keys.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed * 2 + 1))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
