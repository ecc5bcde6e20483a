"""Passages that repeat across documents: shared seeds, collinear chains, alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, fields
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authscope.llm.text import mix, shingle_hashes, slices, text_buffer, word_hashes, word_spans
from authscope.session import batches_by_rows, cut_lineage, shuffle_width

SEED_WORDS = 5
WINDOW = 5
MARGIN = 64
#: Spans of so many successive minimizers are looked up beside single seeds.
SPANS = (1, 2, 4, 8, 12)
#: A chain may bridge this many words; a bridge costs this much a word, a seed brings its length.
MAX_GAP = 64
GAP_COST = 1 / 16
#: So many chains or words are compared at once, and so many requests for words share one copy of a text.
CHAINS = 2048
BLOCK = 1 << 20
REQUESTS = 4096
_PLACES = np.arange(MARGIN)
#: The lowest n bits, for n up to the margin, whose words are the bits of one number.
_LOW = np.array([(1 << n) - 1 for n in range(MARGIN + 1)], np.uint64)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of every window of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = best(values[:-step], values[step:])
        done += step
    return values


def minimizers(seeds: np.ndarray, window: int) -> np.ndarray:
    """Places of the seeds that are least in some window; any ``window`` seeds in a row have one."""
    if len(seeds) <= window:
        return np.flatnonzero(seeds == seeds.min()) if len(seeds) else np.zeros(0, np.int64)
    least = _sliding(seeds, window, np.minimum)
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, window, np.maximum) == seeds)


FIRST, LATER, NUMBERED = range(3)


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of stretches, one after the other, and which stretch each is of."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return (starts - np.cumsum(sizes) + sizes)[of] + np.arange(len(of)), of


def _all_minimizers(seeds: np.ndarray, first: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """``minimizers`` of stretches of ``seeds`` that lie one after the other: from ``first`` on, as many as ``sizes`` tells."""
    long = np.flatnonzero(sizes > window)
    at = _stretches(first[long], sizes[long] - window + 1)[0]  # where a window starts
    padded = np.zeros(len(seeds) + window - 1, np.uint64)
    padded[at + window - 1] = _sliding(seeds, window, np.minimum)[at] if len(at) else 0
    at = _stretches(first[long], sizes[long])[0]
    found = [at[_sliding(padded, window, np.maximum)[at] == seeds[at]]]
    for n in np.flatnonzero((sizes > 0) & (sizes <= window)).tolist():
        found.append(first[n] + minimizers(seeds[first[n] : first[n] + sizes[n]], window))
    return np.concatenate(found)


def _occurrences(seeds: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each seed how many equal ones of its document come before it."""
    nth, both = np.zeros(len(seeds), np.int64), seeds + mix(doc.astype(np.uint64))
    order = np.argsort(both)
    twin = np.zeros(len(seeds) + 1, bool)
    twin[1:-1] = np.diff(both[order]) == 0
    some = np.sort(order[twin[1:] | twin[:-1]])  # most seeds of a document are there once
    order = some[np.lexsort((seeds[some], doc[some]))]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(seeds[order]) != 0) | (np.diff(doc[order]) != 0)
    nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return nth


def _seeds(batches, k: int, window: int):
    """Seeds of each document; later occurrences of one come also with their number mixed in."""
    for piece in slices(batches):
        words, first = word_hashes(piece.column("text"))
        sizes = np.maximum(0, np.diff(first) - k + 1)
        if not sizes.any():
            continue
        s = shingle_hashes(words, k)  # those of two documents count for none
        at = _all_minimizers(s, first[:-1], sizes, window)
        doc = np.searchsorted(first, at, "right") - 1
        s, at = s[at], at - first[doc]
        nth = _occurrences(s, doc)
        more = np.flatnonzero(nth)
        found = np.concatenate([s, mix(s[more] + nth[more].astype(np.uint64))])
        kinds = np.concatenate([np.where(nth > 0, LATER, FIRST), np.full(len(more), NUMBERED)])
        keys = piece.column("key").take(pa.array(np.concatenate([doc, doc[more]])))
        places = np.concatenate([at, at[more]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), keys, pa.array(places), pa.array(kinds.astype(np.int8))], ["seed", "key", "at", "kind"])


def _spans(batches, k: int, window: int):
    """Spans of successive shared seeds that no document holds as the lowest one of each seed.

    If all seeds of a span meet one document, one after the other, that document has the whole
    span and is its lowest one. This depends on the seeds alone, so a span is left out everywhere
    or nowhere.
    """
    for seed, key, at, ref, y in _groups(batches, ["seed", "key", "at", "ref", "y"], ["key"]):
        order = np.lexsort((at, key))
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(at[order]) != 0)  # repeated rows
        seed, key, at, ref, y = (c[order[new]] for c in (seed, key, at, ref, y))
        gap = at[1:] - at[:-1]
        next_to = (key[1:] == key[:-1]) & (gap <= window)
        held = next_to & (gap <= k) & (ref[1:] == ref[:-1]) & (y[1:] - y[:-1] == gap)
        breaks, parts = (np.concatenate([[0], np.cumsum(~c)]) for c in (next_to, held))
        for n in SPANS:
            if len(key) <= n:
                break
            i = np.flatnonzero((breaks[n:] == breaks[:-n]) & (parts[n:] != parts[:-n]))
            if not len(i):
                continue
            span = np.full(len(i), n, np.uint64)
            for t in range(n + 1):
                span = mix(span + mix(seed[i + t].view(np.uint64) + (at[i + t] - at[i]).astype(np.uint64)))
            columns = (span.view(np.int64), key[i], at[i].astype(np.int32), (at[i + n] - at[i]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["span", "key", "at", "far"])


def _links(x: np.ndarray, y: np.ndarray, starts: np.ndarray, k: int) -> tuple[list[float], list[int]]:
    """For each match its chain's score up to there and the match before it there, or -1.

    Pair n has the matches from ``starts[n]`` on, by x, those with equal x by y descending. A stair holds, of
    the matches so far, the places in y where the largest score plus cost rises: a match up to there that a later
    one with no higher y beats or equals is never taken again.
    """
    ys, costs, score, back = y.tolist(), (GAP_COST * (x + y) / 2).tolist(), [], []
    for first, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        stair, best, at = [inf], [inf], [-1]
        for j in range(first, end):
            place, cost = ys[j], costs[j]
            u = bisect_left(stair, place)
            linked = best[u - 1] - cost if u else 0
            if linked > 0:
                value = k + linked
                back.append(at[u - 1])
            else:
                value = k
                back.append(-1)
            score.append(value)
            value += cost
            if best[u] > value:
                if stair[u] > place:
                    stair.insert(u, place)
                    best.insert(u, value)
                    at.insert(u, j)
                continue
            v = u + 1
            while best[v] <= value:
                v += 1
            if v > u + 1:
                del stair[u + 1 : v], best[u + 1 : v], at[u + 1 : v]
            stair[u], best[u], at[u] = place, value, j
    return score, back


def _all_chains(x: np.ndarray, y: np.ndarray, starts: np.ndarray, k: int, min_seeds: int) -> tuple[np.ndarray, np.ndarray]:
    """``chains`` of many pairs, see ``_links``: the numbers of their matches one after the other, and how many each chain has.

    A match belongs to the best of the chains that lead through it.
    """
    score, back = _links(x, y, starts, k)
    rank = np.empty(len(x), np.int64)
    rank[np.argsort(-np.array(score), kind="stable")] = np.arange(len(x))
    end = rank.tolist()
    for j in range(len(end) - 1, -1, -1):
        i = back[j]
        if i >= 0 and end[j] < end[i]:
            end[i] = end[j]
    end = np.array(end)
    order = np.argsort(end, kind="stable")
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(end[order]) != 0) | (np.diff(x[order]) > MAX_GAP + k) | (np.diff(y[order]) > MAX_GAP + k)
    sizes = np.diff(np.append(np.flatnonzero(new), len(x)))
    return order[np.repeat(sizes >= min_seeds, sizes)], sizes[sizes >= min_seeds]


def chains(x: np.ndarray, y: np.ndarray, k: int = SEED_WORDS, min_seeds: int = 2) -> list[np.ndarray]:
    """Collinear chains of matches at (x, y), each as the numbers of its matches in order.

    A chain's score is the words of its seeds less a cost for each word that it bridges on
    either side. With a linear cost the best predecessor of a match is the largest score plus
    cost so far among the matches before it on both sides, which a stair over y gives.
    Chains come out by score; a match belongs to one, and a gap over the limit ends one.
    """
    order = np.lexsort((-y, x))  # equal x: y descending, so that they do not chain
    found, sizes = _all_chains(x[order], y[order], np.array([0, len(x)]), k, min_seeds)
    return np.split(order[found], np.cumsum(sizes)[:-1]) if len(sizes) else []


def _with_ends(batches):
    """The matches of both ends of each span, and seeds as spans without a length, in order; each one once."""
    for key, ref, x, y, far in _groups(batches, [*_CHAIN, "far"], ["key"]):
        long = np.flatnonzero(far)
        key, ref = (np.concatenate([c, c[long]]) for c in (key, ref))
        x, y = (np.concatenate([c, c[long] + far[long]]) for c in (x, y))
        order = np.lexsort(((x << 32) + y, ref, key))
        key, ref, x, y = (c[order] for c in (key, ref, x, y))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ref[1:] != ref[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(c[new]) for c in (key, ref, x, y)], _CHAIN)


_CHAIN = ["key", "ref", "x", "y"]
_CHAINED = ["key", "ref", "lo", "hi", "rlo", "rhi", "xs", "ys"]


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Successive stretches of 32-bit numbers, as many as ``sizes`` tells, as binaries."""
    offsets = np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int32)
    values = values if values.dtype.itemsize == 4 else values.astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _chained(batches, k: int):
    """Chains of each pair of documents; pairs with one match are passed over at once.

    Matches that all follow each other on one diagonal, without a gap over the limit, are one
    chain: a step costs less than a seed brings. All such pairs are taken together.
    """
    for key, ref, x, y in _groups(batches, _CHAIN, _CHAIN[:2]):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ref[1:] != ref[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        key, ref, x, y = (c[new] for c in (key, ref, x, y))  # a match by a seed and by spans is one
        pair = np.ones(len(key), bool)
        pair[1:] = (key[1:] != key[:-1]) | (ref[1:] != ref[:-1])
        starts = np.append(np.flatnonzero(pair), len(key))
        sizes, step = np.diff(starts), np.diff(x, prepend=0)
        odd = ~pair & ((step != np.diff(y, prepend=0)) | (step > MAX_GAP + k))
        plain = np.add.reduceat(odd, starts[:-1]) == 0
        easy, hard = (sizes > 1) & plain, (sizes > 1) & ~plain
        at, size = np.flatnonzero(np.repeat(easy, sizes)), sizes[easy]
        if hard.any():
            on, of = _stretches(starts[:-1][hard], sizes[hard])
            on = on[np.lexsort((-y[on], x[on], of))]
            found, more = _all_chains(x[on], y[on], np.append(0, np.cumsum(sizes[hard])), k, 2)
            at, size = np.append(at, on[found]), np.append(size, more)
        if len(at):
            u, v = at[np.cumsum(size) - size], at[np.cumsum(size) - 1]
            ends = [pa.array(c) for c in (key[u], ref[u], x[u], x[v] + k, y[u], y[v] + k)]
            yield pa.RecordBatch.from_arrays([*ends, *(_binary(c[at], size) for c in (x, y))], _CHAINED)


def _groups(batches, names, by):
    """Arrays of the columns ``names``; they end where one of the columns ``by`` changes."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(n).to_numpy().astype(np.int64) for n in names]
        last = np.flatnonzero(np.any([now[names.index(n)] != now[names.index(n)][-1] for n in by], axis=0))
        end = int(last[-1]) + 1 if len(last) else 0
        if held and (end or any(now[names.index(n)][0] != held[-1][names.index(n)][0] for n in by)):
            yield [np.concatenate(c) for c in zip(*held, [c[:end] for c in now])]
            held, now = [], [c[end:] for c in now]
        elif end:
            yield [c[:end] for c in now]
            now = [c[end:] for c in now]
        held.append(now)
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _with_texts(batches):
    """The requests, some at a time, with words as 32-bit hashes and the stretch of these that is each one's text.

    A text (role below 0) comes before the requests for it, once however many those are.
    """
    held, held_keys = np.zeros(0, np.uint32), []
    for piece in slices(batches):
        key, role = piece.column("of").to_numpy(), piece.column("role").to_numpy()
        at, asked = np.flatnonzero(role < 0), np.flatnonzero(role >= 0)
        text = np.searchsorted(at, asked, "right") - 1  # -1: of the piece before
        used = np.unique(np.append(text[text >= 0], len(at) - 1)) if len(at) else at
        words, first = word_hashes(piece.column("text").take(pa.array(at[used]))) if len(used) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        words = np.concatenate([held, (words >> np.uint64(32)).astype(np.uint32)])
        first = np.append([0] if held_keys else [], first + len(held)).astype(np.int64)
        keys = np.append(held_keys, key[at[used]]).astype(np.int64) if held_keys else key[at[used]]
        number = np.where(text < 0, 0, np.searchsorted(used, text) + len(held_keys))
        if len(keys):
            fit = keys[number] == key[asked]
            asked, number = asked[fit], number[fit]
            held, held_keys = words[first[-2] :].copy(), [int(keys[-1])]
            if len(asked):
                yield piece.take(pa.array(asked)), words, first[number], first[number + 1]


def _cut_out(batches):
    """The words of each request, with a margin on both sides, as 32-bit hashes."""
    names = ["owner", "ref", "lo", "rlo", "xs", "ys", "role"]
    for rows, words, start, end in _with_texts(batches):
        a = start + np.maximum(0, rows.column("from").to_numpy() - MARGIN)
        b = np.maximum(a, np.minimum(end, start + rows.column("to").to_numpy() + MARGIN))
        own = words.tobytes()
        own = b"".join([own[4 * u : 4 * v] for u, v in zip(a.tolist(), b.tolist())])
        yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), _binary(np.frombuffer(own, np.uint32), b - a)], [*names, "words"])


@dataclass(frozen=True)
class _Chains:
    """Chains with the words on both sides, one after the other in flat arrays.

    ``x`` and ``y`` are the starts and ends of each chain's two stretches in ``words``; ``xs`` and ``ys`` are the places
    of its seeds in these, from ``first`` on.
    """

    words: np.ndarray
    x: tuple[np.ndarray, np.ndarray]
    y: tuple[np.ndarray, np.ndarray]
    xs: np.ndarray
    ys: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, found: list[tuple]) -> _Chains:
        """From a list of (x, y, xs, ys)."""
        ends = np.cumsum([len(v) for c in found for v in c[:2]])
        starts, words = np.append(0, ends[:-1]), np.concatenate([v for c in found for v in c[:2]])
        xs, ys = (np.concatenate([c[n] for c in found]).astype(np.int64) for n in (2, 3))
        first = np.append(0, np.cumsum([len(c[2]) for c in found]))
        return cls(words, (starts[::2], ends[::2]), (starts[1::2], ends[1::2]), xs, ys, first)

    def take(self, which: np.ndarray) -> _Chains:
        sizes = np.diff(self.first)[which]
        at = _stretches(self.first[which], sizes)[0]
        (a, b), (c, d) = self.x, self.y
        return _Chains(self.words, (a[which], b[which]), (c[which], d[which]), self.xs[at], self.ys[at], np.append(0, np.cumsum(sizes)))

    def ends(self) -> tuple[np.ndarray, ...]:
        """Places of the first and of the last seed, in both texts."""
        a, b = self.first[:-1], self.first[1:] - 1
        return self.xs[a], self.ys[a], self.xs[b], self.ys[b]


@dataclass(frozen=True)
class _Pairs:
    """Pairs of stretches of ``MARGIN`` words at most; bit j of ``equal[:, i]``: word i of x is word j of y."""

    x: np.ndarray
    nx: np.ndarray
    y: np.ndarray
    ny: np.ndarray
    equal: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, step: int = 1) -> _Pairs:
        """Stretches of ``words`` from ``x`` and ``y`` on, or back from there."""
        nx, ny = np.minimum(nx, MARGIN), np.minimum(ny, MARGIN)
        u, v = (words.take(s[:, None] + step * _PLACES, mode="clip") for s in (x, y))
        equal = np.empty(u.shape, np.uint64)
        for i in range(0, len(u), 64):  # bits in one row are packed fastest
            same = u[i : i + 64, :, None] == v[i : i + 64, None, :]
            equal[i : i + 64] = np.packbits(same.reshape(-1), bitorder="little").view("<u8").reshape(-1, MARGIN)
        equal[_PLACES >= nx[:, None]] = 0
        equal &= _LOW[ny][:, None]
        return cls(u, nx, v, ny, equal)

    def take(self, which: np.ndarray) -> _Pairs:
        return _Pairs(*(getattr(self, f.name)[which] for f in fields(self)))


def _words_on(equal: np.ndarray, nx: np.ndarray, ny: np.ndarray, cost: int) -> np.ndarray:
    """No more words than this match in a stretch from the start that pays, see ``_reach``.

    No more words match than occur on the other side, and up to its end a stretch must pay.
    """
    columns = np.unpackbits(np.bitwise_or.reduce(equal, axis=1)[:, None].view(np.uint8), axis=1, bitorder="little")
    out = None
    for there, n in ((equal != 0, nx), (columns, ny)):
        count = np.cumsum(there, axis=1, dtype=np.int16)
        pays = (_PLACES < n[:, None]) & ((1 + cost) * count > cost * (_PLACES + 1))
        most = np.where(pays, count, 0).max(axis=1, initial=0)
        out = most if out is None else np.minimum(out, most)
    return out


def _common(equal: np.ndarray) -> np.ndarray:
    """Longest common subsequences: with the first i words of x, bit j tells that word j of y makes one more.

    So the first i and j words have as many in common as bits below j are set in row i. All words of
    a row are done at once, by the carry of a sum.
    """
    rest = np.empty((MARGIN + 1, len(equal)), np.uint64)
    rest[0] = _LOW[-1]
    for i, on in enumerate(np.ascontiguousarray(equal.T)):
        rest[i + 1] = (rest[i] + (rest[i] & on)) | (rest[i] & ~on)
    return ~rest


def _best_ends(more: np.ndarray, cost: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair how many words of x and y the stretch has that pays best, see ``_reach``; the first of the best.

    The longer side makes the cost, and no shorter one has more in common than one as long.
    """
    score = (1 + cost) * np.bitwise_count(more & _LOW[:, None]).astype(np.int32) - cost * np.arange(MARGIN + 1)[:, None]
    at, pair = np.nonzero(score == score.max(axis=0))
    own = more[at, pair] & _LOW[at]
    n = np.bitwise_count(own)
    i = (np.bitwise_count(more[:, pair] & _LOW[at]) == n).argmax(axis=0)
    j = np.where(i < at, at, (np.bitwise_count(own & _LOW[:, None]) == n).argmax(axis=0))
    order = np.lexsort((j, i, pair))
    first = order[np.searchsorted(pair[order], np.arange(more.shape[1]))]
    return i[first], j[first]


def _traced(equal: np.ndarray, more: np.ndarray, i: np.ndarray, j: np.ndarray, whole: bool = True) -> np.ndarray:
    """Matches of a longest common subsequence of the first ``i`` and ``j`` words, or its last one: rows pair, place in x, place in y."""
    left = np.bitwise_count(more[i, np.arange(len(i))] & _LOW[j]).astype(np.int64)
    u = np.flatnonzero(left)
    p, q, left, out = i[u], j[u], left[u], ([u[:0]], [u[:0]], [u[:0]])
    while len(u):
        p = p - 1
        on = equal[u, p] & _LOW[q]
        # The number of the highest bit, from 1: as a float a number without bits side by side is not rounded beyond it.
        last = np.frexp((on & ~(on >> np.uint64(1))).astype(np.float64))[1]
        hit = (last == q) | (np.bitwise_count(more[p, u] & _LOW[q]) != left)  # else the words before have as many in common
        for c, found in zip(out, (u, p, last - 1)):
            c.append(found[hit])
        q, left = np.where(hit, last - 1, q), left - (hit if whole else hit * left)
        if not left.all():
            on = left > 0
            u, p, q, left = u[on], p[on], q[on], left[on]
    return np.stack([np.concatenate(c) for c in out])


def _best(pairs: _Pairs, cost: int) -> tuple[np.ndarray, ...]:
    """The equal start of each pair; of those that go on after it which they are, equal words, ``_common`` and ``_best_ends`` there.

    An unmatched word on the longer side costs ``cost`` matches; words may be added, left out or
    replaced. After the equal start, stretches that cannot pay are not searched.
    """
    here = _PLACES < np.minimum(pairs.nx, pairs.ny)[:, None]
    run = np.logical_and.accumulate((pairs.x == pairs.y) & here, axis=1).sum(axis=1)
    rest = np.flatnonzero((pairs.nx > run) & (pairs.ny > run))
    at = _PLACES + run[rest, None]
    equal = np.where(at < MARGIN, pairs.equal[rest[:, None], np.minimum(at, MARGIN - 1)], np.uint64(0))
    equal >>= run[rest, None].astype(np.uint64)
    alive = _words_on(equal, pairs.nx[rest] - run[rest], pairs.ny[rest] - run[rest], cost) > 0
    rest, equal = rest[alive], equal[alive]
    more = _common(equal)
    return run, rest, equal, more, *_best_ends(more, cost)


def _reach(pairs: _Pairs, cost: int) -> np.ndarray:
    """The matches of the stretches from the start that pay best, see ``_best``: rows pair, place in x, place in y."""
    run, rest, *best = _best(pairs, cost)
    place, of = _stretches(np.zeros(len(run), np.int64), run)
    u, p, q = _traced(*best)
    return np.concatenate([[of, place, place], [rest[u], p + run[rest[u]], q + run[rest[u]]]], axis=1)


def _reached(pairs: _Pairs, cost: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many matches ``_reach`` has for each pair, and the last one's place in x and in y, or -1."""
    run, rest, equal, more, i, j = _best(pairs, cost)
    count, x, y = run.astype(np.int64), run - 1, run - 1
    count[rest] += np.bitwise_count(more[i, np.arange(len(i))] & _LOW[j])
    u, p, q = _traced(equal, more, i, j, whole=False)
    x[rest[u]], y[rest[u]] = p + run[rest[u]], q + run[rest[u]]
    return count, x, y


def _before(found: _Chains) -> _Pairs:
    """The words before a chain, backwards, on both sides."""
    a, b, _, _ = found.ends()
    return _Pairs.of(found.words, found.x[0] + a - 1, a, found.y[0] + b - 1, b, -1)


def _after(found: _Chains, k: int) -> _Pairs:
    """The words after a chain on both sides."""
    _, _, c, d = found.ends()
    x, y = found.x[0] + c + k, found.y[0] + d + k
    return _Pairs.of(found.words, x, found.x[1] - x, y, found.y[1] - y)


def _within(found: _Chains, k: int, count: bool = False) -> np.ndarray:
    """Matched words from the first seed of each chain to the end of its last one: rows chain, place in x, place in y; or how many."""
    xs, ys, chain = found.xs, found.ys, np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    step = np.diff(xs)
    new = np.ones(len(xs), bool)
    new[1:] = (chain[1:] != chain[:-1]) | (step != np.diff(ys)) | (step > k)  # else a seed goes on with the one before
    u = np.flatnonzero(new)
    v = np.append(u[1:], len(xs)) - 1
    p, q, end, ref_end, own = xs[u], ys[u], xs[v] + k, ys[v] + k, chain[u]
    later = np.flatnonzero(own[1:] == own[:-1]) + 1
    a, b = end[later - 1], ref_end[later - 1]  # matched up to here
    skip = np.maximum(0, np.maximum(a - p[later], b - q[later]))  # seeds may overlap, by less than one as both places rise
    p[later] += skip
    q[later] += skip
    if count:
        total = np.zeros(len(found.first) - 1, np.int64)
        np.add.at(total, own, end - p)
    else:
        at, of = _stretches(p, end - p)
        out = [np.stack([own[of], at, at + (q - p)[of]])]
    m, n = p[later] - a, q[later] - b
    gap = np.flatnonzero((m > 0) & (n > 0))
    if len(gap):
        a, b, m, n, own = a[gap], b[gap], m[gap], n[gap], own[later[gap]]
        x, y = found.x[0][own] + a, found.y[0][own] + b
        # Where half of the words and more are equal place by place, so are they matched.
        u, v = (found.words.take(s[:, None] + _PLACES, mode="clip") for s in (x, y))
        same = (u == v) & (_PLACES < np.minimum(m, n)[:, None])
        plain = (m == n) & (2 * same.sum(axis=1) >= m)
        if count:
            np.add.at(total, own[plain], same[plain].sum(axis=1))
        else:
            on, at = np.nonzero(same & plain[:, None])
            out.append(np.stack([own[on], a[on] + at, b[on] + at]))
        a, b, m, n, own, x, y = (c[~plain] for c in (a, b, m, n, own, x, y))
        equal = _Pairs.of(found.words, x + m - 1, m, y + n - 1, n, -1).equal
        more = _common(equal)
        if count:
            np.add.at(total, own, np.bitwise_count(more[m, np.arange(len(m))] & _LOW[n]))
        else:
            u, p, q = _traced(equal, more, m, n)
            out.append(np.stack([own[u], (a + m - 1)[u] - p, (b + n - 1)[u] - q]))
    return total if count else np.concatenate(out, axis=1)


def _align(found: _Chains, sides: Sequence[_Pairs], k: int, cost: int) -> tuple[np.ndarray, np.ndarray]:
    """Matched words of the chains as rows (place in x, place in y), and where each chain's rows start."""
    a, b, c, d = found.ends()
    (u, p, q), (v, s, t) = (_reach(side, cost) for side in sides)
    chain, x, y = np.concatenate([[u, a[u] - 1 - p, b[u] - 1 - q], _within(found, k), [v, c[v] + k + s, d[v] + k + t]], axis=1)
    order = np.argsort((chain << 32) + x, kind="stable")
    first = np.append(0, np.cumsum(np.bincount(chain, minlength=len(a))))
    return np.stack([x, y], 1)[order], first


def align(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int = SEED_WORDS, cost: int = 2) -> np.ndarray:
    """Matched words of two texts along a chain of seeds, as rows (place in x, place in y).

    ``MARGIN`` words at most are reached on both sides, and bridged between two seeds.
    """
    found = _Chains.of([(x, y, xs, ys)])
    return _align(found, [_before(found), _after(found, k)], k, cost)[0]


def _may_reach(found: _Chains, k: int, words: float, cost: int = 1) -> tuple[np.ndarray, list[_Pairs]]:
    """Which chains may come to so many matched words, with ``cost`` or more for an unmatched one, and what is around these."""
    a, b, c, d = found.ends()
    most = np.minimum(c - a, d - b) + k
    before = _before(found)
    most += _words_on(before.equal, before.nx, before.ny, cost)
    may = np.flatnonzero(most + MARGIN >= words)
    after = _after(found.take(may), k)
    held = most[may] + _words_on(after.equal, after.nx, after.ny, cost) >= words
    return may[held], [before.take(may[held]), after.take(held)]


def _may_hold(found: list[tuple], k: int, words: float, cost: int = 1) -> np.ndarray:
    """Whether each (x, y, xs, ys) may come to so many matched words."""
    return np.isin(np.arange(len(found)), _may_reach(_Chains.of(found), k, words, cost)[0])


def fuzzy_parts(matched: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int, int, int, float]]:
    """Stretches of an alignment with enough words and enough of them equal.

    From one with too few equal words the longest good stretch is taken, then the rest is
    searched; without a good one it is parted at its widest gap.
    """
    out, open_ = [], [(0, len(matched))]
    while open_:
        a, b = open_.pop()
        if a >= b:
            continue
        (p, q), (r, s) = matched[a], matched[b - 1]
        length = max(r - p, s - q) + 1
        if length < min_words:
            continue
        share = (b - a) / length
        if share >= identity:
            out.append((int(p), int(r) + 1, int(q), int(s) + 1, float(share)))
            continue
        steps = np.diff(matched[a:b], axis=0).max(axis=1)
        level = np.arange(b - a) - identity * np.concatenate([[0], np.cumsum(steps)])
        # Good is a stretch u..v with level[u] <= level[v] + 1 - identity; take the first such u.
        low = np.minimum.accumulate(level)
        u = np.searchsorted(-low, -(level + 1 - identity + 1e-9))
        v = int(np.argmax(np.arange(b - a) - u))
        u = int(u[v])
        if a + u < a + v and (matched[a + v] - matched[a + u]).max() + 1 >= min_words:
            open_ += [(a, a + u), (a + u, a + v + 1), (a + v + 1, b)]
            continue
        cut = a + 1 + int(np.argmax(steps))
        open_ += [(a, cut), (cut, b)]
    return sorted(out)


_PASSAGE = ["key", "start_word", "end_word", "ref", "ref_start_word", "ref_end_word", "identity"]


def _parts(matched: np.ndarray, first: np.ndarray, min_words: int, identity: float) -> list[np.ndarray]:
    """``fuzzy_parts`` of alignments one after the other: the alignment and the columns of its parts."""
    (p, q), (r, s) = matched[first[:-1]].T, matched[first[1:] - 1].T
    length = np.maximum(r - p, s - q) + 1
    share = np.diff(first) / length
    whole = np.flatnonzero((length >= min_words) & (share >= identity))
    out = [whole, p[whole], r[whole] + 1, q[whole], s[whole] + 1, share[whole]]
    rows = []
    for n in np.flatnonzero((length >= min_words) & (share < identity)).tolist():
        rows += [(n, *part) for part in fuzzy_parts(matched[first[n] : first[n + 1]], min_words, identity)]
    return [np.concatenate(c) for c in zip(out, zip(*rows))] if rows else out


def _numbers(values: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of successive binaries, and where those of each one start."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) // 4
    data = values.buffers()[2]
    return (np.frombuffer(data, kind, int(offsets[-1])) if offsets[-1] else np.zeros(0, kind)), offsets


def _met(batches, k: int):
    """Chains with the words on both sides, some at a time: (owner, its first word here, ref, its first word here), chains.

    Rows of a chain come together: the document's words, then those of the earlier one.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        held = batch.slice(batch.num_rows - 1)  # its other half may be in the next batch
        owner, ref, lo, rlo, role = (batch.column(n).to_numpy() for n in ("owner", "ref", "lo", "rlo", "role"))
        words, at = _numbers(batch.column("words"), np.uint32)
        (xs, first), (ys, _) = (_numbers(batch.column(n), np.int32) for n in ("xs", "ys"))
        pair = (role[:-1] == 0) & (role[1:] == 1)
        for c in (owner, ref, lo, rlo):
            pair &= c[1:] == c[:-1]
        on = np.flatnonzero(pair) + 1
        x0, y0 = np.maximum(0, lo - MARGIN), np.maximum(0, rlo - MARGIN)
        last = first[on + 1] - 1
        on = on[(xs[last] - x0[on] + k <= at[on] - at[on - 1]) & (ys[last] - y0[on] + k <= at[on + 1] - at[on])]
        size = np.cumsum(at[on + 1] - at[on - 1] + BLOCK // CHAINS) // BLOCK
        for u in np.split(on, np.flatnonzero(np.diff(size)) + 1):
            if len(u):
                place, of = _stretches(first[u], first[u + 1] - first[u])
                found = _Chains(
                    words, (at[u - 1], at[u]), (at[u], at[u + 1]), xs[place] - x0[u][of], ys[place] - y0[u][of], np.append(0, np.cumsum(np.bincount(of)))
                )
                yield (owner[u], x0[u], ref[u], y0[u]), found


def _passed(found: _Chains, within: np.ndarray, sides: Sequence[_Pairs], k: int, cost: int, min_words: int, identity: float) -> list[np.ndarray]:
    """``_parts`` of the chains' alignments. Ends and counts tell of most that they pass as a whole or not at all; only the others are traced."""
    a, b, c, d = found.ends()
    (before, p, q), (after, r, s) = (_reached(side, cost) for side in sides)
    start, ref_start, end, ref_end = a - 1 - p, b - 1 - q, c + k + r + 1, d + k + s + 1
    length = np.maximum(end - start, ref_end - ref_start)
    share = (before + within + after) / length
    whole = np.flatnonzero((length >= min_words) & (share >= identity))
    out = [whole, start[whole], end[whole], ref_start[whole], ref_end[whole], share[whole]]
    some = np.flatnonzero((length >= min_words) & (share < identity))
    if not len(some):
        return out
    own, *rest = _parts(*_align(found.take(some), [side.take(some) for side in sides], k, cost), min_words, identity)
    return [np.concatenate(c) for c in zip(out, [some[own], *rest])]


def _aligned(batches, k: int, min_words: int, identity: float):
    """The passages of the chains. Most chains cannot reach far enough and are not aligned at all."""
    for ids, found in _met(batches, k):
        may, sides = _may_reach(found, k, min_words * identity - 1e-6)
        if not len(may):
            continue
        ids, found = [c[may] for c in ids], found.take(may)
        within = _within(found, k, count=True)
        # An edit near an end may take a passage under the limit: reach further, if it is short.
        for cost in (2, 1):
            own, a, b, c, d, share = _passed(found, within, sides, k, cost, min_words, identity)
            owner, x0, ref, y0 = (v[own] for v in ids)
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (owner, x0 + a, x0 + b, ref, y0 + c, y0 + d, share)], _PASSAGE)
            may = np.setdiff1d(np.arange(len(within)), own)
            if not len(may):
                break
            ids, found, within, sides = [c[may] for c in ids], found.take(may), within[may], [side.take(may) for side in sides]


def _clashing(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Keys that stand for different texts, with the least digest of those; seldom any."""
    own = F.col(key).cast("long")
    twice = cut_lineage(rows.where(own.isNotNull()).groupBy(own.alias("twice")).count().where("count > 1").select("twice"))
    if twice.isEmpty():  # no text is read
        return twice.withColumn("low", F.lit(""))
    of = F.md5(F.coalesce(text, F.lit("")))
    both = rows.join(twice.hint("merge"), own == F.col("twice")).groupBy("twice")
    return cut_lineage(both.agg(F.min(of).alias("low"), F.max(of).alias("high")).where("low <> high").select("twice", "low"))


def _told_apart(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``rows`` with ``searched``: whether a row's text is the one that its key stands for here."""
    clashing = _clashing(rows, key, text)
    if clashing.isEmpty():
        return rows.withColumn("searched", F.lit(True))
    held = rows.join(clashing.hint("merge"), F.col(key) == F.col("twice"), "left")
    return held.withColumn("searched", F.col("low").isNull() | (F.col("low") == F.md5(F.coalesce(text, F.lit(""))))).drop("twice", "low")


def _requested(rows: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """The words of each request beside it.

    A low document may be asked for by a large share of all others. A text is therefore not repeated for
    each request: it comes before its requests, and one with more than ``REQUESTS`` of them goes
    to several places, which share these.
    """
    counts = asked.groupBy("of").agg(F.ceil(F.count(F.lit(1)) / REQUESTS).alias("places"))
    often = F.broadcast(cut_lineage(counts.where("places > 1")))  # one in REQUESTS at most
    places, whole = F.coalesce("places", F.lit(1).cast("long")), "long"
    texts = rows.withColumnRenamed("key", "of").join(often, "of", "left").select(
        "of", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("place"), "text", F.lit(-1).alias("role"),
        *[F.lit(None).cast(whole).alias(n) for n in ("owner", "ref", "lo", "rlo", "from", "to")],
        *[F.lit(None).cast("binary").alias(n) for n in ("xs", "ys")],
    )
    seeds = [F.when(F.col("role") == 1, F.col(n)).alias(n) for n in ("xs", "ys")]  # once a chain is enough
    requests = asked.join(often, "of", "left").select(
        "of", F.pmod(F.xxhash64("owner", "ref", "own_lo", "rlo"), places).alias("place"), F.lit(None).cast("string").alias("text"),
        "role", "owner", "ref", F.col("own_lo").alias("lo"), "rlo", "from", "to", *seeds,
    )
    return (
        texts.unionByName(requests)
        .repartition(width, "of", "place")
        .sortWithinPartitions("of", "place", "role")
        .mapInArrow(_cut_out, "owner long, ref long, lo long, rlo long, xs binary, ys binary, role int, words binary")
    )


def repeated_passages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_words: int = 50,
    identity: float = 0.8,
    k: int = SEED_WORDS,
    window: int = WINDOW,
) -> DataFrame:
    """Passages of a document that an earlier one (with a lower ``key``) has as well.

    A row for each passage: key, start_word, end_word, ref_<key>, ref_start_word,
    ref_end_word, identity. Words count from 0, ends are exclusive; a passage has
    ``min_words`` or more, of which a share of ``identity`` is equal and in the same order.

    Seeds are ``k``-word windows, thinned to the least one in any ``window`` of them, so two
    equal stretches of k + 2 * window words or more share at least two. A seed is joined with its
    occurrence in the lowest document alone, so a passage in n documents gives n - 1 matches a
    seed and not all pairs. All occurrences in a document meet the first one there, and the second one
    meets the second one as well, and so on.
    Where the seeds of a passage have different lowest documents, spans of 2 to 13 successive
    seeds are joined with their own lowest document, so that parts held by other documents do
    not hide one that has the whole; it can be missed only if lower documents together hold every
    such span in parts of less than ``min_words``. The matches of two documents are chained with
    gap costs; chains are aligned word by word within a margin around them.

    Rows with equal keys and texts are one document; of different texts under one key the one with
    the least md5 digest is searched, the others are left alone. A row with a null key is not searched.
    Of chains with equal scores the one that ends first comes first. Texts of any length are searched whole. A
    null, empty or shorter text has no passage; so has a passage that repeats only within its
    own document. Equal texts give the whole text as a passage of all but the lowest. No rows
    give no rows. Only the key and the text are read.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = _told_apart(rows, "key", "text").where("searched").drop("searched")
    seeds = rows.mapInArrow(lambda b: _seeds(b, k, window), "seed long, key long, at int, kind byte")
    # One deal by seed for its lowest document and for its rows: most seeds are of one document alone.
    seeds = seeds.select("seed", "key", (F.col("at") * 4 + F.col("kind")).alias("place"))  # a column less to deal
    same, kind = W.partitionBy("seed"), F.col("place").bitwiseAND(3)
    first = F.min_by("place", F.when(kind != LATER, F.col("key")))
    met = seeds.withColumns({"ref": F.min("key").over(same), "top": F.max("key").over(same), "y": first.over(same)}).where("ref < top")
    shared = cut_lineage(met.select("seed", "key", F.shiftright("place", 2).alias("at"), kind.alias("kind"), "ref", F.shiftright("y", 2).alias("y")))
    width = shuffle_width(docs.sparkSession)
    spans = (
        shared.where(F.col("kind") != NUMBERED)
        .repartition(width, "key")
        .sortWithinPartitions("key")  # one number is sorted without comparisons
        .mapInArrow(lambda b: _spans(b, k, window), "span long, key long, at int, far int")
    )
    with batches_by_rows(docs.sparkSession):
        spans = cut_lineage(spans)
    whole = spans.groupBy("span").agg(F.min(F.struct("key", "at")).alias("low"), F.max("key").alias("top")).where("low.key < top")
    whole = cut_lineage(whole.select("span", F.col("low.key").alias("ref"), F.col("low.at").alias("y")))
    found = spans.join(whole.hint("merge"), "span").where("key > ref").select("key", "ref", "at", "y", "far")
    matches = shared.where("key > ref").select("key", "ref", F.col("at").alias("x"), "y", F.lit(0).alias("far")).union(found)
    chained = (
        matches.repartition(width, "key")  # no more rows than the document has seeds and spans
        .sortWithinPartitions("key")
        .mapInArrow(lambda b: _chained(_with_ends(b), k), "key long, ref long, lo long, hi long, rlo long, rhi long, xs binary, ys binary")
    )
    with batches_by_rows(docs.sparkSession):
        chained = cut_lineage(chained)
    both = F.inline(
        F.array(
            F.struct(F.col("key").alias("of"), F.lit(0).alias("role"), F.col("lo").alias("from"), F.col("hi").alias("to")),
            F.struct(F.col("ref").alias("of"), F.lit(1).alias("role"), F.col("rlo").alias("from"), F.col("rhi").alias("to")),
        )
    )
    asked = chained.select(F.col("key").alias("owner"), "ref", F.col("lo").alias("own_lo"), "rlo", "xs", "ys", both)
    parts = _requested(rows, asked, width)
    found = (
        parts.repartition(width, "owner", "ref", "lo", "rlo")
        .sortWithinPartitions("owner", "ref", "lo", "rlo", "role")
        .mapInArrow(lambda b: _aligned(b, k, min_words, identity), ", ".join(f"{n} {'double' if n == 'identity' else 'long'}" for n in _PASSAGE))
    )
    return found.select(
        F.col("key").alias(key), "start_word", "end_word", F.col("ref").alias(f"ref_{key}"), "ref_start_word", "ref_end_word", "identity"
    )


def _without(batches):
    """Texts without the words of their spans and the white space after them."""
    for piece in slices(batches):
        data, offsets = text_buffer(piece.column("text"))
        starts, ends, first = word_spans(data, offsets)
        texts = []
        for i, (text, spans) in enumerate(zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist())):
            if not spans:
                texts.append(text)
                continue
            s, raw, at, kept = starts[first[i] : first[i + 1]] - offsets[i], text.encode(), 0, []
            for span in sorted((p["start_word"], p["end_word"]) for p in spans):
                a, b = int(s[span[0]]), int(s[span[1]]) if span[1] < len(s) else len(raw)
                if a > at:
                    kept.append(raw[at:a])
                at = max(at, b)
            texts.append(b"".join([*kept, raw[at:]]).decode())
        names = [n for n in piece.schema.names if n not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])


def cut_passages(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the passages cut out of their texts; all columns stay.

    A row without passages stays as it is; one that is nothing else has an empty text. Of rows with
    one key and different texts only those with the searched text (see ``repeated_passages``) are cut.
    """
    spans = passages.select(F.col(key).alias("_key"), F.struct("start_word", "end_word").alias("span"))
    spans = spans.groupBy("_key").agg(F.collect_set("span").alias("spans"))  # bounded by a text's length
    rest = [n for n in docs.columns if n != text]
    # Other columns travel in one struct, so that none can clash with the names used here.
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text"), F.struct(*rest).alias("rest"))
    rows = _told_apart(rows, "_id", "text")
    held = rows.join(spans.hint("merge"), rows["_id"] == spans["_key"], "left")
    held = held.select("rest", F.when(F.col("searched"), F.col("spans")).alias("spans"), "text")
    cut = held.mapInArrow(_without, f"rest {rows.schema['rest'].dataType.simpleString()}, text string")
    return cut.select(*(F.col("text").alias(text) if n == text else F.col(f"rest.`{n}`").alias(n) for n in docs.columns))
