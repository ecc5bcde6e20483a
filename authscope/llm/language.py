"""Languages of texts and of their spans: scripts, word scores and a Viterbi path."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.llm.text import mix, slices, span_hashes

BUCKETS = 1 << 15
#: Documents of one language that the scores are learned from, in expectation.
DOCUMENTS = 4_000
SEED = 31
#: A word's score below the best language's counts as this much at most.
WORST = -6.0
SWITCH = 10.0
KEPT = 250_000
#: First and last code points of blocks of letters (fixed values of the Unicode standard).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_NAMES = [*SCRIPTS, "other"]
_RANGES = sorted((a, b, n) for n, name in enumerate(SCRIPTS) for a, b in SCRIPTS[name])
_FIRST, _LAST, _NUMBER = (np.array(c) for c in zip(*_RANGES))


def scripts_of(letters: str) -> np.ndarray:
    """Numbers of the scripts whose ranges hold the letters; the last one is any other script."""
    codes = np.frombuffer(letters.encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.searchsorted(_FIRST, codes, "right") - 1
    return np.where((at >= 0) & (codes <= _LAST[at]), _NUMBER[at], len(_NAMES) - 1)


def letters_of(word: str) -> str:
    low = word.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


class Grams:
    """Buckets of the n-grams of many words at once, borders included.

    A word gives itself and each run of two or three of its characters between two marks.
    ``pairs`` and ``triples`` have one bucket a place, valid where ``in2`` and ``in3`` hold.
    """

    def __init__(self, words: list[str]) -> None:
        codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        ends = np.cumsum(sizes)
        self.starts, self.sizes = ends - sizes, sizes
        c = np.concatenate([codes, np.zeros(2, np.uint32)]).astype(np.uint64)
        two = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two + c[2:] * np.uint64(0x165667B19E3779F9)
        left = np.repeat(ends, sizes) - np.arange(len(codes))  # places up to the word's end
        self.in2, self.in3 = left >= 2, left >= 3
        self.pairs, self.triples, self.whole = (
            (h >> np.uint64(32)).astype(np.int64) % BUCKETS for h in (mix(two), mix(three), span_hashes(codes, self.starts, ends))
        )

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """Count of each bucket, every word taken ``weights`` times."""
        each = np.repeat(weights, self.sizes)
        out = np.bincount(self.whole, weights=weights, minlength=BUCKETS)
        out += np.bincount(self.pairs[self.in2], weights=each[self.in2], minlength=BUCKETS)
        out += np.bincount(self.triples[self.in3], weights=each[self.in3], minlength=BUCKETS)
        return out.astype(np.int64)

    def sums(self, logs: np.ndarray) -> np.ndarray:
        """For each word, the sum of a table's rows over its n-grams."""
        out = np.empty((len(self.starts), logs.shape[1]), np.float32)
        for l in range(logs.shape[1]):
            column = logs[:, l]
            at = np.where(self.in2, column[self.pairs], 0) + np.where(self.in3, column[self.triples], 0)
            out[:, l] = np.add.reduceat(at, self.starts) + column[self.whole]
        return out


def _counts(batches):
    """Counts of one partition by language: n-grams, and letters by script (below 0)."""
    words: dict[str, Counter] = {}
    found: dict[str, np.ndarray] = {}

    def fold(lang: str) -> None:
        out = found.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
        some = [(letters, n) for word, n in words.pop(lang).items() if (letters := letters_of(word))]
        if some:
            parts, n = zip(*some)
            out[:BUCKETS] += Grams(parts).counts(np.array(n, np.int64))
            written = np.array([k * len(letters) for letters, k in some], np.int64)
            np.add.at(out, BUCKETS + scripts_of("".join(p[0] for p in parts)), written)

    for piece in slices(batches):
        for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
            seen = words.setdefault(lang, Counter())
            seen.update((text or "").split())
            if len(seen) > KEPT:
                fold(lang)
    for lang in list(words):
        fold(lang)
    for lang, n in found.items():
        at = np.flatnonzero(n)
        place = np.where(at < BUCKETS, at, BUCKETS - 1 - at)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(place), pa.array(n[at])], ["lang", "place", "n"])


class Model:
    """Log chances of n-grams by language, and the languages that write in each script."""

    def __init__(self, langs: list[str], grams: np.ndarray, letters: np.ndarray) -> None:
        self.langs = langs
        n = grams + 0.5
        self.logs = np.log(n / n.sum(axis=0)).astype(np.float32) if langs else grams.astype(np.float32)
        share = letters / np.maximum(1, letters.sum(axis=0))
        self.writes = share >= 0.01
        self.writes[~self.writes.any(axis=1)] = True  # a script not seen: any language


def learn(docs: DataFrame, fold: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", documents: int = DOCUMENTS) -> Model:
    """Counts over about ``documents`` texts of each language in ``fold``, drawn by a hash of the key."""
    rows = docs.where(fold & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = dict(rows.groupBy(F.col(lang).cast("string")).count().collect())  # a row a language
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(_NAMES), 0)))
    limits = F.create_map(*(F.lit(v) for l, n in sizes.items() for v in (l, int(min(1.0, documents / n) * 1_000_000))))
    drawn = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1_000_000)) < limits[F.col(lang).cast("string")])
    counts = drawn.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(_counts, "lang string, place long, n long")
    found = counts.groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets
    langs = sorted(sizes)
    column = found["lang"].map({l: i for i, l in enumerate(langs)}).to_numpy(np.int64)
    grams, letters = np.zeros((BUCKETS, len(langs))), np.zeros((len(_NAMES), len(langs)))
    place, n = found["place"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    grams[place[place >= 0], column[place >= 0]] = n[place >= 0]
    letters[-1 - place[place < 0], column[place < 0]] = n[place < 0]
    return Model(langs, grams, letters)


_SCORES: dict[bytes, "WordScores"] = {}


def _word_scores(model: Model) -> "WordScores":
    """What a worker keeps for a model from one task to the next; one model at a time."""
    name = hashlib.blake2b(model.logs.tobytes() + model.writes.tobytes() + repr(model.langs).encode()).digest()
    if name not in _SCORES:
        _SCORES.clear()
        _SCORES[name] = WordScores(model)
    return _SCORES[name]


class WordScores(dict):
    """Number of each word met; with its score for every language and its count of letters."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)
        self.letters = np.zeros(0, np.int32)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, and where each text's ones begin."""
        if len(self) > KEPT:
            self.forget()
        numbers = [list(map(self.__getitem__, t.split())) for t in texts]
        first = np.concatenate([[0], np.cumsum([len(n) for n in numbers])]).astype(np.int64)
        self._score_fresh()
        return np.fromiter(chain.from_iterable(numbers), np.int64, int(first[-1])), first

    def _score_fresh(self) -> None:
        if not self.fresh:
            return
        letters = [letters_of(w) for w in self.fresh]
        scores = np.zeros((len(letters), len(self.model.langs)), np.float32)
        some = [i for i, word in enumerate(letters) if word]
        if some and self.model.langs:
            sums = Grams([letters[i] for i in some]).sums(self.model.logs)
            allowed = self.model.writes[scripts_of("".join(letters[i][0] for i in some))]
            best = np.where(allowed, sums, -np.inf).max(axis=1, keepdims=True)
            scores[some] = np.where(allowed, np.clip(sums - best, WORST, 0), WORST)
        self.scores = np.concatenate([self.scores, scores])
        self.letters = np.concatenate([self.letters, np.array([len(w) for w in letters], np.int32)])
        self.fresh = []


def _steady(scores: np.ndarray, first: np.ndarray, best: np.ndarray, switch: float) -> np.ndarray:
    """Texts in which no stretch of words gains half of ``switch`` by another language than ``best``.

    There the best path is that language throughout, as k changes make k + 1 stretches. The
    largest gain of a stretch is the largest rise of the running sum; the sums of later texts are shifted down, so that a rise
    never starts in an earlier text.
    """
    sizes = np.diff(first)
    own = np.repeat(best, sizes)
    rows = np.arange(len(scores))
    drop = -2.0 * WORST * (sizes.max() + 1) if len(sizes) else 0.0
    shift = np.repeat(np.arange(len(sizes)) * drop, sizes)
    steady = np.ones(len(sizes), bool)
    full = np.flatnonzero(sizes)
    for l in range(scores.shape[1]):
        gain = scores[:, l].astype(np.float64) - scores[rows, own]
        total = np.cumsum(gain)
        before = np.concatenate([[0.0], total])[np.repeat(first[:-1], sizes)]
        total = total - before - shift
        low = np.minimum.accumulate(np.minimum(total - gain, np.inf))
        steady[full] &= np.maximum.reduceat(total - low, first[:-1][full]) < switch / 2
    return steady


def best_paths(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on its text's best path.

    A path has the sum of its words' scores less ``switch`` for each change of language. Texts
    go side by side, word by word; those that surely keep one language are settled before.
    """
    sizes = np.diff(first)
    sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
    best = (sums[first[1:]] - sums[first[:-1]]).argmax(axis=1)
    path = np.repeat(best, sizes)
    open_ = np.flatnonzero(~_steady(scores, first, best, switch))
    if not len(open_):
        return path
    open_ = open_[np.argsort(-sizes[open_], kind="stable")]
    begin, length = first[open_], sizes[open_]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # texts that have a word number t
    value = scores[begin].astype(np.float64)
    came: list[np.ndarray] = []
    each = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(1, length[0]):
        n = active[t]
        top = value[:n].argmax(axis=1)
        other = value[np.arange(n), top][:, None] - switch
        change = other > value[:n]
        came.append(np.where(change, top[:, None], each).astype(np.int16))
        value[:n] = np.maximum(value[:n], other) + scores[begin[:n] + t]
    state = value.argmax(axis=1)
    for t in range(length[0] - 1, -1, -1):
        n = active[t]
        path[begin[:n] + t] = state[:n]
        if t:
            state[:n] = came[t - 1][np.arange(n), state[:n]]
    return path


_SPANS = pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())]))


def label(texts: list[str], words: WordScores) -> tuple[list[str], list[float], list[list[dict]]]:
    """Main language, its score and the spans of each text."""
    model = words.model
    numbers, first = words.of(texts)
    letters = words.letters[numbers]
    total = np.concatenate([[0], np.cumsum(letters)])
    some = (total[first[1:]] - total[first[:-1]]) > 0
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    scores = words.scores[numbers]
    path = best_paths(scores, first) if len(numbers) else np.zeros(0, np.int64)
    sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(scores, axis=0, dtype=np.float64)])
    langs, sure, spans = [], [], []
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if not some[i]:
            langs.append("und")
            sure.append(0.0)
            spans.append([])
            continue
        share = np.bincount(path[a:b], weights=letters[a:b], minlength=len(model.langs))
        main = int(share.argmax())
        evidence = sums[b] - sums[a]
        chance = 1 / np.exp(np.clip(evidence - evidence[main], -50, 50)).sum()
        langs.append(model.langs[main])
        sure.append(float(min(1.0, share[main] / share.sum() * max(chance, 1 / len(model.langs)))))
        cuts = [0, *(np.flatnonzero(np.diff(path[a:b])) + 1).tolist(), b - a]
        spans.append([{"start_word": p, "end_word": q, "lang": model.langs[int(path[a + p])]} for p, q in zip(cuts[:-1], cuts[1:])])
    return langs, sure, spans


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """A row (key, held_out, lang_pred, score, spans) for each row of ``docs``.

    Words are the runs between white space. The range of a word's first letter gives its
    script, and only languages that write in it are candidates; its n-grams give a score for
    each. The best path through a text's words, where a change of language costs ``SWITCH``,
    gives its spans; the language with most letters on it is the prediction, and the score is
    its share of the letters times its chance against the other languages over all words.

    The rows whose crc32(key as text) modulo ``folds`` is ``held`` are held out of learning, as
    are rows with a null language or text. A text that is null or has no letter is ``und``
    with score 0 and no span; so is every text if nothing can be learned. A null key is not
    held out. Equal texts get equal results. No rows give no rows. Only the key, the text and
    the language (for learning) are read.
    """
    part = F.crc32(F.col(key).cast("string").cast("binary")) % folds == held
    part = F.coalesce(part, F.lit(False))
    model = learn(docs, ~part, text, lang, key)

    def run(batches):
        words = _word_scores(model)
        for piece in slices(batches):
            langs, sure, spans = label([t or "" for t in piece.column("text").to_pylist()], words)
            yield pa.RecordBatch.from_arrays(
                [piece.column("key"), piece.column("held_out"), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(spans, _SPANS)],
                ["key", "held_out", "lang_pred", "score", "spans"],
            )

    rows = docs.select(F.col(key).alias("key"), part.alias("held_out"), F.col(text).alias("text"))
    schema = f"key {docs.schema[key].dataType.simpleString()}, held_out boolean, lang_pred string, score double, spans array<struct<start_word:int,end_word:int,lang:string>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
