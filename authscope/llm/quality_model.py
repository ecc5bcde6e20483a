"""Importance resampling towards good text, with hashed n-gram models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.llm.text import draws, mix, slices, token_hashes
from authscope.session import cut_lineage

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
SEED = 11


def ngram_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens and token pairs of all texts, and where each text's ones begin.

    A token is a run of letters and digits or a run of other visible characters.
    """
    h, first = token_hashes(texts)
    # Token pairs: all but the one that reaches into the next text. A pair stands after its first token.
    inside = np.ones(len(h), bool)
    last = first[1:][first[1:] > first[:-1]] - 1
    inside[last] = False
    at = np.flatnonzero(inside)
    pairs = mix(h[at] * np.uint64(3) + h[at + 1]) if len(at) else h[:0]
    both = np.concatenate([h, pairs])
    order = np.argsort(np.concatenate([np.arange(len(h)) * 2, at * 2 + 1]), kind="stable")
    places = (both[order] >> np.uint64(40)) % np.uint64(buckets)
    texts_with = np.cumsum(first[1:] > first[:-1])
    return places.astype(np.int64), np.concatenate([[0], 2 * first[1:] - texts_with])


def _counts(batches, buckets: int):
    """Counts of one partition: all its texts, and those of the target."""
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for piece in slices(batches):
        places, first = ngram_buckets(piece.column("text"), buckets)
        good = np.repeat(piece.column("good").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
        raw += np.bincount(places, minlength=buckets)
        target += np.bincount(places[good], minlength=buckets)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def _target_half(key: str):
    return F.pmod(F.xxhash64(key, F.lit(SEED + 1)), F.lit(2)) == 0


def log_ratio(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: int, buckets: int) -> np.ndarray:
    """Log ratio of the target's to the raw model's chance, for each bucket.

    The raw model counts all rows. The target model counts the texts of at most ``bound`` rows
    labelled 1, the first ones by a hash of their key in one half of them; the other half is
    left to find the cut.
    """
    good = (
        labels.where((F.col(label) == 1) & F.col(key).isNotNull() & _target_half(key))
        .select(F.col(key).alias("_good"))
        .distinct()
        .orderBy(F.xxhash64("_good", F.lit(SEED)), "_good")
        .limit(bound)
    )
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    marked = rows.join(F.broadcast(good), rows["_key"] == good["_good"], "left").select("text", F.col("_good").isNotNull().alias("good"))
    counts = marked.mapInArrow(lambda b: _counts(b, buckets), "bucket long, raw long, target long")
    found = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # a row a bucket
    n = np.ones((2, buckets))
    n[0, found["bucket"]] += found["target"]
    n[1, found["bucket"]] += found["raw"]
    n = np.log(n / n.sum(axis=1, keepdims=True))
    return n[0] - n[1]


def _key_numbers(keys: pa.Array) -> np.ndarray:
    return keys.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def weigh(piece: pa.RecordBatch, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Log importance weights of texts, and the same with their row's Gumbel noise."""
    places, first = ngram_buckets(piece.column("text"), len(ratio))
    sums = np.concatenate([[0.0], np.cumsum(ratio[places])])
    weight = sums[first[1:]] - sums[first[:-1]]
    return weight, weight - np.log(-np.log(draws(_key_numbers(piece.column("key")), seed)))


def _weights(batches, ratio: np.ndarray, seed: int):
    for piece in slices(batches):
        weight, noisy = weigh(piece, ratio, seed)
        yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(weight), pa.array(noisy)], ["key", "weight", "noisy"])


def _histogram(df: DataFrame, column: str, low: float, step: float, bins: int, by: list[str]) -> list:
    place = F.least(F.greatest(F.floor((F.col(column) - low) / step), F.lit(-1)), F.lit(bins)).cast("int")
    return df.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n")).collect()  # bins + 2 rows a group


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The ``k``-th largest number of a column without nulls, by ever finer histograms.

    Narrowing goes on until the range holds one value; only counts reach the driver.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        step = (high - low) / bins
        counts = {r["bin"]: r["n"] for r in _histogram(df, column, low, step, bins, [])}
        above, at = 0, bins
        while above + counts.get(at, 0) < k:
            above += counts.get(at, 0)
            at -= 1
        place = F.least(F.greatest(F.floor((F.col(column) - low) / step), F.lit(-1)), F.lit(bins)).cast("int")
        low, high = df.where(place == at).agg(F.min(column), F.max(column)).first()
        k -= above
        df = df.where(place == at)
    return low


def _best_cut(scores: DataFrame, labels: DataFrame, key: str, label: str, keep: float) -> float | None:
    """The weight that a share ``keep`` of the rows labelled 1 reach, of those not in the target."""
    known = labels.where(F.col(label).isNotNull() & ~_target_half(key)).groupBy(F.col(key).alias("key")).agg((F.min(label) == 1).alias("good"))
    held = cut_lineage(scores.join(known, "key").where("good").select("weight"))
    n = held.count()
    return kth_largest(held, "weight", max(1, min(n, int(np.ceil(keep * n))))) if n else None


def resampler(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    keep: float = 0.998,
    bound: int = TARGET_ROWS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> tuple[DataFrame, np.ndarray, float]:
    """Weights of all rows (key, weight, noisy), the log ratios, and the cut of the Gumbel top-k.

    A row's weight is the log ratio of its text under the target and the raw model. As many
    rows are drawn as have a weight that a share ``keep`` of the rows labelled 1 reaches; the
    labels for that are others than the target's, which fit their own model better. The draw,
    without replacement and in proportion to the weights, takes the rows with the
    largest weight plus Gumbel noise; the noise follows from the row's key alone. Rows tied
    with the last one drawn are drawn too.
    """
    ratio = log_ratio(docs, labels, key, text, label, bound, buckets)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    scores = cut_lineage(rows.mapInArrow(lambda b: _weights(b, ratio, seed), f"key {kind}, weight double, noisy double"))
    least = _best_cut(scores, labels, key, label, keep)
    k = scores.where(F.col("weight") >= least).count() if least is not None else 0
    return scores, ratio, kth_largest(scores, "noisy", k) if k else -np.inf


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", **how) -> DataFrame:
    """A row (key, log_weight, noisy_weight, kept) for each row of ``docs``; see ``resampler``.

    A null or empty text has weight 0. Equal keys share their noise, null keys too. Without a
    row labelled 1 there is no target, and every row is kept. No rows give no rows. Labels are
    used if their key is not null; of several for a key the lowest counts. Only the key and
    the text are read from ``docs``.
    """
    scores, _, cut = resampler(docs, labels, key, text, label, **how)
    return scores.select(
        F.col("key").alias(key),
        F.col("weight").alias("log_weight"),
        F.col("noisy").alias("noisy_weight"),
        (F.col("noisy") >= F.lit(float(cut))).alias("kept"),
    )


def keep_resampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", **how) -> DataFrame:
    """The drawn rows of ``docs`` with all columns: weighed again where they lie, not joined."""
    _, ratio, cut = resampler(docs, labels, key, text, label, **how)
    seed = how.get("seed", SEED)

    @F.arrow_udf("boolean")
    def drawn(keys: pa.Array, texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([keys, texts], ["key", "text"])
        return pa.array([noisy >= cut for p in slices([rows]) for noisy in weigh(p, ratio, seed)[1]], pa.bool_())

    return docs.where(drawn(F.col(key), F.col(text)))
