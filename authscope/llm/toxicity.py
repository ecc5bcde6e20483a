"""Toxicity from confirmed examples and unlabelled text: non-negative PU learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.llm.text import slices, token_hashes

FEATURES = 1 << 18
POSITIVES = 4_000
UNLABELLED = 12_000
SEED = 23


#: Weights that give every text a score of 0.
_NOTHING_LEARNED = np.append(np.zeros(FEATURES), -40.0).astype(np.float32)


def _features(piece: pa.RecordBatch) -> list[np.ndarray]:
    """Distinct token buckets of each text."""
    h, first = token_hashes(piece.column("text"), fold=True)
    places = ((h >> np.uint64(24)) % np.uint64(FEATURES)).astype(np.int32)
    return [np.unique(places[a:b]) for a, b in zip(first[:-1], first[1:])]


def _sampled(batches):
    for piece in slices(batches):
        found = pa.array([f.tobytes() for f in _features(piece)], pa.binary())
        yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("toxic"), piece.column("plain"), found], ["key", "toxic", "plain", "features"])


def fit_nnpu(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    epochs: int = 60,
    batch: int = 1024,
    rate: float = 0.05,
    decay: float = 1e-5,
    screen: float = 5.0,
    seed: int = SEED,
) -> np.ndarray:
    """Weights of a logistic classifier, the last one its constant.

    With the class prior p, the risk is p R+(positive) + [R-(unlabelled) - p R-(positive)]:
    the bracket estimates the risk on clean text. It cannot be negative, so on a batch where
    it is, the fit has gone too far and steps back along its gradient.

    Copies of a row count once. Only features whose share of positive rows is ``screen``
    standard errors from their share of unlabelled ones get a weight, so that wrong labels
    and chance do not.
    """
    random = np.random.default_rng(seed)
    positive, unlabelled = ([np.frombuffer(b, np.int32) for b in dict.fromkeys(r.tobytes() for r in rows)] for rows in (positive, unlabelled))
    a, b = (np.bincount(np.concatenate(rows), minlength=FEATURES) for rows in (positive, unlabelled))
    n, m = len(positive), len(unlabelled)
    pooled = (a + b) / (n + m)
    error = np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / n + 1 / m), 1e-12))
    marked = (np.abs(a / n - b / m) >= screen * error) & (a + b >= 3)
    positive, unlabelled = ([r[marked[r]] for r in rows] for rows in (positive, unlabelled))
    w = np.zeros(FEATURES + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    share = max(1, int(batch * len(positive) / max(1, len(unlabelled))))

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in rows])
        return np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)

    def slope(at: tuple[np.ndarray, np.ndarray], by_row: np.ndarray) -> np.ndarray:
        out = np.bincount(at[0], weights=by_row[at[1]], minlength=FEATURES + 1)
        out[-1] = by_row.sum()
        return out

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(epochs):
        pick_p, pick_u = random.permutation(len(positive)), random.permutation(len(unlabelled))
        for i in range(0, len(unlabelled), batch):
            rows_u = [unlabelled[n] for n in pick_u[i : i + batch]]
            lo = i // batch * share % len(positive)
            rows_p = [positive[n] for n in np.take(pick_p, np.arange(lo, lo + share), mode="wrap")]
            p, u = flat(rows_p), flat(rows_u)
            zp = np.bincount(p[1], weights=w[p[0]], minlength=len(rows_p)) + w[-1]
            zu = np.bincount(u[1], weights=w[u[0]], minlength=len(rows_u)) + w[-1]
            clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            # derivatives of the losses log(1 + exp(-z)) for class 1 and log(1 + exp(z)) for class 0
            bracket = slope(u, sigmoid(zu) / len(zu)) - slope(p, prior * sigmoid(zp) / len(zp))
            if clean >= 0:
                grad = slope(p, -prior * sigmoid(-zp) / len(zp)) + bracket
            else:
                grad = -bracket
            grad[:-1] += decay * w[:-1]
            step += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _fit(batches, prior: float):
    table = pa.Table.from_batches(list(batches))
    rows = [np.frombuffer(f.as_py(), np.int32) for f in table.column("features")] if table.num_rows else []
    toxic, plain = (table.column(n).to_pylist() if table.num_rows else [] for n in ("toxic", "plain"))
    positive, unlabelled = ([r for r, f in zip(rows, flag) if f] for flag in (toxic, plain))
    if positive and unlabelled and any(len(r) for r in positive):
        w = fit_nnpu(positive, unlabelled, prior)
    else:
        w = _NOTHING_LEARNED
    yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()])], ["weights"])


def learn(docs: DataFrame, labels: DataFrame, fold: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> np.ndarray:
    """Fit on at most ``POSITIVES`` labelled toxic rows and ``UNLABELLED`` rows of any kind.

    Both are the first ones by a hash of the key among the rows in ``fold``; the class prior is
    the share of toxic rows among all labelled ones in it. One task fits on this bounded sample.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & fold).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y"))
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic:
        return _NOTHING_LEARNED
    prior = min(0.9, max(0.001, toxic / total))
    order = (F.xxhash64("id", F.lit(SEED)), "id")
    first = known.where("y = 1").select("id").orderBy(*order).limit(POSITIVES)
    some = docs.where(F.col(key).isNotNull() & fold).select(F.col(key).alias("id")).distinct().orderBy(*order).limit(UNLABELLED)
    asked = first.withColumn("toxic", F.lit(True)).unionByName(some.withColumn("toxic", F.lit(False)))
    asked = asked.groupBy("id").agg(F.max("toxic").alias("toxic"), (F.min("toxic") == False).alias("plain"))  # noqa: E712
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    picked = rows.join(F.broadcast(asked), rows["key"] == asked["id"]).select("key", "text", "toxic", "plain")
    sample = picked.mapInArrow(_sampled, f"key {docs.schema[key].dataType.simpleString()}, toxic boolean, plain boolean, features binary")
    one = sample.repartition(1).sortWithinPartitions("key", "features")
    found = one.mapInArrow(lambda b: _fit(b, prior), "weights binary").first()
    return np.frombuffer(found[0], np.float32) if found else _NOTHING_LEARNED


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held: int = 0) -> DataFrame:
    """A row (key, held_out, score, predicted) for each row of ``docs``.

    The rows whose crc32(key as text) modulo ``folds`` is ``held`` are held out of learning.
    The score comes from the tokens of the whole text alone, case folded. A null or empty text
    gets the score of no token; a null key is not held out. Labels with a null key or value
    are not used; of several for a key, the highest counts. Without a toxic label every score
    is 0. Equal texts have equal scores. No rows give no rows. Only the key and the text are
    read from ``docs``.
    """

    def part(column: str) -> Column:
        return F.crc32(F.col(column).cast("string").cast("binary")) % folds == held

    w = learn(docs, labels, ~part(key), key, text, label)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts], ["text"])
        z = [w[f].sum(dtype=np.float64) + w[-1] for p in slices([rows]) for f in _features(p)]
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -40, 40))))

    scored = docs.select(F.col(key), F.coalesce(part(key), F.lit(False)).alias("held_out"), score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
