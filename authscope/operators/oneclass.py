"""One-class boundary with a Gaussian kernel, by random Fourier features.

The kernel machine is replaced by a linear one over random cosine features (Rahimi and
Recht 2007), whose inner products approximate the kernel; its numbers are close to, not
equal to, those of an exact solver. Each step is one pass in which every partition adds up
its rows into one vector and one aggregate adds those, so neither driver nor task sees more
than a few vectors of the feature width. Several values of nu share the passes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.functions.draws import SPAN, key_text
from authscope.operators.quantile import exact_percentiles
from authscope.operators.scaler import Scaler, fit_scaler
from authscope.schemas import DEFAULT_SEED
from authscope.session import cut_lineage, spread

FEATURES = 256
STEPS = 40
#: A boundary rests when no weight moves more than this in a step.
STILL = 1e-6


@dataclass(frozen=True)
class OneClass:
    """Fitted boundary of one nu: flagged where the weighted features fall below ``rho``."""

    scaler: Scaler
    nu: float
    directions: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    rho: float


def _draw(seed: int, purpose: str, *place: int) -> float:
    text = ":".join(str(p) for p in (seed, purpose, *place))
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / SPAN


def _fourier(columns: int, features: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions, normal with variance twice gamma, and shifts."""
    normal = np.array(
        [
            [
                math.sqrt(-2.0 * math.log(_draw(seed, "radius", i, j)))
                * math.cos(2.0 * math.pi * _draw(seed, "angle", i, j))
                for i in range(features)
            ]
            for j in range(columns)
        ]
    )
    shifts = np.array([2.0 * math.pi * _draw(seed, "shift", i) for i in range(features)])
    return normal * math.sqrt(2.0 * gamma), shifts


def _cosines(x: np.ndarray, directions: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    return np.cos(x @ directions + shifts) * math.sqrt(2.0 / len(shifts))


def _pass(rows: DataFrame, directions: np.ndarray, shifts: np.ndarray, weights: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per boundary: sum of the features of rows inside the margin, and how many they are."""
    models, width = weights.shape
    sent = rows.sparkSession.sparkContext.broadcast((directions, shifts, weights, rho))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directions, shifts, weights, rho = sent.value
        total, count = np.zeros((models, width)), np.zeros(models)
        for batch in batches:
            z = _cosines(batch.to_numpy(dtype=np.float64), directions, shifts)
            inside = (z @ weights.T) < rho
            total += inside.T.astype(np.float64) @ z
            count += inside.sum(axis=0)
        for m in range(models):
            yield pd.DataFrame({"m": m, "i": np.arange(-1, width), "v": np.concatenate([[count[m]], total[m]])})

    sums = rows.mapInPandas(add, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).collect()
    total, count = np.zeros((models, width)), np.zeros(models)
    for r in sums:
        if r["i"] < 0:
            count[r["m"]] = r["v"]
        else:
            total[r["m"], r["i"]] = r["v"]
    return total, count


def _moved(step: int, weights: np.ndarray, rho: np.ndarray, total: np.ndarray, count: np.ndarray, share: np.ndarray) -> tuple:
    """One step of all boundaries, from the rows inside their margins."""
    rate = 1.0 / (step + 1)
    weights = weights - rate * (weights - total / share[:, None])
    return weights, rho - rate * (count / share - 1.0) * np.maximum(rho, 1e-3)


def _averaged(
    rows: DataFrame, n: int, directions: np.ndarray, shifts: np.ndarray, nus: np.ndarray, steps: int, batch_rows: int
) -> np.ndarray:
    """Mean of the boundaries of batches of some ``batch_rows`` rows, each fitted in one task.

    A row's batch is told by its name in ``_key``, so the boundary does not depend on the partitioning
    and equal rows spread over the batches. A batch ends its steps early once its boundary rests.
    """
    parts = max(1, round(n / batch_rows))
    sent = rows.sparkSession.sparkContext.broadcast((directions, shifts))
    names = [c for c in rows.columns if c != "_key"]

    def fit(batch: pd.DataFrame) -> pd.DataFrame:
        x = batch[names].to_numpy(dtype=np.float64)
        x = x[np.lexsort(x.T)]  # sums do not depend on the order in which rows came
        z = _cosines(x, *sent.value)
        weights = np.tile(z.mean(axis=0), (len(nus), 1))
        rho, share = (weights * weights).sum(axis=1), nus * len(z)
        for step in range(1, steps + 1):
            inside = (z @ weights.T) < rho
            new, rho = _moved(step, weights, rho, inside.T.astype(np.float64) @ z, inside.sum(axis=0), share)
            moved = np.abs(new - weights).max()
            weights = new
            if moved < STILL:
                break
        count = len(nus) * weights.shape[1]
        m, i = np.divmod(np.arange(count), weights.shape[1])
        return pd.DataFrame({"m": m, "i": i, "v": weights.ravel() * len(z), "n": len(z)})

    keyed = rows.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(parts)))
    fitted = keyed.groupBy("_part").applyInPandas(fit, "m int, i int, v double, n long")
    sums = fitted.groupBy("m", "i").agg((F.sum("v") / F.sum("n")).alias("v")).collect()  # boundaries x features
    weights = np.zeros((len(nus), len(shifts)))
    for r in sums:
        weights[r["m"], r["i"]] = r["v"]
    return weights


def fit_one_class(
    df: DataFrame,
    columns: Sequence[str],
    nus: Sequence[float] = (0.1, 0.3, 0.5),
    features: int = FEATURES,
    steps: int = STEPS,
    seed: int = DEFAULT_SEED,
    scaler: Scaler | None = None,
    batch_rows: int | None = None,
    key: Sequence[str] | None = None,
) -> list[OneClass]:
    """One boundary per nu, fitted on the rows of ``df``.

    By default every step is a pass over all rows. With ``batch_rows`` the rows are dealt into batches
    of about that size by ``key``, each is fitted by itself in a task, and the boundary is the mean of
    theirs: one pass in place of all steps. Either way the offset is the exact quantile over all rows,
    so a share of nu of them lies outside.
    """
    if batch_rows and not key:
        raise ValueError("batches need a row key")
    if any(not 0 < nu <= 1 for nu in nus):
        raise ValueError("nu lies in (0, 1]")
    scaler = scaler or fit_scaler(df, columns)
    named = [key_text(*key).alias("_key")] if batch_rows else []
    rows = cut_lineage(spread(df.select(*named, *[scaler.expr(c).alias(f"f{i}") for i, c in enumerate(columns)])))
    # Kernel width from the variance over all entries, as with gamma "scale".
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"),
        sum(F.sum(f"f{i}") for i in range(len(columns))).alias("s"),
        sum(F.sum(F.col(f"f{i}") * F.col(f"f{i}")) for i in range(len(columns))).alias("q"),
    ).first()
    entries = moments["n"] * len(columns)
    variance = moments["q"] / entries - (moments["s"] / entries) ** 2
    gamma = 1.0 / (len(columns) * variance) if variance > 0 else 1.0
    directions, shifts = _fourier(len(columns), features, gamma, seed)

    models, n = len(nus), moments["n"]
    if batch_rows:
        weights = _averaged(rows, n, directions, shifts, np.array(nus), steps, batch_rows)
    else:
        # Start from the mean feature, where every row counts as inside the margin.
        total, _ = _pass(rows, directions, shifts, np.zeros((models, features)), np.ones(models))
        weights = total / n
        rho = (weights * weights).sum(axis=1)
        share = np.array(nus) * n
        for step in range(1, steps + 1):
            total, count = _pass(rows, directions, shifts, weights, rho)
            weights, rho = _moved(step, weights, rho, total, count, share)
    fitted = [OneClass(scaler, nu, directions, shifts, weights[m], 0.0) for m, nu in enumerate(nus)]
    # The offset that leaves a share of nu of the training rows outside.
    margins = cut_lineage(rows.select(*[_margin(f, [F.col(f"f{i}") for i in range(len(columns))]).alias(f"m{m}") for m, f in enumerate(fitted)]))
    cuts = exact_percentiles(margins, {f"m{m}": [nu] for m, nu in enumerate(nus)})
    return [OneClass(f.scaler, f.nu, f.directions, f.shifts, f.weights, cuts[f"m{m}", f.nu]) for m, f in enumerate(fitted)]


def _margin(model: OneClass, columns: Sequence[Column]) -> Column:
    directions, shifts, weights = model.directions, model.shifts, model.weights

    @F.pandas_udf("double")
    def margin(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(dtype=np.float64) for v in values])
        return pd.Series(_cosines(x, directions, shifts) @ weights)

    return margin(*columns)


def one_class_score(model: OneClass) -> Column:
    """How far a row lies outside: above 0 is flagged."""
    return F.lit(model.rho) - _margin(model, [model.scaler.expr(c) for c in model.scaler.columns])


def score_one_class(df: DataFrame, model: OneClass) -> DataFrame:
    out = spread(df).withColumn("anomaly_score", one_class_score(model))
    return out.withColumn("is_anomaly", (F.col("anomaly_score") > 0).cast("int"))
