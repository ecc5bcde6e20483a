"""From logs to alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from authscope.operators.alerts import alert_table
from authscope.operators.features import group_keys, window_features
from authscope.operators.forest import Forest, fit_cut, fit_forest, score_and_flag, score_cut_and_flag
from authscope.schemas import (
    DEFAULT_CONTAMINATION,
    DEFAULT_MIN_FAIL,
    DEFAULT_SEED,
    DEFAULT_TREES,
    DEFAULT_WINDOW,
    FEATURE_COLUMNS,
)
from authscope.session import cut_lineage


@dataclass(frozen=True)
class Detection:
    features: DataFrame
    scored: DataFrame
    alerts: DataFrame
    model: Forest


def detect(
    logs: DataFrame,
    window: str = DEFAULT_WINDOW,
    by_app: bool = False,
    contamination: float = DEFAULT_CONTAMINATION,
    n_estimators: int = DEFAULT_TREES,
    seed: int = DEFAULT_SEED,
    min_fail: int = DEFAULT_MIN_FAIL,
    max_samples: str | int | float = "auto",
    train: DataFrame | None = None,
) -> Detection:
    """Features, model, scores and alerts of canonical logs.

    The model is fitted on the windows it then scores, unless ``train`` gives other logs.
    Features are written once, since fitting, cutting and scoring each read them; they are a
    small part of the logs' size.
    """
    keys = group_keys(by_app)
    features = cut_lineage(window_features(logs, window, by_app, min_fail))
    fitted = features if train is None else cut_lineage(window_features(train, window, by_app, min_fail))
    model = fit_forest(fitted, FEATURE_COLUMNS, [*keys, "ts"], n_estimators, max_samples, seed)
    if train is None:
        model, scored = score_cut_and_flag(features, model, contamination)
    else:
        model = fit_cut(model, fitted, contamination)
        scored = score_and_flag(features, model)
    return Detection(features, scored, alert_table(scored, keys), model)
