"""The five evaluation routes: prepare, fit on harmless rows, flag, measure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.functions.scalars import clamp_share, is_attack, pseudo_source
from authscope.operators import evaluate
from authscope.operators.flows import (
    align_columns,
    flow_windows,
    log_records,
    login_records,
    login_windows,
    numeric_columns,
)
from authscope.operators.forest import Forest, fit_cut, fit_forest, score_and_flag, score_cut_and_flag
from authscope.operators.prefix import sequence_time
from authscope.schemas import (
    APP_LOGIN_FEATURES,
    BENIGN_CATEGORY,
    BENIGN_FLOW,
    DEFAULT_SEED,
    FLOW_FEATURES,
    LOGIN_FEATURES,
)
from authscope.session import cut_lineage

TREES = 100


@dataclass(frozen=True)
class Evaluation:
    """Fitted model, flags beside labels, and the two result tables.

    Without a single harmless row nothing can be fitted: then there is no model, no row is flagged,
    and the results count no rows.
    """

    model: Forest | None
    flags: DataFrame
    recalls: DataFrame
    report: DataFrame


@dataclass(frozen=True)
class Fit:
    """Settings of the forest."""

    trees: int = TREES
    max_samples: str | int | float = "auto"
    seed: int = DEFAULT_SEED


def _flags(
    train: DataFrame, test: DataFrame, columns: Sequence[str], key: Sequence[str], fit: Fit
) -> tuple[Forest | None, DataFrame]:
    """Fit on rows with y = 0, cut at the attack share of ``test``, flag ``test``."""
    harmless = train.where(F.col("y") == 0)
    share = clamp_share(test.agg(F.avg("y")).first()[0])
    kept = [c for c in ("label", "y") if c in test.columns]
    rows = test.select(*kept, *columns)
    if harmless.isEmpty():
        nothing = {"anomaly_score": F.lit(None).cast("double"), "is_anomaly": F.lit(None).cast("int")}
        return None, rows.select(*kept).withColumns(nothing).where(F.lit(False))
    model = fit_forest(harmless, columns, key, fit.trees, fit.max_samples, fit.seed)
    if train is test:
        model, flagged = score_cut_and_flag(rows, model, share, F.col("y") == 0)
        return model, flagged.drop(*columns)
    model = fit_cut(model, harmless, share)
    # Labels and flags only: every metric reads this narrow table, not the scores again.
    return model, cut_lineage(score_and_flag(rows, model).select(*kept, "anomaly_score", "is_anomaly"))


def _by_label(model: Forest | None, flags: DataFrame, dataset: str, benign: str) -> Evaluation:
    return Evaluation(
        model, flags, evaluate.recall_by_label(flags, dataset, benign), evaluate.class_report(flags)
    )


def _overall(model: Forest | None, flags: DataFrame, dataset: str, name: str) -> Evaluation:
    return Evaluation(
        model, flags, evaluate.overall_recall(flags, dataset, name), evaluate.class_report(flags)
    )


def raw_flows(
    flows: DataFrame, key: Sequence[str], dataset: str = "flows-raw", drop: Sequence[str] = (), fit: Fit = Fit()
) -> Evaluation:
    """Every flow on its numeric columns."""
    columns = numeric_columns(flows, drop=drop)
    rows = flows.withColumn("y", is_attack(F.col("label"), BENIGN_FLOW))
    return _by_label(*_flags(rows, rows, columns, key, fit), dataset, BENIGN_FLOW)


def windowed_flows(
    flows: DataFrame,
    order_key: Sequence[str],
    dataset: str = "flows-windowed",
    leaky: bool = False,
    window: str = "10min",
    fit: Fit = Fit(),
) -> Evaluation:
    """Flows aggregated by source and window.

    ``leaky`` gives rows a time by position and a source made from the label, for data that
    has neither. Both features and groups then carry the label, so its recalls mean nothing.
    """
    if leaky:
        flows = sequence_time(flows.drop("ts"), order_key).withColumn("src_ip", pseudo_source(F.col("label")))
    windows = cut_lineage(flow_windows(flows, order_key, window))
    rows = windows.withColumn("label", F.col("true_label")).withColumn(
        "y", is_attack(F.col("true_label"), BENIGN_FLOW)
    )
    return _by_label(*_flags(rows, rows, FLOW_FEATURES, ["src_ip", "ts"], fit), dataset, BENIGN_FLOW)


def risk_logins(rba: DataFrame, dataset: str = "logins", window: str = "10min", fit: Fit = Fit()) -> Evaluation:
    """Risk-based logins by source and window."""
    windows = cut_lineage(login_windows(login_records(rba), window))
    rows = windows.withColumn("y", F.col("is_attack_window"))
    return _overall(*_flags(rows, rows, LOGIN_FEATURES, ["src_ip", "ts"], fit), dataset, "Is Attack IP")


def auth_logs(
    logs: DataFrame,
    dataset: str = "logs",
    window: str = "10min",
    attack_column: str | None = None,
    fit: Fit = Fit(),
) -> Evaluation:
    """Authentication logs by source and window.

    By default a failure counts as an attack; ``attack_column`` names a better mark.
    """
    records = log_records(logs)
    if attack_column:
        records = records.withColumn("is_attack", F.coalesce(F.col(attack_column).cast("int"), F.lit(0)))
    windows = cut_lineage(login_windows(records, window, second="app"))
    rows = windows.withColumn("y", F.col("is_attack_window"))
    return _overall(*_flags(rows, rows, APP_LOGIN_FEATURES, ["src_ip", "ts"], fit), dataset, "attack")


def split_flows(
    train: DataFrame,
    test: DataFrame,
    key: Sequence[str],
    dataset: str = "flows-split",
    drop: Sequence[str] = (),
    benign: str = BENIGN_CATEGORY,
    fit: Fit = Fit(),
) -> Evaluation:
    """Fixed train and test tables with ``attack_cat`` and 0 / 1 ``label``."""
    columns = numeric_columns(train, drop=["label", *drop])
    marks = {"y": F.col("label").cast("int")}
    fitted = train.withColumns(marks)
    aligned = align_columns(test.withColumns(marks), columns, keep=["y", "attack_cat"]).withColumnRenamed(
        "attack_cat", "label"
    )
    return _by_label(*_flags(fitted, aligned, columns, key, fit), dataset, benign)


def summary(parts: Sequence[DataFrame]) -> DataFrame:
    """Recall tables one after another."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
