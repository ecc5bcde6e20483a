"""Measuring flags and scores against labels.

Everything here reduces the data to a handful of counts in one aggregate and computes the
metrics from those, or keeps one row per distinct score in a distributed order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authscope.functions.scalars import clamp_contamination, ratio, recall_band
from authscope.operators.prefix import running_totals

HISTOGRAM_BINS = 80


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def prevalence(df: DataFrame, y: str = "y") -> DataFrame:
    """Share of attacks, raw and clamped to what a contamination may be."""
    share = F.avg(y)
    return df.agg(share.alias("share"), clamp_contamination(share).alias("contamination"))


def cells(df: DataFrame, y: str = "y", flagged: str = "is_anomaly") -> DataFrame:
    """The four counts, one row, zeros included."""
    hit, said = F.col(y) == 1, F.col(flagged) == 1
    return df.agg(
        F.count_if(~hit & ~said).alias("tn"),
        F.count_if(~hit & said).alias("fp"),
        F.count_if(hit & ~said).alias("fn"),
        F.count_if(hit & said).alias("tp"),
    )


def confusion(df: DataFrame, y: str = "y", flagged: str = "is_anomaly") -> DataFrame:
    """Rows for all four combinations."""
    return cells(df, y, flagged).selectExpr(
        "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (actual, predicted, n)"
    )


def quality(counts: DataFrame) -> DataFrame:
    """F1, recall, precision and false-positive rate beside the four counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "f1": _or_zero(ratio(2 * tp, 2 * tp + fp + fn)),
            "recall": _or_zero(ratio(tp, tp + fn)),
            "precision": _or_zero(ratio(tp, tp + fp)),
            "false_positive_rate": _or_zero(ratio(fp, fp + tn)),
        }
    )


def class_report(df: DataFrame, y: str = "y", flagged: str = "is_anomaly", names: Sequence[str] = ("BENIGN", "ATTACK")) -> DataFrame:
    """Precision, recall, F1 and support by class, with accuracy and both means: one scan."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    parts = [(tn, fn, fp), (tp, fp, fn)]  # right, wrongly in, wrongly out
    share = [
        [_or_zero(ratio(r, r + i)), _or_zero(ratio(r, r + o)), _or_zero(ratio(2 * r, 2 * r + i + o))] for r, i, o in parts
    ]
    support = [r + o for r, _, o in parts]
    total = support[0] + support[1]
    accuracy = _or_zero(ratio(tn + tp, total))
    macro = [(x + z) / 2 for x, z in zip(*share)]
    weighted = [_or_zero(ratio(x * support[0] + z * support[1], total)) for x, z in zip(*share)]
    lines = [
        (names[0], *share[0], support[0]),
        (names[1], *share[1], support[1]),
        ("accuracy", accuracy, accuracy, accuracy, total),
        ("macro avg", *macro, total),
        ("weighted avg", *weighted, total),
    ]
    cell = [F.lit(v) if isinstance(v, str) else v for line in lines for v in line]
    return cells(df, y, flagged).select(F.stack(F.lit(len(lines)), *cell).alias("name", "precision", "recall", "f1", "support"))


def recall_by_label(
    df: DataFrame, dataset: str, benign: str, label: str = "label", flagged: str = "is_anomaly", places: int = 4
) -> DataFrame:
    """Share flagged and rows for every attack label. A missing label has no line of its own."""
    return (
        df.where(F.col(label) != F.lit(benign))
        .groupBy(F.col(label).alias("label"))
        .agg(F.round(F.avg(flagged), places).alias("recall"), F.count(F.lit(1)).alias("n"))
        .select(F.lit(dataset).alias("dataset"), "label", "recall", "n")
    )


def overall_recall(
    df: DataFrame, dataset: str, name: str, y: str = "y", flagged: str = "is_anomaly", places: int = 4
) -> DataFrame:
    """One line over all attacks; 0 when there are none."""
    hit = F.col(y) == 1
    return df.agg(
        F.round(_or_zero(F.avg(F.when(hit, F.col(flagged)))), places).alias("recall"),
        F.count_if(hit).alias("n"),
    ).select(F.lit(dataset).alias("dataset"), F.lit(name).alias("label"), "recall", "n")


def sorted_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy("dataset", F.desc("recall"), "label")


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(y).cast("long")).alias("hits")
    )


def pr_curve(df: DataFrame, y: str = "y", score: str = "anomaly_score", closing_point: bool = True) -> DataFrame:
    """Precision and recall when everything at or above a score is flagged, per distinct score.

    Tied scores share a point. The order is over all distinct scores, so the running counts
    use range partitions. The closing point has no score, precision 1 and recall 0.
    """
    running = running_totals(_by_score(df, y, score), [F.desc("score")], {"said": "rows", "right": "hits"})
    total = df.agg(F.sum(F.col(y).cast("long"))).first()[0] or 0
    found = _or_zero(F.col("right") / F.lit(total)) if total else F.lit(1.0)
    curve = running.select(
        "score",
        "hits",
        (F.col("right") / F.col("said")).alias("precision"),
        found.alias("recall"),
    )
    if not closing_point:
        return curve
    last = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("score"),
        F.lit(0).cast("long").alias("hits"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return curve.unionByName(last)


def pr_curve_binned(df: DataFrame, y: str = "y", score: str = "anomaly_score", bins: int = 1000) -> DataFrame:
    """The curve at ``bins`` even steps of the score: one aggregate, at most ``bins`` rows."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    width = ((ends["hi"] or 0.0) - (ends["lo"] or 0.0)) / bins or 1.0
    slot = F.least(F.lit(bins - 1), F.floor((F.col(score) - F.lit(ends["lo"])) / F.lit(width)))
    steps = df.groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(y).cast("long")).alias("hits"), F.min(score).alias("score")
    )
    down = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    every = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return steps.select(
        "score",
        (F.sum("hits").over(down) / F.sum("rows").over(down)).alias("precision"),
        _or_zero(ratio(F.sum("hits").over(down), F.sum("hits").over(every))).alias("recall"),
    )


def average_precision(df: DataFrame, y: str = "y", score: str = "anomaly_score") -> DataFrame:
    """Precision at each distinct score, weighted by the recall gained there."""
    curve = pr_curve(df, y, score, closing_point=False)
    return curve.agg(
        _or_zero(ratio(F.sum(F.col("hits") * F.col("precision")), F.sum("hits"))).alias("average_precision")
    )


def score_histogram(df: DataFrame, y: str = "y", score: str = "anomaly_score", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts and density per class over even bins of the class's own range, last bin closed."""
    ranges = df.groupBy(y).agg(
        F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(F.lit(1)).alias("n_class")
    )
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0 / bins))
    slot = F.least(F.lit(bins - 1), F.floor((F.col(score) - F.col("lo")) / F.col("width"))).cast("int")
    # One row per class: two rows for a 0 / 1 label.
    return (
        df.select(y, score)
        .join(F.broadcast(ranges.withColumn("width", width)), y)
        .groupBy(y, slot.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.first("lo").alias("lo"),
            F.first("width").alias("width"),
            F.first("n_class").alias("n_class"),
        )
        .select(
            F.col(y).alias("y"),
            "bin",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
            "n",
            (F.col("n") / (F.col("n_class") * F.col("width"))).alias("density"),
        )
    )


def best_per_model(grid: DataFrame) -> DataFrame:
    """Row of highest F1 per model; ties go to the smaller settings."""
    rank = W.partitionBy("model").orderBy(F.desc("f1"), "n_estimators", "max_samples", "contamination")
    return grid.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def top_of_grid(grid: DataFrame, n: int = 10) -> DataFrame:
    return grid.orderBy(F.desc("f1"), "model", "n_estimators", "max_samples", "contamination").limit(n)


def recall_bands(recalls: DataFrame) -> DataFrame:
    """Each label's recall with its band, lowest first."""
    return recalls.withColumn("band", recall_band(F.col("recall"))).orderBy("recall", "label")


def label_overlap(summary: DataFrame, left: str, right: str) -> DataFrame:
    """Labels measured in both data sets, recalls side by side, highest of the left first."""
    side = [
        summary.where(F.col("dataset") == d).select("label", F.col("recall").alias(n))
        for d, n in ((left, "left_recall"), (right, "right_recall"))
    ]
    return side[0].join(side[1], "label").orderBy(F.desc("left_recall"), "label")


def common_labels(summary: DataFrame, left: str, right: str) -> DataFrame:
    one, two = (summary.where(F.col("dataset") == d).select("label") for d in (left, right))
    return one.intersect(two)


def compare_routes(summary: DataFrame, routes: Sequence[str]) -> DataFrame:
    """Recall and rows per label, one pair of columns per route."""
    wide = summary.where(F.col("dataset").isin(*routes)).groupBy("label")
    return wide.pivot("dataset", list(routes)).agg(F.first("recall").alias("recall"), F.first("n").alias("n"))
