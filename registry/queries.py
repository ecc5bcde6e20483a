"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.functions.draws import key_text
from authscope.functions.scalars import pseudo_source
from authscope.operators import (
    alerts,
    evaluate,
    features,
    forest,
    neighbors,
    normalize,
    oneclass,
    prefix,
    quantile,
    sampling,
    scaler,
    sketches,
    sliding,
)
from authscope.operators import flows as flow_ops
from authscope.plans import evaluation, grid
from authscope.plans.detect import detect
from authscope.session import checkpoint_dir, compiled_methods, cut_lineage, use_utc
from authscope.sources import adapters
from authscope.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name, with the session on UTC."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(use_utc(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Round away differences in the order of summation."""
    return df.withColumns({n: F.round(n, places) for n in names})


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = adapters.raw_logs(adapters.table(spark, sf_dir, "events"))
    return normalize.canonical_logs(raw, adapters.RAW_COLUMNS)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.flows(adapters.table(spark, sf_dir, "lineitem"))


@query
def auth_normalize(spark, sf_dir):
    return _logs(spark, sf_dir)


@query
def rba_normalize(spark, sf_dir):
    return normalize.auth_logs(adapters.rba_logins(adapters.table(spark, sf_dir, "events")))


@query
def bad_log_rows(spark, sf_dir):
    """Rows set aside because their outcome is unknown."""
    logs = normalize.auth_logs(adapters.rba_logins(adapters.table(spark, sf_dir, "events")))
    return normalize.split_logs(logs)[1].groupBy("app", "country").agg(F.count(F.lit(1)).alias("n"))


def _features(spark, sf_dir, by_app):
    out = features.window_features(_logs(spark, sf_dir), "1 day", by_app=by_app, min_fail=2)
    return rounded(out, "fail_rate", "attempts_per_min", "user_entropy")


@query
def features_1d(spark, sf_dir):
    return _features(spark, sf_dir, False)


@query
def features_1d_by_app(spark, sf_dir):
    return _features(spark, sf_dir, True)


@query
def features_10min(spark, sf_dir):
    out = features.window_features(_logs(spark, sf_dir))
    return rounded(out, "fail_rate", "attempts_per_min", "user_entropy")


@query
def features_without_agent(spark, sf_dir):
    """A counted column that holds no value at all counts as one in every window."""
    logs = _logs(spark, sf_dir).withColumn("user_agent", F.lit(None).cast("string"))
    return features.window_features(logs, "1 day").select("src_ip", "ts", "n_user_agents", "n_countries")


@query
def user_entropy_join(spark, sf_dir):
    """The same entropy as a separate table joined to the counts."""
    logs = _logs(spark, sf_dir)
    entropy = features.user_entropy(features.user_counts(logs, "1 day"))
    out = features.attach_entropy(features.window_features(logs, "1 day"), entropy)
    return rounded(out.select("src_ip", "ts", "n_users", "user_entropy"), "user_entropy")


@query
def features_approx(spark, sf_dir):
    """Exact counts, and whether every sketched one is within one or 15 % of it (nine standard errors)."""
    names = ("n_users", "n_apps", "n_user_agents", "n_countries")
    exact = features.window_features(_logs(spark, sf_dir), "1 day", min_fail=2)
    sketched = features.window_features(_logs(spark, sf_dir), "1 day", min_fail=2, approx_distinct=True)
    sketched = sketched.select("src_ip", "ts", F.col("user_entropy").alias("_entropy"), *[F.col(n).alias(f"_{n}") for n in names])
    near = [F.abs(F.col(f"_{n}") - F.col(n)) <= F.greatest(F.lit(1.0), 0.15 * F.col(n)) for n in names]
    within = near[0] & near[1] & near[2] & near[3]
    out = exact.join(sketched, ["src_ip", "ts"]).select(
        "src_ip", "ts", "n_attempts", *names, F.col("_entropy").alias("user_entropy"), within.alias("within_error")
    )
    return rounded(out, "user_entropy")


@query
def features_from_sketches(spark, sf_dir):
    """Days put together from stored sketches of hours, beside exact counts: within three standard errors?"""
    names = ("n_users", "n_apps", "n_user_agents", "n_countries")
    stored = cut_lineage(sketches.window_sketches(_logs(spark, sf_dir), "1 hour"))
    days = sketches.features_of_sketches(stored, "1 day", "1 hour", min_fail=2)
    exact = features.window_features(_logs(spark, sf_dir), "1 day", min_fail=2).select("src_ip", "ts", *names)
    held = days.withColumnsRenamed({n: f"_{n}" for n in names}).join(exact, ["src_ip", "ts"])
    error = F.lit(3 * sketches.distinct_error())
    near = [F.abs(F.col(f"_{n}") - F.col(n)) <= F.greatest(F.lit(1.0), error * F.col(n)) for n in names]
    within = near[0] & near[1] & near[2] & near[3]
    out = held.select(
        "src_ip", "ts", "n_attempts", "n_fail", "n_success", *names, "fail_rate", "attempts_per_min",
        "success_after_fail", within.alias("within_error"),
    )
    return rounded(out, "fail_rate", "attempts_per_min")


@query
def features_sliding(spark, sf_dir):
    """Days that begin every six hours, put together from panes of six hours."""
    out = sliding.sliding_features(_logs(spark, sf_dir), "1 day", "6 hours", min_fail=2)
    return rounded(out, "fail_rate", "attempts_per_min", "user_entropy")


@query
def top_sources(spark, sf_dir):
    return features.top_sources(_logs(spark, sf_dir))


# --- flows -------------------------------------------------------------------------------


@query
def flow_windows(spark, sf_dir):
    out = flow_ops.flow_windows(_flows(spark, sf_dir), ["ts", *adapters.FLOW_KEY])
    return rounded(out, "fail_rate", "flows_per_min", "dst_per_min", "log_distinct")


@query
def login_windows(spark, sf_dir):
    rba = adapters.rba_logins(adapters.table(spark, sf_dir, "events"))
    out = flow_ops.login_windows(flow_ops.login_records(rba), "1 day")
    return rounded(out, "fail_rate", "flows_per_min", "dst_per_min", "log_distinct")


@query
def app_login_windows(spark, sf_dir):
    out = flow_ops.login_windows(flow_ops.log_records(_logs(spark, sf_dir)), "1 day", second="app")
    return rounded(out, "fail_rate", "flows_per_min", "dst_per_min", "log_distinct")


@query
def app_login_windows_without_app(spark, sf_dir):
    """Without an application column the row count stands in."""
    rows = flow_ops.log_records(_logs(spark, sf_dir)).drop("app")
    return flow_ops.login_windows(rows, "1 day", second="app").select("src_ip", "ts", "n_users", "n_apps")


def _gappy(spark, sf_dir):
    """Flows with missing, undefined and infinite numbers."""
    q = F.col("l_quantity")
    return _flows(spark, sf_dir).withColumns(
        {
            "l_tax": F.when(q > 45, F.lit(float("inf"))).when(q > 40, F.lit(float("nan"))).otherwise(F.col("l_tax")),
            "l_discount": F.when(q < 5, F.lit(None).cast("double")).when(q < 10, F.lit(float("-inf"))).otherwise(F.col("l_discount")),
        }
    )


@query
def flow_clean(spark, sf_dir):
    cleaned = flow_ops.clean_columns(_gappy(spark, sf_dir), adapters.FLOW_NUMBERS)
    return cleaned.select(*adapters.FLOW_KEY, *adapters.FLOW_NUMBERS)


@query
def flow_align(spark, sf_dir):
    """Train columns on the test split: one column is missing there, one is extra."""
    rows = _flows(spark, sf_dir)
    train = rows.where(adapters.train_draw() < 0.7).drop("ts", "src_ip", "label")
    test = rows.where(adapters.train_draw() >= 0.7).drop("l_tax").withColumn("extra", F.lit(1.0))
    columns = flow_ops.numeric_columns(train, drop=adapters.FLOW_KEY)
    return flow_ops.align_columns(test, columns, keep=adapters.FLOW_KEY)


@query
def flow_pseudo_source(spark, sf_dir):
    rows = _flows(spark, sf_dir)
    return rows.groupBy(pseudo_source(F.col("label")).alias("src_ip"), "label").agg(F.count(F.lit(1)).alias("n"))


@query
def flow_sequence_time(spark, sf_dir):
    return prefix.sequence_time(_flows(spark, sf_dir).select(*adapters.FLOW_KEY), list(adapters.FLOW_KEY))


@query
def running_quantity(spark, sf_dir):
    rows = _flows(spark, sf_dir).select(*adapters.FLOW_KEY)
    return prefix.running_totals(rows, list(adapters.FLOW_KEY), {"total_cents": "price_c"})


@query
def drop_null_keys(spark, sf_dir):
    """Lenient times: text that is no time becomes null, and such rows go."""
    events = adapters.table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "view", "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = events.select("event_id", F.try_to_timestamp(text).alias("ts"))
    return rows.dropna(subset=["ts"])


@query
def bounded_scan(spark, sf_dir):
    return quantile.bounded_rows(adapters.table(spark, sf_dir, "orders"), "o_orderkey", 5000).select(
        "o_orderkey", "o_custkey"
    )


@query
def sample_keyed(spark, sf_dir):
    rows = _flows(spark, sf_dir)
    return sampling.sample_rows(rows, 10000, adapters.FLOW_KEY).select(*adapters.FLOW_KEY, "label")


# --- scaler and forest -------------------------------------------------------------------


def _benign(spark, sf_dir):
    return _flows(spark, sf_dir).where(F.col("label") == "BENIGN")


@query
def scaler_fit(spark, sf_dir):
    table = scaler.fit_scaler(_benign(spark, sf_dir), adapters.FLOW_NUMBERS).table(spark)
    return rounded(table, "mean", "scale")


@query
def scaler_apply(spark, sf_dir):
    fitted = scaler.fit_scaler(_benign(spark, sf_dir), adapters.FLOW_NUMBERS)
    out = fitted.transform(_flows(spark, sf_dir)).select(*adapters.FLOW_KEY, *adapters.FLOW_NUMBERS)
    return rounded(out, *adapters.FLOW_NUMBERS)


def _flow_forest(spark, sf_dir):
    return forest.fit_forest(_benign(spark, sf_dir), adapters.FLOW_NUMBERS, adapters.FLOW_KEY, 100)


@query
def forest_nodes(spark, sf_dir):
    return rounded(_flow_forest(spark, sf_dir).nodes, "threshold")


@query
def forest_scores(spark, sf_dir):
    out = forest.score(_flows(spark, sf_dir), _flow_forest(spark, sf_dir))
    return rounded(out.select(*adapters.FLOW_KEY, "anomaly_score"), "anomaly_score")


@query
def forest_flags(spark, sf_dir):
    """Scores by the broadcast walk, cut at a quantile of the training scores."""
    fitted = F.col("label") == "BENIGN"  # the training rows are among those to flag, so all are scored once
    model, keep = _flow_forest(spark, sf_dir), [*adapters.FLOW_KEY, "label"]
    out = forest.score_cut_and_flag(_flows(spark, sf_dir), model, 0.1, fitted, keep)[1]
    return rounded(out.select(*adapters.FLOW_KEY, "anomaly_score", "is_anomaly"), "anomaly_score")


@query
def forest_scores_in_parts(spark, sf_dir):
    """The same scores from parts of the forest of at most 5,000 nodes."""
    columns = [*adapters.FLOW_KEY, *adapters.FLOW_NUMBERS]
    model = _flow_forest(spark, sf_dir)
    out = forest.scores_in_parts(_flows(spark, sf_dir).select(*columns), model, [model.trees], "s", limit=5_000)
    return rounded(out.select(*adapters.FLOW_KEY, F.col("s")[0].alias("anomaly_score")), "anomaly_score")


@query
def forest_nodes_by_level(spark, sf_dir):
    """The same nodes when a task may grow no more than 64 rows by itself."""
    model = forest.fit_forest(
        _benign(spark, sf_dir), adapters.FLOW_NUMBERS, adapters.FLOW_KEY, 100, group_rows=64
    )
    return rounded(model.nodes, "threshold")


# --- detection and alerts ----------------------------------------------------------------

ALERT_NUMBERS = ("anomaly_score", "fail_rate", "attempts_per_min", "user_entropy")


@query
def detect_scores(spark, sf_dir):
    out = detect(_logs(spark, sf_dir), "1 day", contamination=0.05, min_fail=2).scored
    return rounded(out.select("src_ip", "ts", "n_attempts", "anomaly_score", "is_anomaly"), "anomaly_score")


@query
def detect_alerts(spark, sf_dir):
    found = detect(_logs(spark, sf_dir), "1 day", contamination=0.01, min_fail=2)
    return rounded(alerts.ranked(found.alerts), *ALERT_NUMBERS)


@query
def detect_by_app(spark, sf_dir):
    found = detect(_logs(spark, sf_dir), "1 day", by_app=True, contamination=0.01, min_fail=2)
    return rounded(found.alerts, *ALERT_NUMBERS)


def _rule_scored(spark, sf_dir):
    """Window features scored by a plain rule, flagged when every fourth attempt fails."""
    out = features.window_features(_logs(spark, sf_dir), "1 day", min_fail=2)
    score = F.col("n_fail") + F.col("n_users") / F.lit(8)
    return out.withColumn("anomaly_score", score.cast("double")).withColumn(
        "is_anomaly", (F.col("n_fail") * 4 >= F.col("n_attempts")).cast("int")
    )


@query
def alert_rows(spark, sf_dir):
    rows = alerts.alert_table(_rule_scored(spark, sf_dir))
    return rounded(rows, "fail_rate", "attempts_per_min", "user_entropy").drop("summary")


@query
def alert_text(spark, sf_dir):
    """Summary text without the rate, whose ties print differently per engine."""
    rows = alerts.alert_table(_rule_scored(spark, sf_dir))
    return rows.select("src_ip", "ts", F.regexp_replace("summary", r"fail_rate=[0-9.]+, ", "").alias("summary"))


@query
def top_alerts(spark, sf_dir):
    rows = alerts.top_alerts(alerts.alert_table(_rule_scored(spark, sf_dir)), 20)
    return rows.select("src_ip", "ts", "anomaly_score", "n_fail", "n_users")


@query
def no_alerts(spark, sf_dir):
    """No window is flagged: an empty table with every column."""
    scored = _rule_scored(spark, sf_dir).withColumn("is_anomaly", F.lit(0))
    return alerts.alert_table(scored)


# --- evaluation --------------------------------------------------------------------------


def _rule_scores(spark, sf_dir):
    """Flows with a rule's score."""
    rows = _flows(spark, sf_dir).withColumn("y", (F.col("label") != "BENIGN").cast("int"))
    return rows.withColumn("anomaly_score", F.col("l_extendedprice") / F.col("l_quantity"))


def _rule_flows(spark, sf_dir):
    """The same flows flagged above the 0.8 quantile of the score."""
    rows = _rule_scores(spark, sf_dir)
    cut = quantile.exact_percentile(rows, "anomaly_score", 0.8)
    return rows.withColumn("is_anomaly", (F.col("anomaly_score") > cut).cast("int"))


@query
def prevalence(spark, sf_dir):
    return rounded(evaluate.prevalence(_rule_scores(spark, sf_dir)), "share", "contamination")


@query
def recall_by_label(spark, sf_dir):
    return evaluate.recall_by_label(_rule_flows(spark, sf_dir), "flows", "BENIGN")


@query
def overall_recall(spark, sf_dir):
    return evaluate.overall_recall(_rule_flows(spark, sf_dir), "flows", "attack")


@query
def class_report(spark, sf_dir):
    out = evaluate.class_report(_rule_flows(spark, sf_dir))
    return rounded(out, "precision", "recall", "f1")


@query
def confusion(spark, sf_dir):
    return evaluate.confusion(_rule_flows(spark, sf_dir))


@query
def quality(spark, sf_dir):
    out = evaluate.quality(evaluate.cells(_rule_flows(spark, sf_dir)))
    return rounded(out, "f1", "recall", "precision", "false_positive_rate")


@query
def pr_curve(spark, sf_dir):
    return rounded(evaluate.pr_curve(_rule_scores(spark, sf_dir)), "precision", "recall")


@query
def pr_curve_binned(spark, sf_dir):
    return rounded(evaluate.pr_curve_binned(_rule_scores(spark, sf_dir)), "score", "precision", "recall")


@query
def average_precision(spark, sf_dir):
    return rounded(evaluate.average_precision(_rule_scores(spark, sf_dir)), "average_precision")


@query
def score_hist(spark, sf_dir):
    return rounded(evaluate.score_histogram(_rule_scores(spark, sf_dir)), "left_edge", "density")


@query
def score_cut(spark, sf_dir):
    """Cut of the training scores beside the same quantile of all scores."""
    rows = _rule_scores(spark, sf_dir)
    held = cut_lineage(
        rows.select("anomaly_score", F.when(F.col("y") == 0, F.col("anomaly_score")).alias("train_score"))
    )
    share = 1 - 0.499
    cuts = quantile.exact_percentiles(held, {"train_score": [share], "anomaly_score": [share]})
    return held.limit(1).select(
        F.round(F.lit(cuts["train_score", share]), 6).alias("train_cut"),
        F.round(F.lit(cuts["anomaly_score", share]), 6).alias("test_cut"),
    )


@query
def score_cut_sketched(spark, sf_dir):
    """One-pass cuts at several shares, each with whether its exact rank is within the stated error."""
    rows = cut_lineage(_rule_scores(spark, sf_dir).select("anomaly_score"))
    shares, error = (0.5, 0.9, 0.99, 0.999), 0.001
    cuts = [sketches.sketched_quantile(rows, "anomaly_score", s, error) for s in shares]
    below = [F.avg((F.col("anomaly_score") < c).cast("int")).alias(f"b{i}") for i, c in enumerate(cuts)]
    upto = [F.avg((F.col("anomaly_score") <= c).cast("int")).alias(f"u{i}") for i, c in enumerate(cuts)]
    ranks = rows.agg(F.count("anomaly_score").alias("n"), *below, *upto)
    within = [
        F.struct(F.lit(s).alias("share"), ((F.col(f"b{i}") - error <= s) & (F.col(f"u{i}") + error >= s)).alias("ok"))
        for i, s in enumerate(shares)
    ]
    out = ranks.select("n", F.explode(F.array(*within)).alias("w"))
    return out.select("n", F.col("w.share").alias("share"), F.col("w.ok").alias("within_error"))


def _rule_grid(spark, sf_dir):
    """Three rules in place of models, each at three shares."""
    rows = _flows(spark, sf_dir).select(
        (F.col("label") != "BENIGN").cast("int").alias("y"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("ratio"),
        (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("taxed"),
    )
    held = cut_lineage(rows)
    names = ["price", "ratio", "taxed"]
    cuts = quantile.exact_percentiles(held, {n: [1 - c for c in grid.CONTAMINATIONS] for n in names})
    lines = [
        grid.Line(n, None, None, c, n, cuts[n, 1 - c]) for n in names for c in grid.CONTAMINATIONS
    ]
    return grid.measured(held, lines)


@query
def rule_grid(spark, sf_dir):
    return _rule_grid(spark, sf_dir)


@query
def best_per_model(spark, sf_dir):
    return evaluate.best_per_model(_rule_grid(spark, sf_dir))


@query
def top_of_grid(spark, sf_dir):
    return evaluate.top_of_grid(_rule_grid(spark, sf_dir), 4)


def _rule_summary(spark, sf_dir):
    """Recall by shipping month in the two parts of a keyed split."""
    rows = _rule_flows(spark, sf_dir).withColumn("train", adapters.train_draw() < 0.7)
    month = F.concat(F.lit("m"), F.date_format("ts", "yyyy-MM"))
    label = F.when(F.col("y") == 0, "BENIGN").otherwise(month)
    rows = rows.withColumn("label", label)
    parts = [
        evaluate.recall_by_label(rows.where(F.col("train") == side), name, "BENIGN")
        for name, side in (("train", True), ("test", False))
    ]
    return evaluation.summary(parts)


@query
def eval_summary(spark, sf_dir):
    return evaluate.sorted_summary(_rule_summary(spark, sf_dir))


@query
def recall_bands(spark, sf_dir):
    return evaluate.recall_bands(_rule_summary(spark, sf_dir))


@query
def label_overlap(spark, sf_dir):
    return evaluate.label_overlap(_rule_summary(spark, sf_dir), "train", "test")


@query
def common_labels(spark, sf_dir):
    return evaluate.common_labels(_rule_summary(spark, sf_dir), "train", "test")


@query
def compare_routes(spark, sf_dir):
    return evaluate.compare_routes(_rule_summary(spark, sf_dir), ["train", "test"])


# --- evaluation routes -------------------------------------------------------------------

def _numeric_flows(spark, sf_dir):
    return _flows(spark, sf_dir).drop("dst_port")


@query
def eval_flows_raw(spark, sf_dir):
    return evaluation.raw_flows(
        _numeric_flows(spark, sf_dir), adapters.FLOW_KEY, drop=adapters.FLOW_KEY
    ).recalls


@query
def eval_flows_raw_report(spark, sf_dir):
    out = evaluation.raw_flows(
        _numeric_flows(spark, sf_dir), adapters.FLOW_KEY, drop=adapters.FLOW_KEY
    ).report
    return rounded(out, "precision", "recall", "f1")


@query
def eval_flows_windowed(spark, sf_dir):
    return evaluation.windowed_flows(
        _flows(spark, sf_dir), ["ts", *adapters.FLOW_KEY], window="7 days"
    ).recalls


@query
def eval_flows_leaky(spark, sf_dir):
    return evaluation.windowed_flows(_flows(spark, sf_dir), list(adapters.FLOW_KEY), leaky=True).recalls


@query
def eval_logins(spark, sf_dir):
    rba = adapters.rba_logins(adapters.table(spark, sf_dir, "events"))
    return evaluation.risk_logins(rba, window="1 day").recalls


@query
def eval_logs(spark, sf_dir):
    return evaluation.auth_logs(_logs(spark, sf_dir), window="1 day").recalls


@query
def eval_split(spark, sf_dir):
    """Fixed split: train and test tables with a category and a 0 / 1 label."""
    harmless = F.col("label") == "BENIGN"
    rows = _flows(spark, sf_dir).withColumn("train", adapters.train_draw() < 0.7).select(
        *adapters.FLOW_NUMBERS,
        F.when(harmless, "Normal").otherwise(F.col("label")).alias("attack_cat"),
        (~harmless).cast("int").alias("label"),
        "train",
        F.when(F.col("train") & harmless, key_text(*adapters.FLOW_KEY)).alias("row"),  # of the rows that are fitted
    )
    # The rows are passed over many times: the draw, a digest a row, is taken and written once.
    with compiled_methods(spark):
        rows = cut_lineage(rows)
    train, test = rows.where("train").drop("train"), rows.where("not train").drop("train", "row")
    return evaluation.split_flows(train, test.drop("l_tax"), ["row"]).recalls


# --- neighbours, one-class, grid ---------------------------------------------------------


@query
def knn_topk(spark, sf_dir):
    vectors = adapters.labelled_vectors(adapters.table(spark, sf_dir, "embeddings"))
    return rounded(neighbors.nearest_neighbors(vectors, 10), "distance")


@query
def knn_recall(spark, sf_dir):
    """Approximate lists of ten beside the exact ones: is nine tenths of the neighbours found?"""
    vectors = adapters.labelled_vectors(adapters.table(spark, sf_dir, "embeddings"))
    points = cut_lineage(neighbors.fold_copies(vectors, "vec_id", "x"))
    found = cut_lineage(neighbors.approximate_neighbors(points, 10))
    share = neighbors.recall(found, neighbors.neighbors_of_points(points, 10))
    return found.groupBy("point").agg(F.sum("weight").alias("n")).agg(
        F.count(F.lit(1)).alias("points"), F.sum("n").alias("listed")
    ).withColumn("recall_of_nine_tenths", F.lit(share >= 0.9))


@query
def lof(spark, sf_dir):
    vectors = adapters.labelled_vectors(adapters.table(spark, sf_dir, "embeddings"))
    factors = neighbors.local_outlier_factor(vectors, 10)
    out = neighbors.flag_outliers(factors, 0.1)
    return rounded(out.select("vec_id", "lof", "is_anomaly"), "lof")


def _vector_columns(spark, sf_dir):
    vectors = adapters.labelled_vectors(adapters.table(spark, sf_dir, "embeddings"))
    columns = [f"x{i}" for i in range(64)]
    return vectors.select("vec_id", "y", *[F.col("x")[i].alias(c) for i, c in enumerate(columns)]), columns


@query
def oneclass_rff(spark, sf_dir):
    rows, columns = _vector_columns(spark, sf_dir)
    model = oneclass.fit_one_class(rows.where("y = 0"), columns, (0.3,))[0]
    out = oneclass.score_one_class(rows, model)
    return rounded(out.select("vec_id", "y", "anomaly_score", "is_anomaly"), "anomaly_score")


@query
def oneclass_batches(spark, sf_dir):
    """The boundary averaged over batches: rows, those outside among the fitted ones, and whether nu of them are."""
    rows, columns = _vector_columns(spark, sf_dir)
    nu, fitted = 0.2, rows.where("y = 0")
    model = oneclass.fit_one_class(fitted, columns, [nu], batch_rows=128, key=["vec_id"])[0]
    out = oneclass.score_one_class(fitted, model).agg(F.count(F.lit(1)).alias("n"), F.avg("is_anomaly").alias("share"))
    return out.select("n", (F.abs(F.col("share") - nu) <= 0.02).alias("share_is_nu"))


@query
def grid_forest(spark, sf_dir):
    """Forests of 100 to 300 trees on large shares of the rows: every cell of the grid."""
    rows = _flows(spark, sf_dir).withColumn("y", (F.col("label") != "BENIGN").cast("int"))
    train = rows.where((adapters.train_draw() < 0.7) & (F.col("y") == 0))
    test = rows.where(adapters.train_draw() >= 0.7)
    return grid.forest_grid(train, test, adapters.FLOW_NUMBERS, adapters.FLOW_KEY)[0]


@query
def grid_neighbors(spark, sf_dir):
    rows, columns = _vector_columns(spark, sf_dir)
    return grid.neighbor_grid(rows, columns, ["vec_id"], rows=None)


@query
def grid_oneclass(spark, sf_dir):
    rows, columns = _vector_columns(spark, sf_dir)
    return grid.one_class_grid(rows.where("y = 0"), rows, columns, ["vec_id"], rows=None)


@query
def choose_model(spark, sf_dir):
    """The whole choice at the reference's settings: lines a model, rows that all lines were measured
    on, and whether the chosen forest gives the F1 of its line once more."""
    rows, columns = _vector_columns(spark, sf_dir)
    found = grid.choose(rows.where("y = 0"), rows, columns, ["vec_id"], test_rows=None, one_class_rows=None)
    scored = forest.score(found.tested, found.forest)
    flagged = scored.withColumn("is_anomaly", (F.col("anomaly_score") > F.lit(found.forest.cut)).cast("int"))
    again = evaluate.quality(evaluate.cells(flagged)).select(F.round("f1", 4).alias("again"))
    best = found.grid.where("model = 'IsolationForest'").agg(F.max("f1").alias("best"))
    lines = found.grid.groupBy("model").agg(F.count(F.lit(1)).alias("lines"))
    same = again.join(best, F.col("again") == F.col("best"), "left").select(F.col("best").isNotNull().alias("forest_agrees"))
    counted = found.tested.agg(F.count(F.lit(1)).alias("n"))
    return lines.join(F.broadcast(counted)).join(F.broadcast(same))


# --- streams -----------------------------------------------------------------------------


@query
def stream_features(spark, sf_dir):
    """Windows of the events replayed as a stream, the ones open at its end included."""
    events = adapters.table(spark, sf_dir, "events")
    rows = windows.read_stream(spark, f"{sf_dir}/events*.parquet", events.schema)
    logs = normalize.canonical_logs(adapters.raw_logs(rows), adapters.RAW_COLUMNS)
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    found = windows.stream_features(logs, "1 day", "1 hour", min_fail=2)
    windows.write_stream(found, f"{folder}/out", f"{folder}/state").awaitTermination()
    closed = spark.read.schema(found.schema).parquet(f"{folder}/out")
    out = windows.finish_open(closed, _logs(spark, sf_dir), "1 day", "1 hour", min_fail=2)
    return rounded(out, "fail_rate", "attempts_per_min", "user_entropy")


@query
def stream_sliding(spark, sf_dir):
    """Sliding windows of the events replayed as a stream, by the steps of the batch."""
    events = adapters.table(spark, sf_dir, "events")
    rows = windows.read_stream(spark, f"{sf_dir}/events*.parquet", events.schema)
    logs = normalize.canonical_logs(adapters.raw_logs(rows), adapters.RAW_COLUMNS)
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    found = sliding.sliding_features(logs, "1 day", "6 hours", min_fail=2, delay="1 hour")
    windows.write_stream(found, f"{folder}/out", f"{folder}/state").awaitTermination()
    closed = spark.read.schema(found.schema).parquet(f"{folder}/out")
    out = sliding.finish_sliding(closed, _logs(spark, sf_dir), "1 day", "6 hours", "1 hour", min_fail=2)
    return rounded(out, "fail_rate", "attempts_per_min", "user_entropy")
