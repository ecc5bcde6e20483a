"""The given tables in the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.functions.draws import uniform

# Names given to the derived columns.
APPS = ("SSO", "VPN", "MAIL")
AGENTS = ("Chrome", "Firefox", "Edge", "MobileSafari", "python-requests", "curl")
COUNTRIES = ("FR", "DE", "ES", "GB", "US", "NL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_of(names: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names)).cast("int") + 1)


def raw_logs(events: DataFrame) -> DataFrame:
    """Login records with the source's own column names and result spellings."""
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("ts").alias("when"),
        F.concat(F.lit("user"), F.col("user_id")).alias("account"),
        F.concat(F.lit("ip_"), F.get_json_object("props", "$.k")).alias("source"),
        _one_of(APPS, F.col("event_id")).alias("app"),
        F.when(failed, F.lit(" FAILED\t")).when(F.col("event_type") == "view", F.lit("Ok ")).otherwise("1").alias("outcome"),
        F.when(failed, "bad_password").otherwise("ok").alias("reason"),
        _one_of(AGENTS, F.col("event_id")).alias("user_agent"),
        _one_of(COUNTRIES, F.col("user_id")).alias("country"),
        "event_id",
    )


RAW_COLUMNS = {
    "ts": "when",
    "user": "account",
    "src_ip": "source",
    "app": "app",
    "result": "outcome",
    "reason": "reason",
    "user_agent": "user_agent",
    "country": "country",
}


def rba_logins(events: DataFrame) -> DataFrame:
    """The same events as risk-based login records, with unknown outcomes and attack marks."""
    return events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Login Timestamp"),
        F.col("user_id").alias("User ID"),
        F.concat(F.lit("ip_"), F.get_json_object("props", "$.k")).alias("IP Address"),
        _one_of(COUNTRIES, F.col("user_id")).alias("Country"),
        _one_of(AGENTS, F.col("event_id")).alias("User Agent String"),
        F.when(F.col("event_type") == "signup", F.lit(None).cast("boolean"))
        .otherwise(F.col("event_type") != "error")
        .alias("Login Successful"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("boolean"))
        .otherwise(F.col("value") > 50)
        .alias("Is Attack IP"),
    )


# Unique in the given tables; numbers only, so that every engine prints the same text.
FLOW_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship_s", "price_c")
FLOW_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def flows(lineitem: DataFrame) -> DataFrame:
    """Network flows: source, destination port, label and numeric columns."""
    label = (
        F.when(F.col("l_returnflag") != "R", "BENIGN")
        .when(F.col("l_linestatus") == "F", "atk_a")
        .otherwise("atk_b")
    )
    return lineitem.select(
        F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("ip_"), F.col("l_suppkey")).alias("src_ip"),
        F.col("l_partkey").alias("dst_port"),
        label.alias("label"),
        *FLOW_NUMBERS,
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ship_s"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("price_c"),
    )


def train_draw() -> Column:
    return uniform(42, "split", *FLOW_KEY)


def labelled_vectors(embeddings: DataFrame) -> DataFrame:
    """Vectors with an attack mark."""
    return embeddings.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 9).cast("int").alias("y")
    )
