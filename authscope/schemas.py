"""Canonical schemas and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

AUTH_LOG = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("user", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("app", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("country", T.StringType()),
    ]
)

# Names, spellings and defaults that results depend on.
REQUIRED_COLUMNS = ("ts", "user", "src_ip", "app", "result")
OPTIONAL_COLUMNS = ("reason", "user_agent", "country")
SUCCESS_SPELLINGS = ("ok", "true", "1", "successful", "succeed")
FAIL_SPELLINGS = ("false", "0", "failed", "failure")
RESULT_VALUES = ("success", "fail")
RBA_COLUMNS = {
    "ts": "Login Timestamp",
    "user": "User ID",
    "src_ip": "IP Address",
    "app": "app",
    "result": "Login Successful",
    "user_agent": "User Agent String",
    "country": "Country",
}
RBA_APP = "rba"
RBA_ATTACK = "Is Attack IP"
BENIGN_FLOW = "BENIGN"
BENIGN_CATEGORY = "Normal"
FEATURE_COLUMNS = (
    "n_attempts",
    "n_fail",
    "n_success",
    "n_users",
    "n_apps",
    "n_user_agents",
    "n_countries",
    "fail_rate",
    "attempts_per_min",
    "success_after_fail",
    "user_entropy",
)
FLOW_FEATURES = (
    "n_flows",
    "n_dst_ports",
    "n_dst_ips",
    "n_fail",
    "fail_rate",
    "flows_x6",
    "dst_x6",
    "log_distinct",
)
LOGIN_FEATURES = (
    "n_flows",
    "n_users",
    "n_countries",
    "n_fail",
    "fail_rate",
    "flows_x6",
    "dst_x6",
    "log_distinct",
)
APP_LOGIN_FEATURES = (
    "n_flows",
    "n_users",
    "n_apps",
    "n_fail",
    "fail_rate",
    "flows_x6",
    "dst_x6",
    "log_distinct",
)
ALERT_COLUMNS = (
    "anomaly_score",
    "n_attempts",
    "n_fail",
    "n_success",
    "n_users",
    "fail_rate",
    "attempts_per_min",
    "success_after_fail",
    "user_entropy",
)
# Column names of flow files.
FLOW_COLUMNS = {"dst_port": "Destination Port", "label": "Label", "src_ip": "Source IP", "ts": "Timestamp"}
DEFAULT_WINDOW = "10min"
DEFAULT_CONTAMINATION = 0.01
DEFAULT_TREES = 300
DEFAULT_SEED = 42
DEFAULT_MIN_FAIL = 20
AUTO_SAMPLE = 256
CONTAMINATION_FLOOR = 0.001
CONTAMINATION_CAP = 0.499
