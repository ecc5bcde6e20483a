"""The same queries as SQL over the given tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

LOGS = """logs AS (
  SELECT ts, 'user' || user_id AS "user",
         'ip_' || json_extract_string(props, '$.k') AS src_ip,
         ['SSO','VPN','MAIL'][event_id % 3 + 1] AS app,
         CASE WHEN event_type = 'error' THEN 'fail' ELSE 'success' END AS result,
         CASE WHEN event_type = 'error' THEN 'bad_password' ELSE 'ok' END AS reason,
         ['Chrome','Firefox','Edge','MobileSafari','python-requests','curl'][event_id % 6 + 1] AS user_agent,
         ['FR','DE','ES','GB','US','NL'][user_id % 6 + 1] AS country
  FROM events)"""

RBA = """rba AS (
  SELECT date_trunc('second', ts) AS ts, CAST(user_id AS VARCHAR) AS "user",
         'ip_' || json_extract_string(props, '$.k') AS src_ip, 'rba' AS app,
         CASE WHEN event_type = 'signup' THEN NULL
              WHEN event_type = 'error' THEN 'fail' ELSE 'success' END AS result,
         CAST(NULL AS VARCHAR) AS reason,
         ['Chrome','Firefox','Edge','MobileSafari','python-requests','curl'][event_id % 6 + 1] AS user_agent,
         ['FR','DE','ES','GB','US','NL'][user_id % 6 + 1] AS country
  FROM events)"""

FLOWS = """flows AS (
  SELECT l_shipdate AS ts, 'ip_' || l_suppkey AS src_ip, l_partkey AS dst_port,
         CASE WHEN l_returnflag <> 'R' THEN 'BENIGN' WHEN l_linestatus = 'F' THEN 'atk_a' ELSE 'atk_b' END AS label,
         l_quantity, l_extendedprice, l_discount, l_tax,
         l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(epoch(l_shipdate) AS BIGINT) AS ship_s,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS price_c
  FROM lineitem)"""

ORACLES["auth_normalize"] = f"WITH {LOGS} SELECT * FROM logs"
ORACLES["rba_normalize"] = f"WITH {RBA} SELECT * FROM rba"
ORACLES["bad_log_rows"] = f"""WITH {RBA}
SELECT app, country, count(*) AS n FROM rba WHERE result IS NULL GROUP BY app, country"""


def feature_ctes(seconds: int, min_fail: int, keys: str) -> str:
    """Window features, ending in ``f``."""
    return f"""{LOGS},
w AS (SELECT *, to_timestamp(floor(epoch(ts) / {seconds}) * {seconds})::TIMESTAMP AS win FROM logs),
a AS (SELECT {keys}, win, count(*) AS n_attempts,
        count(*) FILTER (WHERE result = 'fail') AS n_fail,
        count(*) FILTER (WHERE result = 'success') AS n_success,
        count(DISTINCT "user") AS n_users, count(DISTINCT app) AS n_apps,
        count(DISTINCT user_agent) AS n_user_agents, count(DISTINCT country) AS n_countries
      FROM w GROUP BY {keys}, win),
u AS (SELECT {keys}, win, "user", count(*) AS c FROM w GROUP BY {keys}, win, "user"),
e AS (SELECT {keys}, win,
        CASE WHEN count(*) > 1 THEN log2(sum(c)) - sum(c * log2(c)) / sum(c) ELSE 0.0 END AS user_entropy
      FROM u GROUP BY {keys}, win),
f AS (SELECT a.*, n_fail / n_attempts AS fail_rate, n_attempts / ({seconds} / 60.0) AS attempts_per_min,
        CAST(n_success > 0 AND n_fail >= {min_fail} AS INTEGER) AS success_after_fail, user_entropy
      FROM a JOIN e USING ({keys}, win))"""


def _features(seconds: int, min_fail: int, keys: str) -> str:
    return f"""WITH {feature_ctes(seconds, min_fail, keys)}
SELECT {keys}, win AS ts, n_attempts, n_fail, n_success, n_users, n_apps, n_user_agents, n_countries,
       round(fail_rate, 6) AS fail_rate, round(attempts_per_min, 6) AS attempts_per_min,
       success_after_fail, round(user_entropy, 6) AS user_entropy FROM f"""


ORACLES["features_1d"] = _features(86400, 2, "src_ip")
ORACLES["features_1d_by_app"] = _features(86400, 2, "src_ip, app")
ORACLES["features_10min"] = _features(600, 20, "src_ip")
ORACLES["features_without_agent"] = f"""WITH {LOGS}
SELECT src_ip, date_trunc('day', ts)::TIMESTAMP AS ts, 1 AS n_user_agents, count(DISTINCT country) AS n_countries
FROM logs GROUP BY 1, 2"""
ORACLES["features_approx"] = f"""SELECT src_ip, ts, n_attempts, n_users, n_apps, n_user_agents, n_countries, user_entropy,
       true AS within_error FROM ({_features(86400, 2, "src_ip")})"""
ORACLES["features_from_sketches"] = f"""SELECT * EXCLUDE (user_entropy), true AS within_error FROM ({_features(86400, 2, "src_ip")})"""
ORACLES["features_sliding"] = _features(86400, 2, "src_ip").replace(
    "to_timestamp(floor(epoch(ts) / 86400) * 86400)::TIMESTAMP AS win FROM logs",
    "to_timestamp((floor(epoch(ts) / 21600) - pane) * 21600)::TIMESTAMP AS win FROM logs, range(0, 4) t(pane)",
)
ORACLES["user_entropy_join"] = f"""SELECT src_ip, ts, n_users, user_entropy FROM ({_features(86400, 20, "src_ip")})"""
ORACLES["top_sources"] = f"""WITH {LOGS}
SELECT src_ip, count(*) AS n_attempts, count(*) FILTER (WHERE result = 'fail') AS n_fail,
       count(DISTINCT "user") AS n_users
FROM logs GROUP BY src_ip ORDER BY n_fail DESC, n_attempts DESC, src_ip LIMIT 20"""

# --- flows -------------------------------------------------------------------------------

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_s, price_c"
KEY_TEXT = f"concat_ws(':', {KEY})"
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def draw(text: str) -> str:
    """The keyed draw in [0, 1)."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


def bucket(seconds: int, ts: str = "ts") -> str:
    return f"to_timestamp(floor(epoch({ts}) / {seconds}) * {seconds})::TIMESTAMP"


def flow_window_cte(seconds: int, order: str, source: str = "flows") -> str:
    """Flows per source and window as ``fw``, unrounded."""
    minutes = seconds / 60.0
    return f"""fw AS (SELECT src_ip, {bucket(seconds)} AS ts, count(dst_port) AS n_flows,
       count(DISTINCT dst_port) AS n_dst_ports, count(DISTINCT dst_port) AS n_dst_ips,
       sum(CAST(label <> 'BENIGN' AS INTEGER)) AS n_fail, avg(CAST(label <> 'BENIGN' AS INTEGER)) AS fail_rate,
       count(dst_port) * 6 AS flows_x6, count(DISTINCT dst_port) * 6 AS dst_x6,
       count(dst_port) / {minutes} AS flows_per_min, count(DISTINCT dst_port) / {minutes} AS dst_per_min,
       ln(count(DISTINCT dst_port) + 1) AS log_distinct,
       coalesce(first(label ORDER BY {order}) FILTER (WHERE label <> 'BENIGN'), 'BENIGN') AS true_label
FROM {source} GROUP BY 1, 2)"""


ROUND_WINDOWS = """* REPLACE (round(fail_rate, 6) AS fail_rate, round(flows_per_min, 6) AS flows_per_min,
  round(dst_per_min, 6) AS dst_per_min, round(log_distinct, 6) AS log_distinct)"""
ORACLES["flow_windows"] = f"""WITH {FLOWS}, {flow_window_cte(600, f"ts, {KEY}")} SELECT {ROUND_WINDOWS} FROM fw"""


def login_window_cte(second: str, name: str) -> str:
    """Logins per source and day as ``lw``, unrounded."""
    return f"""lw AS (SELECT src_ip, date_trunc('day', ts)::TIMESTAMP AS ts, count(*) AS n_flows,
       count(DISTINCT "user") AS n_users,
       count(DISTINCT {second}) AS {name}, sum(is_fail) AS n_fail, avg(is_fail) AS fail_rate,
       count(*) * 6 AS flows_x6, count(DISTINCT "user") * 6 AS dst_x6,
       count(*) / 1440.0 AS flows_per_min, count(DISTINCT "user") / 1440.0 AS dst_per_min,
       ln(count(DISTINCT {second}) + 1) AS log_distinct, max(is_attack) AS is_attack_window
FROM logins GROUP BY 1, 2)"""


RBA_LOGINS = """logins AS (
  SELECT date_trunc('second', ts) AS ts, user_id AS "user", 'ip_' || json_extract_string(props, '$.k') AS src_ip,
         ['FR','DE','ES','GB','US','NL'][user_id % 6 + 1] AS country,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fail,
         CASE WHEN event_type = 'view' THEN 0 ELSE CAST(value > 50 AS INTEGER) END AS is_attack
  FROM events)"""
APP_LOGINS = f"""{LOGS}, logins AS (
  SELECT *, CAST(result = 'fail' AS INTEGER) AS is_fail, CAST(result = 'fail' AS INTEGER) AS is_attack FROM logs)"""
ORACLES["login_windows"] = f"WITH {RBA_LOGINS}, {login_window_cte('country', 'n_countries')} SELECT {ROUND_WINDOWS} FROM lw"
ORACLES["app_login_windows"] = f"WITH {APP_LOGINS}, {login_window_cte('app', 'n_apps')} SELECT {ROUND_WINDOWS} FROM lw"
ORACLES["app_login_windows_without_app"] = f"""WITH {APP_LOGINS}
SELECT src_ip, date_trunc('day', ts)::TIMESTAMP AS ts, count(DISTINCT "user") AS n_users, count(*) AS n_apps
FROM logins GROUP BY 1, 2"""
ORACLES["flow_clean"] = f"""WITH {FLOWS}
SELECT {KEY}, l_quantity, l_extendedprice,
       CASE WHEN l_quantity < 10 THEN 0 ELSE l_discount END AS l_discount,
       CASE WHEN l_quantity > 40 THEN 0 ELSE l_tax END AS l_tax FROM flows"""
ORACLES["flow_align"] = f"""WITH {FLOWS}
SELECT {KEY}, CAST(dst_port AS DOUBLE) AS dst_port, l_quantity, l_extendedprice, l_discount, 0.0::DOUBLE AS l_tax
FROM flows WHERE {draw(f"'42:split:' || {KEY_TEXT}")} >= 0.7"""
ORACLES["flow_pseudo_source"] = f"""WITH {FLOWS}
SELECT 'IP_' || substr(label, 1, 3) || (('0x' || substr(md5(label), 1, 8))::BIGINT % 1000) AS src_ip, label, count(*) AS n
FROM flows GROUP BY 1, 2"""
ORACLES["flow_sequence_time"] = f"""WITH {FLOWS}
SELECT {KEY}, TIMESTAMP '2021-01-01' + to_seconds(row_number() OVER (ORDER BY {KEY}) - 1) AS ts FROM flows"""
ORACLES["running_quantity"] = f"""WITH {FLOWS}
SELECT {KEY}, CAST(sum(price_c) OVER (ORDER BY {KEY} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_cents FROM flows"""
ORACLES["drop_null_keys"] = """SELECT event_id, date_trunc('second', ts) AS ts FROM events WHERE event_type <> 'view'"""
ORACLES["bounded_scan"] = "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 5000"
ORACLES["sample_keyed"] = f"""WITH {FLOWS}
SELECT {KEY}, label FROM flows ORDER BY {draw(f"'42:sample:' || {KEY_TEXT}")}, {KEY_TEXT} LIMIT 10000"""

# --- scaler and forest -------------------------------------------------------------------

SCALED = f"""{FLOWS},
stats AS (SELECT count(*) AS n_rows, {", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(NUMBERS))}
          FROM flows WHERE label = 'BENIGN'),
scaled AS (SELECT {KEY}, label, n_rows, {KEY_TEXT} AS k,
             {", ".join(f"({c} - m{i}) / s{i} AS f{i}" for i, c in enumerate(NUMBERS))} FROM flows, stats)"""
ORACLES["scaler_fit"] = f"""WITH {SCALED} """ + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column, round(m{i}, 6) AS mean, round(s{i}, 6) AS scale FROM stats"
    for i, c in enumerate(NUMBERS)
)
ORACLES["scaler_apply"] = f"""WITH {SCALED}
SELECT {KEY}, {", ".join(f"round(f{i}, 6) AS {c}" for i, c in enumerate(NUMBERS))} FROM scaled"""


def forest_ctes(source: str, width: int, trees: int, sample: int, depth: int, where: str, seed: int = 42) -> str:
    """Node table of an isolation forest, one set of CTEs per level. Ends in ``nodes``."""
    prime = 2147483647
    fs = [f"f{i}" for i in range(width)]
    out = [
        f"""trees AS (SELECT t AS tree,
              ('0x' || substr(md5('{seed}:mul:' || t), 1, 8))::BIGINT % {prime - 1} + 1 AS a,
              ('0x' || substr(md5('{seed}:add:' || t), 1, 8))::BIGINT % {prime} AS b FROM range({trees}) r(t))""",
        f"""fitted AS (SELECT *, ('0x' || substr(md5('{seed}:row:' || k), 1, 8))::BIGINT % {prime} AS x FROM {source}
              WHERE {where})""",
        f"""ranked AS (SELECT tree, {", ".join(fs)},
              row_number() OVER (PARTITION BY tree ORDER BY (a * x + b) % {prime}, k) AS rnk FROM fitted, trees)""",
        f"l0 AS (SELECT tree, 0::BIGINT AS node, {', '.join(fs)} FROM ranked WHERE rnk <= {sample})",
    ]
    lows = ", ".join(f"min({f}) OVER w AS lo{i}, max({f}) OVER w AS hi{i}" for i, f in enumerate(fs))
    usable = ", ".join(f"CASE WHEN hi{i} > lo{i} THEN {i} END" for i in range(width))
    pick_lo = "[" + ", ".join(f"lo{i}" for i in range(width)) + "][feature + 1]"
    pick_hi = "[" + ", ".join(f"hi{i}" for i in range(width)) + "][feature + 1]"
    pick_x = "[" + ", ".join(fs) + "][feature + 1]"
    u_feature = draw(f"'{seed}:feature:' || tree || ':' || node")
    u_threshold = draw(f"'{seed}:threshold:' || tree || ':' || node")
    for d in range(depth + 1):
        may = "true" if d < depth else "false"
        out += [
            f"""s{d} AS (SELECT *, {lows}, count(*) OVER w AS size FROM l{d} WINDOW w AS (PARTITION BY tree, node))""",
            f"""u{d} AS (SELECT *, list_filter([{usable}], lambda v: v IS NOT NULL) AS usable FROM s{d})""",
            f"""c{d} AS (SELECT *, CASE WHEN {may} AND size > 1 AND len(usable) > 0
                  THEN usable[CAST(floor({u_feature} * len(usable)) AS INTEGER) + 1] ELSE -1 END AS feature FROM u{d})""",
            f"""t{d} AS (SELECT *, CASE WHEN feature >= 0 THEN {pick_lo} + {u_threshold} * ({pick_hi} - {pick_lo}) END AS threshold FROM c{d})""",
            f"""n{d} AS (SELECT DISTINCT tree, node, {d} AS depth, feature, threshold, size, feature < 0 AS is_leaf FROM t{d})""",
            f"""l{d + 1} AS (SELECT tree, node * 2 + 1 + CASE WHEN {pick_x} > threshold THEN 1 ELSE 0 END AS node,
                  {", ".join(fs)} FROM t{d} WHERE feature >= 0)""",
        ]
    out.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(depth + 1)) + ")")
    return ",\n".join(out)


def path_length(n: str) -> str:
    return f"""(CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0
        ELSE 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} END)"""


def score_ctes(source: str, key: str, width: int, trees: int, sample: int, depth: int) -> str:
    """Scores of all rows of ``source`` from ``nodes``. Ends in ``scores``."""
    fs = ", ".join(f"f{i}" for i in range(width))
    out = [f"w0 AS (SELECT {key}, {fs}, tree, 0::BIGINT AS node FROM {source}, (SELECT DISTINCT tree FROM nodes))"]
    for d in range(depth + 1):
        out += [
            f"""x{d} AS (SELECT w{d}.*, n{d}.feature, n{d}.threshold, n{d}.size FROM w{d} JOIN n{d} USING (tree, node))""",
            f"""w{d + 1} AS (SELECT {key}, {fs}, tree, node * 2 + 1 + CASE WHEN [{fs}][feature + 1] > threshold THEN 1 ELSE 0 END AS node
                  FROM x{d} WHERE feature >= 0)""",
        ]
    leaves = " UNION ALL ".join(
        f"SELECT {key}, {d} + {path_length('size')} AS path FROM x{d} WHERE feature < 0" for d in range(depth + 1)
    )
    out.append(f"leaves AS ({leaves})")
    out.append(
        f"""scores AS (SELECT {key}, pow(2.0, -round(sum(path) / {trees}, 9) / {path_length(str(float(sample)))}) AS anomaly_score
             FROM leaves GROUP BY {key})"""
    )
    return ",\n".join(out)


GROWN = f"WITH {SCALED},\n" + forest_ctes("scaled", 4, 100, 256, 8, "label = 'BENIGN'")
SCORED = GROWN + ",\n" + score_ctes("scaled", KEY, 4, 100, 256, 8)
ORACLES["forest_nodes"] = GROWN + """
SELECT tree, node, depth, feature, round(threshold, 6) AS threshold, size, is_leaf FROM nodes"""
ORACLES["forest_scores"] = SCORED + f"""
SELECT {KEY}, round(anomaly_score, 6) AS anomaly_score FROM scores"""
ORACLES["forest_scores_in_parts"] = ORACLES["forest_scores"]
ORACLES["forest_nodes_by_level"] = ORACLES["forest_nodes"]
FLAGGED = SCORED + f""",
cut AS (SELECT quantile_cont(anomaly_score, 0.9) AS c FROM scores JOIN flows USING ({KEY}) WHERE label = 'BENIGN'),
flagged AS (SELECT {KEY}, label, anomaly_score, CAST(anomaly_score > c AS INTEGER) AS is_anomaly
            FROM scores JOIN flows USING ({KEY}), cut)"""
ORACLES["forest_flags"] = FLAGGED + f"""
SELECT {KEY}, round(anomaly_score, 6) AS anomaly_score, is_anomaly FROM flagged"""


# --- detection and alerts ----------------------------------------------------------------

CLAMPED = "least(0.499, greatest(0.001, (SELECT avg(y) FROM rws WHERE tested)))"


def model_ctes(
    rows: str, key: str, columns: tuple[str, ...], share: str = CLAMPED, trees: int = 100, sample: int = 256, depth: int = 8
) -> str:
    """Scale, grow, score, cut and flag. ``rows`` selects key, columns, y, fitted and tested."""
    stats = ", ".join(
        f"""CASE WHEN min({c}) = max({c}) THEN min({c}) ELSE avg({c}) END AS m{i},
            CASE WHEN min({c}) = max({c}) THEN 1.0 ELSE stddev_pop({c}) END AS s{i}"""
        for i, c in enumerate(columns)
    )
    scaled = ", ".join(f"({c} - m{i}) / s{i} AS f{i}" for i, c in enumerate(columns))
    width = len(columns)
    return f"""rws AS ({rows}),
stats AS (SELECT count(*) AS n_rows, {stats} FROM rws WHERE fitted),
scaled AS (SELECT {key}, fitted, n_rows, concat_ws(':', {key}) AS k, {scaled} FROM rws, stats),
{forest_ctes("scaled", width, trees, sample, depth, "fitted")},
{score_ctes("scaled", key, width, trees, sample, depth)},
ordered AS (SELECT anomaly_score AS v, row_number() OVER (ORDER BY anomaly_score) - 1 AS rn, count(*) OVER () AS n
            FROM scores JOIN rws USING ({key}) WHERE fitted),
place AS (SELECT (any_value(n) - 1) * (1 - {share}) AS p FROM ordered),
ends AS (SELECT max(v) FILTER (WHERE rn = floor(p)) AS lo, max(v) FILTER (WHERE rn = ceil(p)) AS hi, any_value(p) AS p
         FROM ordered, place),
cut AS (SELECT lo + (hi - lo) * (p - floor(p)) AS c FROM ends),
flagged AS (SELECT rws.*, anomaly_score, CAST(anomaly_score > c AS INTEGER) AS is_anomaly
            FROM scores JOIN rws USING ({key}), cut WHERE tested)"""


FEATURES = (
    "n_attempts", "n_fail", "n_success", "n_users", "n_apps", "n_user_agents", "n_countries",
    "fail_rate", "attempts_per_min", "success_after_fail", "user_entropy",
)
ORACLES["detect_scores"] = f"""WITH {feature_ctes(86400, 2, "src_ip")},
{model_ctes("SELECT * EXCLUDE (win), win AS ts, 0 AS y, true AS fitted, true AS tested FROM f", "src_ip, ts", FEATURES, "0.05", 300)}
SELECT src_ip, ts, n_attempts, round(anomaly_score, 6) AS anomaly_score, is_anomaly FROM flagged"""



def detect_alerts(keys: str, trees: int, tail: str) -> str:
    rows = "SELECT * EXCLUDE (win), win AS ts, 0 AS y, true AS fitted, true AS tested FROM f"
    return f"""WITH {feature_ctes(86400, 2, keys)},
{model_ctes(rows, f"{keys}, ts", FEATURES, "0.01", trees, 256, 8)}
SELECT {keys}, ts, round(anomaly_score, 6) AS anomaly_score, n_attempts, n_fail, n_success, n_users,
       round(fail_rate, 6) AS fail_rate, round(attempts_per_min, 6) AS attempts_per_min, success_after_fail,
       round(user_entropy, 6) AS user_entropy,
       format('score={{:.3f}}, attempts={{}}, fail={{}}, users={{}}, fail_rate={{:.2f}}, success_after_fail={{}}',
         anomaly_score, n_attempts, n_fail, n_users, round(fail_rate, 2), success_after_fail) AS summary
FROM flagged WHERE is_anomaly = 1 {tail}"""


ORACLES["detect_alerts"] = detect_alerts("src_ip", 300, "")
ORACLES["detect_by_app"] = detect_alerts("src_ip, app", 300, "")

RULE_WINDOWS = f"""WITH {feature_ctes(86400, 2, "src_ip")},
rule AS (SELECT * EXCLUDE (win), win AS ts, n_fail + n_users / 8 AS anomaly_score FROM f WHERE n_fail * 4 >= n_attempts)"""
ALERT = """src_ip, ts, anomaly_score, n_attempts, n_fail, n_success, n_users, round(fail_rate, 6) AS fail_rate,
       round(attempts_per_min, 6) AS attempts_per_min, success_after_fail, round(user_entropy, 6) AS user_entropy"""
ORACLES["alert_rows"] = f"{RULE_WINDOWS} SELECT {ALERT} FROM rule"
ORACLES["alert_text"] = f"""{RULE_WINDOWS}
SELECT src_ip, ts, format('score={{:.3f}}, attempts={{}}, fail={{}}, users={{}}, success_after_fail={{}}',
       anomaly_score, n_attempts, n_fail, n_users, success_after_fail) AS summary FROM rule"""
ORACLES["top_alerts"] = f"""{RULE_WINDOWS}
SELECT src_ip, ts, anomaly_score, n_fail, n_users FROM rule ORDER BY anomaly_score DESC, src_ip, ts LIMIT 20"""
ORACLES["no_alerts"] = f"{RULE_WINDOWS} SELECT {ALERT}, '' AS summary FROM rule WHERE false"

# --- evaluation --------------------------------------------------------------------------

RULE = f"""WITH {FLOWS},
scored AS (SELECT *, CAST(label <> 'BENIGN' AS INTEGER) AS y, l_extendedprice / l_quantity AS anomaly_score FROM flows),
rule AS (SELECT *, CAST(anomaly_score > (SELECT quantile_cont(anomaly_score, 0.8) FROM scored) AS INTEGER) AS is_anomaly
         FROM scored)"""
CELLS = """cells AS (SELECT count(*) FILTER (WHERE y = 0 AND is_anomaly = 0) AS tn,
                 count(*) FILTER (WHERE y = 0 AND is_anomaly = 1) AS fp,
                 count(*) FILTER (WHERE y = 1 AND is_anomaly = 0) AS fn,
                 count(*) FILTER (WHERE y = 1 AND is_anomaly = 1) AS tp FROM {rows})"""
ORACLES["prevalence"] = f"""{RULE} SELECT round(avg(y), 6) AS share,
  round(greatest(0.001, least(0.499, avg(y))), 6) AS contamination FROM rule"""
ORACLES["recall_by_label"] = f"""{RULE} SELECT 'flows' AS dataset, label, round(avg(is_anomaly), 4) AS recall, count(*) AS n
FROM rule WHERE label <> 'BENIGN' GROUP BY label"""
ORACLES["overall_recall"] = f"""{RULE} SELECT 'flows' AS dataset, 'attack' AS label,
  round(coalesce(avg(is_anomaly) FILTER (WHERE y = 1), 0), 4) AS recall, count(*) FILTER (WHERE y = 1) AS n FROM rule"""


def report_select(rows: str) -> str:
    return f""",
{CELLS.format(rows=rows)},
c AS (SELECT 'BENIGN' AS name, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f, tn + fp AS s FROM cells
      UNION ALL
      SELECT 'ATTACK', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM cells),
lines AS (SELECT * FROM c
  UNION ALL SELECT 'accuracy', (tn + tp) / (tn + fp + fn + tp), (tn + tp) / (tn + fp + fn + tp),
                   (tn + tp) / (tn + fp + fn + tp), tn + fp + fn + tp FROM cells
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM c
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM c)
SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM lines"""


ORACLES["class_report"] = RULE + report_select("rule")
ORACLES["confusion"] = f"""{RULE}, grid AS (SELECT a AS actual, p AS predicted FROM range(2) x(a), range(2) z(p))
SELECT CAST(actual AS INTEGER) AS actual, CAST(predicted AS INTEGER) AS predicted, count(rule.y) AS n
FROM grid LEFT JOIN rule ON y = actual AND is_anomaly = predicted GROUP BY 1, 2"""
ORACLES["quality"] = f"""{RULE}, {CELLS.format(rows="rule")}
SELECT tn, fp, fn, tp, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fn), 6) AS recall,
       round(tp / (tp + fp), 6) AS precision, round(fp / (fp + tn), 6) AS false_positive_rate FROM cells"""
CURVE = f"""{RULE}, g AS (SELECT anomaly_score AS score, count(*) AS n, sum(y) AS hits FROM rule GROUP BY 1),
run AS (SELECT score, hits, sum(n) OVER w AS said, sum(hits) OVER w AS found FROM g WINDOW w AS (ORDER BY score DESC)),
curve AS (SELECT score, hits, found / said AS precision, found / (SELECT sum(y) FROM rule) AS recall FROM run)"""
ORACLES["pr_curve"] = f"""{CURVE}
SELECT score, CAST(hits AS BIGINT) AS hits, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve
UNION ALL SELECT NULL, 0, 1.0, 0.0"""
ORACLES["average_precision"] = f"""{CURVE}
SELECT round(sum(hits * precision) / sum(hits), 6) AS average_precision FROM curve"""
ORACLES["pr_curve_binned"] = f"""{RULE}, e AS (SELECT min(anomaly_score) AS lo, (max(anomaly_score) - min(anomaly_score)) / 1000 AS w FROM rule),
b AS (SELECT least(999, floor((anomaly_score - lo) / w)) AS bin, count(*) AS n, sum(y) AS hits, min(anomaly_score) AS score
      FROM rule, e GROUP BY 1)
SELECT round(score, 6) AS score, round(sum(hits) OVER d / sum(n) OVER d, 6) AS precision,
       round(sum(hits) OVER d / sum(hits) OVER (), 6) AS recall
FROM b WINDOW d AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)"""
ORACLES["score_hist"] = f"""{RULE}, e AS (SELECT y, min(anomaly_score) AS lo, (max(anomaly_score) - min(anomaly_score)) / 80 AS w,
  count(*) AS n_class FROM rule GROUP BY y)
SELECT y, CAST(least(79, floor((anomaly_score - lo) / w)) AS INTEGER) AS bin,
       round(any_value(lo) + CAST(least(79, floor((anomaly_score - lo) / w)) AS INTEGER) * any_value(w), 6) AS left_edge,
       count(*) AS n, round(count(*) / (any_value(n_class) * any_value(w)), 6) AS density
FROM rule JOIN e USING (y) GROUP BY y, 2"""
ORACLES["score_cut"] = f"""{RULE}
SELECT round(quantile_cont(anomaly_score, 1 - 0.499) FILTER (WHERE y = 0), 6) AS train_cut,
       round(quantile_cont(anomaly_score, 1 - 0.499), 6) AS test_cut FROM rule"""
ORACLES["score_cut_sketched"] = """SELECT count(*) AS n, share, true AS within_error
FROM lineitem, (SELECT unnest([0.5, 0.9, 0.99, 0.999]::DOUBLE[]) AS share) GROUP BY share"""
RULE_GRID = f"""WITH {FLOWS},
wide AS (SELECT CAST(label <> 'BENIGN' AS INTEGER) AS y, l_extendedprice AS price, l_extendedprice / l_quantity AS ratio,
           l_quantity * (1 + l_tax) AS taxed FROM flows),
long AS (UNPIVOT wide ON price, ratio, taxed INTO NAME model VALUE v),
cuts AS (SELECT model, unnest([0.3, 0.4, 0.499]::DOUBLE[]) AS contamination,
           unnest(quantile_cont(v, [0.7, 0.6, 0.501])) AS cut FROM long GROUP BY model),
cells AS (SELECT model, contamination, count(*) FILTER (WHERE y = 1 AND v > cut) AS tp,
            count(*) FILTER (WHERE y = 0 AND v > cut) AS fp, count(*) FILTER (WHERE y = 1 AND v <= cut) AS fn
          FROM long JOIN cuts USING (model) GROUP BY model, contamination),
grid AS (SELECT model, CAST(NULL AS INTEGER) AS n_estimators, CAST(NULL AS DOUBLE) AS max_samples, contamination,
           round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(tp / (tp + fn), 4) AS recall,
           round(tp / (tp + fp), 4) AS precision FROM cells)"""
ORACLES["rule_grid"] = f"{RULE_GRID} SELECT * FROM grid"
ORACLES["best_per_model"] = f"""{RULE_GRID}
SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, contamination) = 1"""
ORACLES["top_of_grid"] = f"{RULE_GRID} SELECT * FROM grid ORDER BY f1 DESC, model, contamination LIMIT 4"
SUMMARY = f"""{RULE}, s AS (
  SELECT CASE WHEN {draw(f"'42:split:' || {KEY_TEXT}")} < 0.7 THEN 'train' ELSE 'test' END AS dataset,
         'm' || strftime(ts, '%Y-%m') AS label, round(avg(is_anomaly), 4) AS recall, count(*) AS n
  FROM rule WHERE y = 1 GROUP BY 1, 2),
l AS (SELECT label, recall, n FROM s WHERE dataset = 'train'),
r AS (SELECT label, recall, n FROM s WHERE dataset = 'test')"""
ORACLES["eval_summary"] = f"{SUMMARY} SELECT * FROM s"
ORACLES["recall_bands"] = f"""{SUMMARY}
SELECT *, CASE WHEN recall >= 0.8 THEN 'good' WHEN recall >= 0.5 THEN 'medium' ELSE 'poor' END AS band FROM s"""
ORACLES["label_overlap"] = f"""{SUMMARY}
SELECT label, l.recall AS left_recall, r.recall AS right_recall FROM l JOIN r USING (label)"""
ORACLES["common_labels"] = f"{SUMMARY} SELECT label FROM l INTERSECT SELECT label FROM r"
ORACLES["compare_routes"] = f"""{SUMMARY}
SELECT label, l.recall AS train_recall, l.n AS train_n, r.recall AS test_recall, r.n AS test_n FROM l FULL JOIN r USING (label)"""

# --- evaluation routes -------------------------------------------------------------------


def by_label(dataset: str, benign: str = "BENIGN") -> str:
    return f"""
SELECT '{dataset}' AS dataset, label, round(avg(is_anomaly), 4) AS recall, count(*) AS n
FROM flagged WHERE label <> '{benign}' GROUP BY label"""


def overall(dataset: str, name: str) -> str:
    return f"""
SELECT '{dataset}' AS dataset, '{name}' AS label, round(coalesce(avg(is_anomaly) FILTER (WHERE y = 1), 0), 4) AS recall,
       count(*) FILTER (WHERE y = 1) AS n FROM flagged"""


RAW_MODEL = f"""WITH {FLOWS},
{model_ctes("SELECT *, CAST(label <> 'BENIGN' AS INTEGER) AS y, label = 'BENIGN' AS fitted, true AS tested FROM flows", KEY, NUMBERS)}"""
ORACLES["eval_flows_raw"] = RAW_MODEL + by_label("flows-raw")
ORACLES["eval_flows_raw_report"] = RAW_MODEL + report_select("flagged")
FLOW_COLUMNS = ("n_flows", "n_dst_ports", "n_dst_ips", "n_fail", "fail_rate", "flows_x6", "dst_x6", "log_distinct")
FLOW_ROWS = """SELECT *, true_label AS label, CAST(true_label <> 'BENIGN' AS INTEGER) AS y,
  true_label = 'BENIGN' AS fitted, true AS tested FROM fw"""
ORACLES["eval_flows_windowed"] = f"""WITH {FLOWS}, {flow_window_cte(604800, f"ts, {KEY}")},
{model_ctes(FLOW_ROWS, "src_ip, ts", FLOW_COLUMNS)}""" + by_label("flows-windowed")
ORACLES["eval_flows_leaky"] = f"""WITH {FLOWS}, placed AS (
  SELECT * REPLACE (TIMESTAMP '2021-01-01' + to_seconds(row_number() OVER (ORDER BY {KEY}) - 1) AS ts,
    'IP_' || substr(label, 1, 3) || (('0x' || substr(md5(label), 1, 8))::BIGINT % 1000) AS src_ip) FROM flows),
{flow_window_cte(600, KEY, "placed")},
{model_ctes(FLOW_ROWS, "src_ip, ts", FLOW_COLUMNS)}""" + by_label("flows-windowed")
LOGIN_ROWS = "SELECT *, is_attack_window AS y, is_attack_window = 0 AS fitted, true AS tested FROM lw"
ORACLES["eval_logins"] = f"""WITH {RBA_LOGINS}, {login_window_cte("country", "n_countries")},
{model_ctes(LOGIN_ROWS, "src_ip, ts", ("n_flows", "n_users", "n_countries", "n_fail", "fail_rate", "flows_x6", "dst_x6", "log_distinct"))}""" + overall("logins", "Is Attack IP")
ORACLES["eval_logs"] = f"""WITH {APP_LOGINS}, {login_window_cte("app", "n_apps")},
{model_ctes(LOGIN_ROWS, "src_ip, ts", ("n_flows", "n_users", "n_apps", "n_fail", "fail_rate", "flows_x6", "dst_x6", "log_distinct"))}""" + overall("logs", "attack")
_TRAIN = f"{draw(f"'42:split:' || {KEY_TEXT}")} < 0.7"
ORACLES["eval_split"] = f"""WITH {FLOWS},
{model_ctes(f"""SELECT * REPLACE (CASE WHEN {_TRAIN} THEN l_tax ELSE 0.0 END AS l_tax,
    CASE WHEN label = 'BENIGN' THEN 'Normal' ELSE label END AS label),
  CAST(label <> 'BENIGN' AS INTEGER) AS y, label = 'BENIGN' AND {_TRAIN} AS fitted, NOT ({_TRAIN}) AS tested FROM flows""", KEY, NUMBERS)}""" + by_label("flows-split", "Normal")

# --- neighbours --------------------------------------------------------------------------

NEAREST = """WITH pairs AS (
  SELECT a.vec_id AS point, b.vec_id AS neighbor,
         list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY point ORDER BY distance, neighbor) <= 10)"""
ORACLES["knn_topk"] = f"{NEAREST} SELECT point, neighbor, round(distance, 6) AS distance, 1 AS weight FROM near"
ORACLES["lof"] = f"""{NEAREST},
kd AS (SELECT point AS neighbor, max(distance) AS kd FROM near GROUP BY point),
dens AS (SELECT point, 1.0 / (avg(greatest(kd, distance)) + 1e-10) AS d FROM near JOIN kd USING (neighbor) GROUP BY point),
fac AS (SELECT near.point, avg(o.d) / any_value(p.d) AS lof
        FROM near JOIN dens o ON o.point = near.neighbor JOIN dens p ON p.point = near.point GROUP BY near.point)
SELECT point AS vec_id, round(lof, 6) AS lof, CAST(lof > (SELECT quantile_cont(lof, 0.9) FROM fac) AS INTEGER) AS is_anomaly FROM fac"""


# The neighbour grid: all rows scaled, lists of 50, factors for 10, 20 and 50.
LOF_GRID = """WITH parts AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM parts GROUP BY i),
sc AS (SELECT vec_id, CAST(any_value(label) = 9 AS INTEGER) AS y, list((v - m) / s ORDER BY i) AS x FROM parts JOIN st USING (i) GROUP BY vec_id),
pairs AS (SELECT a.vec_id AS point, b.vec_id AS neighbor, list_distance(a.x, b.x) AS distance
          FROM sc a JOIN sc b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY distance, neighbor) AS rnk FROM pairs),
ks AS (SELECT unnest([10, 20, 50]) AS k),
near AS (SELECT k, point, neighbor, distance FROM ranked JOIN ks ON rnk <= k),
kd AS (SELECT k, point AS neighbor, max(distance) AS kd FROM near GROUP BY k, point),
dens AS (SELECT k, point, 1.0 / (avg(greatest(kd, distance)) + 1e-10) AS d FROM near JOIN kd USING (k, neighbor) GROUP BY k, point),
fac AS (SELECT near.k, near.point, avg(o.d) / any_value(p.d) AS lof FROM near
        JOIN dens o ON o.k = near.k AND o.point = near.neighbor JOIN dens p ON p.k = near.k AND p.point = near.point
        GROUP BY near.k, near.point),
ordered AS (SELECT k, lof, y, row_number() OVER (PARTITION BY k ORDER BY lof) - 1 AS rn, count(*) OVER (PARTITION BY k) AS n
            FROM fac JOIN sc ON sc.vec_id = fac.point),
place AS (SELECT (count(*) - 1) * (1 - least(0.499, greatest(0.001, avg(y)))) AS p FROM sc),
cut AS (SELECT k, max(lof) FILTER (WHERE rn = floor(p)) AS lo, max(lof) FILTER (WHERE rn = ceil(p)) AS hi, any_value(p) AS p
        FROM ordered, place GROUP BY k),
cells AS (SELECT k, count(*) FILTER (WHERE y = 1 AND lof > c) AS tp, count(*) FILTER (WHERE y = 0 AND lof > c) AS fp,
            count(*) FILTER (WHERE y = 1 AND lof <= c) AS fn
          FROM ordered JOIN (SELECT k, lo + (hi - lo) * (p - floor(p)) AS c FROM cut) USING (k) GROUP BY k)"""
ORACLES["grid_neighbors"] = f"""{LOF_GRID}
SELECT 'LOF' AS model, k AS n_estimators, CAST(NULL AS DOUBLE) AS max_samples, CAST(NULL AS DOUBLE) AS contamination,
       round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(tp / (tp + fn), 4) AS recall,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision FROM cells"""


def one_class_ctes(nu: float, steps: int, features: int = 256, width: int = 64) -> str:
    """Boundary over random cosine features, one set of CTEs per step. Ends in ``m``, ``cut``."""

    def u(what: str, place: str) -> str:
        return f"((('0x' || substr(md5('42:{what}:' || {place}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"

    place = "i || ':' || j"
    out = [
        """parts AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS j FROM embeddings)""",
        "st AS (SELECT j, avg(v) AS m, stddev_pop(v) AS s FROM parts WHERE label <> 9 GROUP BY j)",
        """flat AS (SELECT vec_id, CAST(label = 9 AS INTEGER) AS y, j, (v - m) / s AS v FROM parts JOIN st USING (j))""",
        "sc AS (SELECT vec_id, y, list(v ORDER BY j) AS x FROM flat GROUP BY vec_id, y)",
        f"gam AS (SELECT 1.0 / ({width} * (avg(v * v) - avg(v) * avg(v))) AS g, count(DISTINCT vec_id) AS n FROM flat WHERE y = 0)",
        f"""dirs AS MATERIALIZED (SELECT i, list(sqrt(-2.0 * ln({u("radius", place)})) * cos(2.0 * pi() * {u("angle", place)}) * sqrt(2.0 * g) ORDER BY j) AS d,
              2.0 * pi() * {u("shift", "i")} AS b FROM range({features}) r(i), range({width}) q(j), gam GROUP BY i)""",
        f"""z AS MATERIALIZED (SELECT vec_id, y, list(cos(list_inner_product(x, d) + b) * sqrt(2.0 / {features}) ORDER BY i) AS z
              FROM sc, dirs GROUP BY vec_id, y)""",
        f"zt AS MATERIALIZED (SELECT vec_id, unnest(z) AS v, unnest(range({features})) AS i FROM z WHERE y = 0)",
        "a0 AS MATERIALIZED (SELECT i, avg(v) AS w FROM zt GROUP BY i)",
        "p0 AS MATERIALIZED (SELECT list(w ORDER BY i) AS wl, sum(w * w) AS rho FROM a0)",
    ]
    for t in range(1, steps + 1):
        o = t - 1
        out += [
            f"i{t} AS MATERIALIZED (SELECT vec_id FROM z, p{o} WHERE y = 0 AND list_inner_product(z, wl) < rho)",
            f"g{t} AS (SELECT i, sum(v) AS s FROM zt JOIN i{t} USING (vec_id) GROUP BY i)",
            f"""a{t} AS MATERIALIZED (SELECT i, w - 1.0 / {t + 1} * (w - coalesce(s, 0) / ({nu} * n)) AS w
                  FROM a{o} LEFT JOIN g{t} USING (i), gam)""",
            f"""p{t} AS MATERIALIZED (SELECT (SELECT list(w ORDER BY i) FROM a{t}) AS wl,
                  rho - 1.0 / {t + 1} * ((SELECT count(*) FROM i{t}) / ({nu} * n) - 1.0) * greatest(rho, 1e-3) AS rho FROM p{o}, gam)""",
        ]
    out += [
        f"m AS MATERIALIZED (SELECT vec_id, y, list_inner_product(z, wl) AS margin FROM z, p{steps})",
        f"cut AS (SELECT quantile_cont(margin, {nu}) AS c FROM m WHERE y = 0)",
    ]
    return "WITH " + ", ".join(out)


ORACLES["oneclass_rff"] = f"""{one_class_ctes(0.3, 40)}
SELECT vec_id, y, round(c - margin, 6) AS anomaly_score, CAST(c - margin > 0 AS INTEGER) AS is_anomaly FROM m, cut"""


def _one_class_line(nu: float) -> str:
    return f"""({one_class_ctes(nu, 40)},
cells AS (SELECT count(*) FILTER (WHERE y = 1 AND margin < c) AS tp, count(*) FILTER (WHERE y = 0 AND margin < c) AS fp,
            count(*) FILTER (WHERE y = 1 AND margin >= c) AS fn FROM m, cut)
SELECT 'OneClassSVM' AS model, CAST(NULL AS INTEGER) AS n_estimators, CAST(NULL AS DOUBLE) AS max_samples,
       {nu}::DOUBLE AS contamination, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(tp / (tp + fn), 4) AS recall,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision FROM cells)"""


ORACLES["grid_oneclass"] = " UNION ALL ".join(_one_class_line(nu) for nu in (0.1, 0.3, 0.5))


def grid_sql(trees: int, prefixes: tuple[int, ...], shares: tuple[float, ...], levels: int) -> str:
    """Forests on shares of the training rows: every tree of every share, level by level."""
    fs = [f"f{i}" for i in range(4)]
    cols = ", ".join(fs)
    prime = 2147483647
    shares_sql = f"({list(shares)}::DOUBLE[])"
    out = [
        FLOWS,
        f"""rws AS (SELECT *, CAST(label <> 'BENIGN' AS INTEGER) AS y, {_TRAIN} AS train, {KEY_TEXT} AS k FROM flows)""",
        f"""stats AS (SELECT count(*) AS n_rows, {", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(NUMBERS))}
             FROM rws WHERE train AND y = 0)""",
        f"""scaled AS MATERIALIZED (SELECT CAST(row_number() OVER () AS INTEGER) AS i, k, y, train, {", ".join(f"({c} - m{i}) / s{i} AS f{i}" for i, c in enumerate(NUMBERS))}
             FROM rws, stats WHERE NOT train OR y = 0)""",
        f"""trees AS MATERIALIZED (SELECT g * {trees} + t AS tree, g, t,
              ('0x' || substr(md5('42:mul:' || t), 1, 8))::BIGINT % {prime - 1} + 1 AS a,
              ('0x' || substr(md5('42:add:' || t), 1, 8))::BIGINT % {prime} AS b,
              CAST(floor({shares_sql}[g + 1] * n_rows) AS BIGINT) AS sample,
              ceil(log2(floor({shares_sql}[g + 1] * n_rows))) AS lim
              FROM range({trees}) r(t), range({len(shares)}) q(g), stats)""",
        f"""ranked AS (SELECT tree, i, row_number() OVER (PARTITION BY tree
              ORDER BY (a * (('0x' || substr(md5('42:row:' || k), 1, 8))::BIGINT % {prime}) + b) % {prime}, k) <= sample AS held
              FROM scaled, trees WHERE train)""",
        "w0 AS MATERIALIZED (SELECT tree, i, 0::BIGINT AS node, held FROM ranked UNION ALL SELECT tree, i, 0, false FROM scaled, trees WHERE NOT train)",
    ]
    usable = ", ".join(f"CASE WHEN hi{i} > lo{i} THEN {i} END" for i in range(4))
    ends = ", ".join(f"min({f}) AS lo{i}, max({f}) AS hi{i}" for i, f in enumerate(fs))
    lo, hi = "[lo0, lo1, lo2, lo3][feature + 1]", "[hi0, hi1, hi2, hi3][feature + 1]"
    own = f"(tree % {trees})"  # a tree's draws are those of its number within its forest
    uf, ut = draw(f"'42:feature:' || {own} || ':' || node"), draw(f"'42:threshold:' || {own} || ':' || node")
    # Nodes from the rows that a tree holds; then all rows go on below them.
    for d in range(levels + 1):
        out += [
            f"s{d} AS (SELECT tree, node, {ends}, count(*) AS size FROM w{d} JOIN scaled USING (i) WHERE held GROUP BY tree, node)",
            f"u{d} AS (SELECT *, list_filter([{usable}], lambda v: v IS NOT NULL) AS usable FROM s{d} JOIN (SELECT tree, lim FROM trees) USING (tree))",
            f"""c{d} AS (SELECT *, CASE WHEN {d} < lim AND size > 1 AND len(usable) > 0
                  THEN usable[CAST(floor({uf} * len(usable)) AS INTEGER) + 1] ELSE -1 END AS feature FROM u{d})""",
            f"n{d} AS MATERIALIZED (SELECT tree, node, feature, CASE WHEN feature >= 0 THEN {lo} + {ut} * ({hi} - {lo}) END AS threshold, size FROM c{d})",
            f"""w{d + 1} AS MATERIALIZED (SELECT tree, i, node * 2 + 1 + CASE WHEN [{cols}][feature + 1] > threshold THEN 1 ELSE 0 END AS node, held
                  FROM w{d} JOIN n{d} USING (tree, node) JOIN scaled USING (i) WHERE feature >= 0)""",
        ]
    leaves = " UNION ALL ".join(
        f"SELECT i, tree, {d} + {path_length('size')} AS path FROM w{d} JOIN n{d} USING (tree, node) WHERE feature < 0" for d in range(levels + 1)
    )
    out += [
        f"leaves AS ({leaves})",
        f"prefixes AS (SELECT unnest({list(prefixes)}) AS p)",
        f"""scores AS MATERIALIZED (SELECT i, g, p, pow(2.0, -round(sum(path) / p, 9) / {path_length("any_value(sample)::DOUBLE")}) AS s
             FROM leaves JOIN trees USING (tree) JOIN prefixes ON t < p GROUP BY i, g, p)""",
        """cuts AS (SELECT g, p, unnest([0.3, 0.4, 0.499]::DOUBLE[]) AS contamination,
             unnest(quantile_cont(s, [0.7, 0.6, 0.501])) AS cut FROM scores JOIN scaled USING (i) WHERE train GROUP BY g, p)""",
        """cells AS (SELECT g, p, contamination, count(*) FILTER (WHERE y = 1 AND s > cut) AS tp,
             count(*) FILTER (WHERE y = 0 AND s > cut) AS fp, count(*) FILTER (WHERE y = 1 AND s <= cut) AS fn
             FROM scores JOIN scaled USING (i) JOIN cuts USING (g, p) WHERE NOT train GROUP BY g, p, contamination)""",
    ]
    return f"""WITH {", ".join(out)}
SELECT 'IsolationForest' AS model, CAST(p AS INTEGER) AS n_estimators, {shares_sql}[g + 1] AS max_samples, contamination,
       round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(tp / (tp + fn), 4) AS recall,
       round(tp / (tp + fp), 4) AS precision FROM cells"""


ORACLES["grid_forest"] = grid_sql(300, (100, 200, 300), (0.5, 0.8, 1.0), 18)

# --- stream ------------------------------------------------------------------------------

ORACLES["stream_features"] = _features(86400, 2, "src_ip")
ORACLES["stream_sliding"] = ORACLES["features_sliding"]
ORACLES["knn_recall"] = "SELECT count(*) AS points, count(*) * 10 AS listed, true AS recall_of_nine_tenths FROM embeddings"
ORACLES["oneclass_batches"] = "SELECT count(*) AS n, true AS share_is_nu FROM embeddings WHERE label <> 9"
ORACLES["choose_model"] = """SELECT model, lines, (SELECT count(*) FROM embeddings) AS n, true AS forest_agrees
FROM (VALUES ('IsolationForest', CAST(27 AS BIGINT)), ('LOF', 3), ('OneClassSVM', 3)) t(model, lines)"""
