"""The named queries in SQL, for an independent check on the same tables."""

from __future__ import annotations

STAMP = "'%Y-%m-%d %H:%M:%S'"


HALF_UP = "CAST(round(CAST({} AS DECIMAL(28, 10)), {}) AS DOUBLE)"


def spelled_out(sql: str) -> str:
    """Write out the short form half_up(x, n): half-up rounding of the decimal value.

    Plain round() on doubles treats ties unevenly between engines.
    """
    at = sql.rfind("half_up(")
    while at >= 0:
        start = end = at + len("half_up(")
        depth, comma = 1, 0
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            end += 1
        sql = sql[:at] + HALF_UP.format(sql[start:comma], sql[comma + 1:end - 1].strip()) + sql[end:]
        at = sql.rfind("half_up(")
    return sql


TXN = r"""
keyed AS (
  SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k FROM events
),
txn AS (
  SELECT *, device_id % 50 AS ip_id FROM (
    SELECT event_id AS txn_id, user_id AS account_id,
      CASE WHEN event_type <> 'signup' THEN event_id % 120 END AS merchant_id,
      CASE WHEN event_type IN ('purchase', 'click', 'error') THEN CAST(k AS BIGINT) END AS beneficiary_id,
      CAST(CASE WHEN k % 10 = 0 THEN user_id // 4 ELSE 100000 + user_id * 3 + k % 3 END AS BIGINT) AS device_id,
      round(value * 50, 2) AS amount, 'USD' AS currency, event_type AS txn_type,
      CASE k % 4 WHEN 0 THEN 'MOBILE' WHEN 1 THEN 'ONLINE' WHEN 2 THEN 'BRANCH' ELSE 'ATM' END AS channel,
      ts, CAST(floor(epoch(ts)) AS BIGINT) AS ts_epoch,
      event_type = 'error' AS is_fraud,
      CASE WHEN event_type = 'error' THEN
        CASE k % 3 WHEN 0 THEN 'STRUCTURING' WHEN 1 THEN 'FAN_OUT' ELSE 'MULE_CHAIN' END END AS fraud_scenario,
      CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS source
    FROM keyed)
)"""

# Customers against the watchlist, with the first entry of each as n = 1.
SCREEN = """WITH entity AS (
  SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0')
    WHEN 1 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS entity_id FROM customer
),
listed AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, 'LISTED_' || s_nationkey AS reason, n_name AS source,
    strftime(TIMESTAMP '2023-01-01' + s_suppkey * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS listed_at
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
hits AS (
  SELECT entity_id, id, name, reason, source, listed_at, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS n
  FROM entity JOIN listed ON entity_id = id OR contains(lower(name), lower(entity_id))
)
"""

SCORED = """
scored AS (
  SELECT *, (txn_id * 37 % 1000) / 1000.0::DOUBLE AS txn_risk_score,
    (txn_id * 91 % 1000) / 1000.0::DOUBLE AS behavior_anomaly_score,
    (account_id * 53 % 1000) / 1000.0::DOUBLE AS graph_risk_score
  FROM txn
)"""

# Feature windows as defined: sets and frames over the rows themselves.
FEAT = """
rolled AS (
  SELECT txn.*,
    count(txn_id) OVER h1 AS txn_count_1h, count(txn_id) OVER h24 AS txn_count_24h,
    count(txn_id) OVER d7 AS txn_count_7d,
    sum(amount) OVER h1 AS amount_sum_1h, sum(amount) OVER h24 AS amount_sum_24h,
    count(DISTINCT merchant_id) OVER d7 AS unique_merchants_7d,
    count(DISTINCT beneficiary_id) OVER d7 AS unique_beneficiaries_7d,
    count(DISTINCT device_id) OVER d30 AS unique_devices_30d,
    avg(amount) OVER past AS past_avg, max(amount) OVER past AS past_max,
    list(device_id) OVER past AS past_devices, list(beneficiary_id) OVER past AS past_payees,
    lag(ts_epoch) OVER (PARTITION BY account_id ORDER BY ts_epoch, txn_id) AS before_epoch
  FROM txn
  WINDOW h1 AS (PARTITION BY account_id ORDER BY ts_epoch RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW),
    h24 AS (PARTITION BY account_id ORDER BY ts_epoch RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW),
    d7 AS (PARTITION BY account_id ORDER BY ts_epoch RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW),
    d30 AS (PARTITION BY account_id ORDER BY ts_epoch RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW),
    past AS (PARTITION BY account_id ORDER BY ts_epoch RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING)
),
feat AS (
  SELECT *,
    CASE WHEN past_avg > 0 THEN amount / past_avg ELSE 1.0::DOUBLE END AS amount_vs_30d_avg,
    CASE WHEN past_max > 0 THEN amount / past_max ELSE 1.0::DOUBLE END AS amount_vs_30d_max,
    coalesce((ts_epoch - before_epoch) / 86400.0::DOUBLE, 0.0::DOUBLE) AS days_since_last_txn,
    CASE WHEN device_id IS NOT NULL THEN NOT coalesce(list_contains(past_devices, device_id), false) END AS is_new_device,
    CASE WHEN beneficiary_id IS NULL THEN false
      ELSE NOT coalesce(list_contains(past_payees, beneficiary_id), false) END AS is_new_beneficiary
  FROM rolled
)"""

DIMS = """
merchant AS (
  SELECT s_suppkey AS merchant_id, s_name AS name, CAST(s_suppkey % 15 AS VARCHAR) AS category_code,
    CAST(s_nationkey AS VARCHAR) AS country, (s_suppkey % 15) * 0.005::DOUBLE AS fraud_rate_hist
  FROM supplier
),
ip AS (
  SELECT ip_id, n_name AS country, ip_id % 20 = 0 AS is_vpn
  FROM (SELECT DISTINCT ip_id FROM txn) LEFT JOIN nation ON ip_id % 25 = n_nationkey
)"""

RICH = """
rich AS (
  SELECT feat.*, coalesce(fraud_rate_hist, 0.0::DOUBLE) AS merchant_fraud_rate_hist, category_code AS mcc_code,
    CASE WHEN fraud_rate_hist > 0.04::DOUBLE THEN 'HIGH' WHEN fraud_rate_hist > 0.015::DOUBLE THEN 'MEDIUM'
      ELSE 'LOW' END AS mcc_risk_tier,
    coalesce(is_vpn, false) AS ip_is_vpn, ip.country AS ip_country
  FROM feat LEFT JOIN merchant USING (merchant_id) LEFT JOIN ip ON feat.ip_id = ip.ip_id
)"""

FLAGS = """
fan_out AS (
  SELECT DISTINCT account_id FROM (
    SELECT account_id FROM txn WHERE beneficiary_id IS NOT NULL
    GROUP BY account_id, CAST(ts AS DATE) HAVING count(DISTINCT beneficiary_id) >= 5)
),
fan_in AS (
  SELECT DISTINCT beneficiary_id FROM (
    SELECT beneficiary_id FROM txn WHERE beneficiary_id IS NOT NULL
    GROUP BY beneficiary_id, CAST(ts AS DATE) HAVING count(DISTINCT account_id) >= 5)
),
shared AS (SELECT device_id FROM txn GROUP BY device_id HAVING count(DISTINCT account_id) >= 3),
structured AS (
  SELECT DISTINCT account_id FROM (
    SELECT account_id FROM txn WHERE amount BETWEEN 500 AND 9999 AND beneficiary_id IS NOT NULL
    GROUP BY account_id, beneficiary_id, ts_epoch // 259200 HAVING count(*) >= 2)
),
flags AS (
  SELECT txn_id, account_id, account_id IN (SELECT account_id FROM fan_out) AS is_fan_out_source,
    coalesce(beneficiary_id IN (SELECT beneficiary_id FROM fan_in), false) AS is_fan_in_target,
    device_id IN (SELECT device_id FROM shared) AS is_shared_device,
    account_id IN (SELECT account_id FROM structured) AS structuring_flag,
    account_id IN (SELECT beneficiary_id FROM txn WHERE beneficiary_id IS NOT NULL) AS is_mule_chain_member
  FROM txn
)"""

EDGES = """
edges AS (
  SELECT 'account_device' AS edge_type, CAST(account_id AS VARCHAR) AS src, CAST(device_id AS VARCHAR) AS dst,
    count(*) AS txn_count, sum(amount) AS total_amount FROM txn WHERE device_id IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'device_ip', CAST(device_id AS VARCHAR), CAST(ip_id AS VARCHAR), count(*), sum(amount)
  FROM txn WHERE device_id IS NOT NULL AND ip_id IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'account_beneficiary', CAST(account_id AS VARCHAR), CAST(beneficiary_id AS VARCHAR), count(*), sum(amount)
  FROM txn WHERE beneficiary_id IS NOT NULL GROUP BY ALL
)"""

NODES = """
nodes AS (
  SELECT src AS account_id, count(*) AS account_degree,
    coalesce(max(CASE WHEN edge_type = 'account_device' THEN users - 1 END), 0) AS device_shared_account_count,
    coalesce(max(CASE WHEN edge_type = 'account_beneficiary' THEN users END), 0) AS beneficiary_in_degree,
    count(*) FILTER (edge_type = 'account_device') AS num_devices,
    count(*) FILTER (edge_type = 'account_beneficiary') AS num_beneficiaries
  FROM edges JOIN (SELECT edge_type, dst, count(DISTINCT src) AS users FROM edges GROUP BY ALL) USING (edge_type, dst)
  WHERE edge_type <> 'device_ip' GROUP BY src
)"""

# All account pairs on a device, written out; only for the check.
PAIRS = """
uses AS (SELECT src AS account_id, dst AS device_id FROM edges WHERE edge_type = 'account_device'),
pairs AS (
  SELECT a.account_id AS account_a, b.account_id AS account_b, count(*) AS weight
  FROM uses a JOIN uses b ON a.device_id = b.device_id AND a.account_id < b.account_id GROUP BY ALL
)"""

REACH = """
both_ways AS (SELECT account_a AS u, account_b AS v FROM pairs UNION SELECT account_b, account_a FROM pairs),
reach AS (
  SELECT u, v FROM both_ways
  UNION
  SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u
),
component AS (SELECT u AS account_id, least(u, min(v)) AS component_id FROM reach GROUP BY u),
placed AS (
  SELECT account_id, coalesce(component_id, account_id) AS community_id
  FROM (SELECT DISTINCT CAST(account_id AS VARCHAR) AS account_id FROM txn) LEFT JOIN component USING (account_id)
),
rated AS (
  SELECT account_id, community_id, count(*) OVER c AS community_size, avg(rate) OVER c AS community_fraud_rate
  FROM placed JOIN (
    SELECT CAST(account_id AS VARCHAR) AS account_id, avg(CAST(is_fraud AS INTEGER)) AS rate FROM txn GROUP BY 1
  ) USING (account_id)
  WINDOW c AS (PARTITION BY community_id)
)"""

GRAPH = """
graph_table AS (
  SELECT coalesce(n.account_id, r.account_id) AS account_id, coalesce(account_degree, 0) AS account_degree,
    coalesce(device_shared_account_count, 0) AS device_shared_account_count,
    coalesce(beneficiary_in_degree, 0) AS beneficiary_in_degree, coalesce(num_devices, 0) AS num_devices,
    coalesce(num_beneficiaries, 0) AS num_beneficiaries, community_id,
    coalesce(community_size, 0) AS community_size, coalesce(community_fraud_rate, 0) AS community_fraud_rate
  FROM nodes n FULL OUTER JOIN rated r ON n.account_id = r.account_id
),
graph_rated AS (
  SELECT *, greatest(0.0, least(1.0, device_shared_account_count * 0.15::DOUBLE
    + least(beneficiary_in_degree, 20) / 20.0::DOUBLE * 0.25::DOUBLE + community_fraud_rate * 0.30::DOUBLE
    + CASE WHEN account_degree > 10 THEN 0.15::DOUBLE ELSE 0 END
    + CASE WHEN num_beneficiaries > 5 THEN 0.15::DOUBLE ELSE 0 END))::DOUBLE AS graph_risk_score
  FROM graph_table
)"""

SIGNALS = """
signals AS (
  SELECT rich.* EXCLUDE (is_new_device), coalesce(is_new_device, false) AS is_new_device,
    txn_risk_score, behavior_anomaly_score, graph_risk_score,
    is_fan_out_source, is_fan_in_target, is_shared_device, structuring_flag, is_mule_chain_member,
    rich.account_id % 19 = 0 AS watchlist_hit
  FROM rich JOIN (SELECT txn_id, txn_risk_score, behavior_anomaly_score, graph_risk_score FROM scored) USING (txn_id)
  JOIN (SELECT * EXCLUDE (account_id) FROM flags) USING (txn_id)
)"""


def _decided(source: str, full: bool = False) -> str:
    """Score, action, band and codes over a table of signals."""
    watch = " + CASE WHEN watchlist_hit THEN 0.30::DOUBLE ELSE 0.0::DOUBLE END" if full else ""
    codes = [
        ("NEW_DEVICE_HIGH_VALUE_TXN", "is_new_device AND amount_vs_30d_avg > 2.0"),
        ("SHARED_DEVICE_CLUSTER", "is_shared_device"),
        ("STRUCTURING_PATTERN", "structuring_flag"),
        ("FAN_OUT_PATTERN", "is_fan_out_source"),
        ("FAN_IN_PATTERN", "is_fan_in_target"),
        ("AMOUNT_4X_BASELINE", "amount_vs_30d_avg > 4.0"),
        *([("WATCHLIST_HIT", "watchlist_hit")] if full else []),
        ("IP_COUNTRY_MISMATCH", "ip_is_vpn AND is_new_beneficiary"),
        ("HIGH_RISK_MERCHANT", "merchant_fraud_rate_hist > 0.05::DOUBLE"),
        ("MULE_CHAIN_DETECTED", "is_mule_chain_member"),
        *([("NEW_PAYEE_LARGE_TXN", "is_new_beneficiary AND amount_vs_30d_avg > 2.0"),
           ("BURST_VELOCITY", "amount_vs_30d_avg > 1.0 AND behavior_anomaly_score > 0.5::DOUBLE "
                              "AND txn_risk_score > 0.3::DOUBLE")] if full else []),
    ]
    listed = "concat_ws('|', " + ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in codes) + ")"
    if not full:
        listed = (f"CASE WHEN final_risk_score < 0.35::DOUBLE THEN '' WHEN {listed} = '' "
                  f"THEN 'ELEVATED_RISK_SCORE' ELSE {listed} END")
    return f"""
fused AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    0.50::DOUBLE * txn_risk_score + 0.25::DOUBLE * behavior_anomaly_score + 0.25::DOUBLE * graph_risk_score
    + (CASE WHEN structuring_flag THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN is_shared_device AND is_new_beneficiary THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN is_fan_out_source THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN is_mule_chain_member AND amount_vs_30d_avg > 3.0 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN ip_is_vpn AND is_new_device THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END{watch}))) AS final_risk_score
  FROM {source}
),
alerts AS (
  SELECT *, CASE WHEN final_risk_score >= 0.85::DOUBLE THEN 'BLOCK' WHEN final_risk_score >= 0.70::DOUBLE THEN
      'QUEUE_FOR_REVIEW' WHEN final_risk_score >= 0.55::DOUBLE THEN 'STEP_UP_AUTH'
      WHEN final_risk_score >= 0.35::DOUBLE THEN 'ALLOW_WITH_MONITORING' ELSE 'ALLOW' END AS action,
    CASE WHEN final_risk_score >= 0.85::DOUBLE THEN 'CRITICAL' WHEN final_risk_score >= 0.70::DOUBLE THEN 'HIGH'
      WHEN final_risk_score >= 0.55::DOUBLE THEN 'ELEVATED'
      WHEN final_risk_score >= 0.35::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
    {listed} AS reason_codes, 'ALT_' || lpad(CAST(txn_id AS VARCHAR), 8, '0') AS alert_id
  FROM fused
)"""


# Alerts whose rule signals need no history.
PLAIN = """
plain AS (
  SELECT *, device_id < 100000 AS is_shared_device,
    beneficiary_id IS NOT NULL AND txn_id % 3 = 0 AS is_new_beneficiary, txn_id % 5 = 0 AS is_new_device,
    ip_id % 20 = 0 AS ip_is_vpn, coalesce(merchant_id % 15 * 0.005::DOUBLE, 0.0::DOUBLE) AS merchant_fraud_rate_hist,
    amount / 2500.0::DOUBLE AS amount_vs_30d_avg, false AS structuring_flag, false AS is_fan_out_source,
    false AS is_fan_in_target, false AS is_mule_chain_member
  FROM scored
)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n"


T = with_(TXN)
S = with_(TXN, SCORED)
F_ = with_(TXN, FEAT)
R = with_(TXN, FEAT, DIMS, RICH)
G = with_(TXN, EDGES, NODES)
P = with_(TXN, EDGES, PAIRS)
C = with_(TXN, EDGES, NODES, PAIRS, REACH, GRAPH, recursive=True)
L = with_(TXN, FLAGS)
X = with_(TXN, SCORED, FEAT, DIMS, RICH, FLAGS, SIGNALS)
D = with_(TXN, SCORED, FEAT, DIMS, RICH, FLAGS, SIGNALS, _decided("signals"))
DF = with_(TXN, SCORED, FEAT, DIMS, RICH, FLAGS, SIGNALS, _decided("signals", full=True))
A = with_(TXN, SCORED, PLAIN, _decided("plain"))

VELOCITY = """txn_count_1h, txn_count_24h, txn_count_7d, amount_sum_1h, amount_sum_24h,
  unique_merchants_7d, unique_beneficiaries_7d, unique_devices_30d"""
BEHAVIOR = """half_up(amount_vs_30d_avg, 6) AS amount_vs_30d_avg, half_up(amount_vs_30d_max, 6) AS amount_vs_30d_max,
  half_up(days_since_last_txn, 6) AS days_since_last_txn, is_new_device, is_new_beneficiary"""
MERCHANT_IP = """half_up(merchant_fraud_rate_hist, 6) AS merchant_fraud_rate_hist, mcc_code, mcc_risk_tier,
  ip_is_vpn, ip_country"""
FLAG_COLUMNS = "is_fan_out_source, is_fan_in_target, is_shared_device, structuring_flag, is_mule_chain_member"
PROFILES = """
profiles AS (
  SELECT account_id, count(*) AS total_txn_count, avg(amount) AS avg_amount, max(amount) AS max_amount,
    coalesce(stddev_samp(amount), 0) AS std_amount, count(DISTINCT merchant_id) AS unique_merchants,
    count(DISTINCT beneficiary_id) AS unique_beneficiaries, count(DISTINCT device_id) AS unique_devices,
    avg(txn_count_7d) AS avg_txn_count_7d, avg(amount_sum_24h) AS avg_amount_sum_24h, bool_or(is_fraud) AS has_fraud
  FROM feat GROUP BY account_id
)"""

RAW = r"""
raw AS (
  SELECT CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS INTEGER) AS step, upper(txn_type) AS type,
    amount, 'C' || account_id AS nameOrig, 'M' || coalesce(beneficiary_id, 0) AS nameDest,
    CAST(is_fraud AS INTEGER) AS isFraud
  FROM txn
),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY step, type, amount, nameOrig, nameDest, isFraud) - 1 AS no FROM raw
)"""

REPORTS = """
reports AS (
  SELECT txn_id AS alert_no, ['fan_in', 'Fan_Out', 'cycle', 'other'][txn_id % 4 + 1] AS reason,
    'C' || account_id AS nameOrig FROM txn WHERE txn_type = 'signup' AND txn_id % 3 = 0
),
reported AS (
  SELECT nameOrig, CASE lower(arg_max(reason, alert_no)) WHEN 'fan_in' THEN 'FAN_IN' WHEN 'fan_out' THEN 'FAN_OUT'
    WHEN 'cycle' THEN 'MULE_CHAIN' ELSE 'AMLSIM_AML' END AS scenario
  FROM reports GROUP BY nameOrig
)"""


def _psi(filter_sql: str = "") -> str:
    """PSI of price and discount of shipments per month, against those before 1998."""
    return """WITH v AS (
  SELECT 'l_extendedprice' AS feature, l_extendedprice AS x, l_shipdate AS ts FROM lineitem
  UNION ALL SELECT 'l_discount', l_discount, l_shipdate FROM lineitem
),
edge AS (
  SELECT 'l_extendedprice' AS feature, unnest(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e
  FROM v WHERE feature = 'l_extendedprice' AND ts < TIMESTAMP '1998-01-01'
  UNION ALL SELECT 'l_discount', unnest(range(1, 10)) * 0.1::DOUBLE
),
edges AS (SELECT feature, list(e ORDER BY e) AS es FROM edge GROUP BY feature),
b AS (
  SELECT feature, CASE WHEN ts < TIMESTAMP '1998-01-01' THEN 'reference' ELSE strftime(ts, '%Y-%m') END AS period,
    len(list_filter(es, lambda e: e <= x)) AS bin
  FROM v JOIN edges USING (feature)
),
n AS (SELECT feature, period, bin, count(*) AS n FROM b GROUP BY ALL),
grid AS (
  SELECT feature, period, bin FROM (SELECT DISTINCT feature, period FROM n), (SELECT unnest(range(0, 10)) AS bin)
),
share AS (
  SELECT feature, period, bin, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER (PARTITION BY feature, period) + 10) AS s,
    sum(coalesce(n, 0)) OVER (PARTITION BY feature, period) AS total
  FROM grid LEFT JOIN n USING (feature, period, bin)
),
psi AS (
  SELECT a.feature, a.period, half_up(sum((a.s - e.s) * ln(a.s / e.s)), 4) AS psi
  FROM share a JOIN share e ON a.feature = e.feature AND a.bin = e.bin AND e.period = 'reference'
  WHERE a.period <> 'reference' AND a.total >= 50 GROUP BY ALL
)
"""


def _alert_psi() -> str:
    """Weekly PSI of scores and amount against the time before the cutoff, all within one table."""
    return """
drift_value AS (
  SELECT 'txn_risk_score' AS feature, txn_risk_score AS x, ts FROM alerts
  UNION ALL SELECT 'behavior_anomaly_score', behavior_anomaly_score, ts FROM alerts
  UNION ALL SELECT 'final_risk_score', final_risk_score, ts FROM alerts
  UNION ALL SELECT 'amount', amount, ts FROM alerts
),
drift_edge AS (
  SELECT feature, CASE WHEN max(x) <= 1 AND min(x) >= 0 THEN [i * 0.1::DOUBLE for i in range(1, 10)]
    ELSE quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) END AS es
  FROM drift_value WHERE ts < TIMESTAMP '2024-01-21' GROUP BY feature
),
drift_bin AS (
  SELECT feature, CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'reference'
      ELSE strftime(date_trunc('week', ts), '%Y-%m-%d') END AS period, len(list_filter(es, lambda e: e <= x)) AS bin
  FROM drift_value JOIN drift_edge USING (feature)
),
drift_count AS (SELECT feature, period, bin, count(*) AS n FROM drift_bin GROUP BY ALL),
drift_grid AS (
  SELECT feature, period, bin FROM (SELECT DISTINCT feature, period FROM drift_count), (SELECT unnest(range(0, 10)) AS bin)
),
drift_share AS (
  SELECT feature, period, bin, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER (PARTITION BY feature, period) + 10) AS s,
    sum(coalesce(n, 0)) OVER (PARTITION BY feature, period) AS total
  FROM drift_grid LEFT JOIN drift_count USING (feature, period, bin)
),
weekly_psi AS (
  SELECT a.feature, a.period, half_up(sum((a.s - e.s) * ln(a.s / e.s)), 4) AS psi
  FROM drift_share a JOIN drift_share e ON a.feature = e.feature AND a.bin = e.bin AND e.period = 'reference'
  WHERE a.period <> 'reference' AND a.total >= 50 GROUP BY ALL
),
drifted AS (SELECT feature FROM weekly_psi WHERE psi > 0.2::DOUBLE GROUP BY feature HAVING count(*) >= 2),
precision_ends AS (
  SELECT coalesce(count(*) >= 2 AND arg_max("precision", period) < arg_min("precision", period) * 0.9::DOUBLE, false) AS lost
  FROM weekly_precision
)"""


WEEK = "strftime(date_trunc('week', ts), '%Y-%m-%d')"

TOP_WEEK = f"""
best AS (
  SELECT {WEEK} AS period, is_fraud,
    row_number() OVER (PARTITION BY {WEEK} ORDER BY final_risk_score DESC, txn_id) AS place FROM alerts
),
weekly_precision AS (
  SELECT period, half_up(avg(CAST(is_fraud AS INTEGER)), 4) AS "precision" FROM best WHERE place <= 500
  GROUP BY period HAVING count(*) = 500
),
weekly_rate AS (
  SELECT {WEEK} AS period, half_up(avg(CAST(is_fraud AS INTEGER)), 4) AS fraud_rate FROM alerts GROUP BY 1
)"""

AT = A.rstrip() + "," + TOP_WEEK + "\n"

LINKS = """
links AS (
  SELECT DISTINCT CAST(account_id AS VARCHAR) AS account_id, kind, id FROM (
    SELECT account_id, 'device' AS kind, CAST(device_id AS VARCHAR) AS id FROM txn
    UNION ALL SELECT account_id, 'beneficiary', CAST(beneficiary_id AS VARCHAR) FROM txn
    UNION ALL SELECT account_id, 'ip', CAST(ip_id AS VARCHAR) FROM txn
    UNION ALL SELECT account_id, 'merchant', CAST(merchant_id AS VARCHAR) FROM txn) WHERE id IS NOT NULL
),
placed_links AS (SELECT *, row_number() OVER (PARTITION BY account_id, kind ORDER BY id) AS place FROM links),
lists AS (
  SELECT account_id,
    coalesce(string_agg(id, '|' ORDER BY id) FILTER (kind = 'device' AND place <= 20), '') AS connected_devices,
    coalesce(string_agg(id, '|' ORDER BY id) FILTER (kind = 'beneficiary' AND place <= 20), '') AS connected_beneficiaries,
    coalesce(string_agg(id, '|' ORDER BY id) FILTER (kind = 'ip' AND place <= 20), '') AS connected_ips,
    coalesce(string_agg(id, '|' ORDER BY id) FILTER (kind = 'merchant' AND place <= 10), '') AS connected_merchants,
    CAST(count(*) FILTER (kind <> 'merchant') AS INTEGER) AS total_neighbors, count(*) FILTER (kind = 'device') AS device_count,
    count(*) FILTER (kind = 'beneficiary') AS beneficiary_count, count(*) FILTER (kind = 'ip') AS ip_count,
    count(*) FILTER (kind = 'merchant') AS merchant_count
  FROM placed_links GROUP BY account_id
),
met AS (
  SELECT a.account_id, a.id AS device, b.account_id AS other,
    row_number() OVER (PARTITION BY a.account_id, a.id ORDER BY b.account_id) AS place
  FROM placed_links a JOIN links b ON a.id = b.id AND b.kind = 'device' AND a.account_id <> b.account_id
  WHERE a.kind = 'device' AND a.place <= 5
),
sharers AS (
  SELECT account_id, string_agg(other, '|' ORDER BY other) AS shared_device_accounts FROM (
    SELECT account_id, other, row_number() OVER (PARTITION BY account_id ORDER BY other) AS n
    FROM (SELECT DISTINCT account_id, other FROM met WHERE place <= 10)) WHERE n <= 20 GROUP BY account_id
),
around AS (
  SELECT lists.*, coalesce(shared_device_accounts, '') AS shared_device_accounts
  FROM lists LEFT JOIN sharers USING (account_id)
)"""

PATTERNS = """
patterns AS (
  SELECT account_id, count(*) FILTER (is_fan_out_source) AS fan_out_txns, count(*) FILTER (is_fan_in_target) AS fan_in_txns,
    count(*) FILTER (is_shared_device) AS shared_device_ring_txns, count(*) FILTER (structuring_flag) AS structuring_txns,
    count(*) FILTER (is_mule_chain_member) AS mule_chain_txns, count(*) AS total_transactions_checked,
    concat_ws('|', CASE WHEN bool_or(is_fan_out_source) THEN 'FAN_OUT' END,
      CASE WHEN bool_or(is_fan_in_target) THEN 'FAN_IN' END,
      CASE WHEN bool_or(is_shared_device) THEN 'SHARED_DEVICE_RING' END,
      CASE WHEN bool_or(structuring_flag) THEN 'STRUCTURING' END,
      CASE WHEN bool_or(is_mule_chain_member) THEN 'MULE_CHAIN' END) AS patterns_detected,
    greatest(0.0::DOUBLE, CASE WHEN bool_or(is_fan_out_source) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END,
      CASE WHEN bool_or(is_fan_in_target) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END,
      CASE WHEN bool_or(is_shared_device) THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END,
      CASE WHEN bool_or(structuring_flag) THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END,
      CASE WHEN bool_or(is_mule_chain_member) THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END) AS confidence
  FROM flags GROUP BY account_id
)"""

MEMOS = """
memos AS (
  SELECT 'CASE_' || lpad(CAST(txn_id AS VARCHAR), 8, '0') AS case_id, alert_id,
    CASE WHEN txn_id % 11 = 0 THEN 'ESCALATE' ELSE action END AS recommended_action,
    final_risk_score + CASE WHEN txn_id % 13 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
    CASE WHEN txn_id % 17 = 0 THEN 'URGENT' ELSE 'HIGH' END AS priority, reason_codes, account_id, device_id,
    merchant_id, beneficiary_id, txn_risk_score, behavior_anomaly_score, graph_risk_score, final_risk_score, amount
  FROM alerts WHERE action IN ('BLOCK', 'QUEUE_FOR_REVIEW', 'STEP_UP_AUTH')
),
checked AS (
  SELECT *, CASE WHEN recommended_action = 'ESCALATE' THEN 'invalid action' WHEN priority = 'URGENT' THEN 'invalid priority'
    WHEN confidence < 0 OR confidence > 1 THEN 'invalid confidence' END AS error FROM memos
)"""

M = A.rstrip() + "," + MEMOS + "\n"

KNOWN_CODES = [
    "NEW_DEVICE_HIGH_VALUE_TXN", "SHARED_DEVICE_CLUSTER", "STRUCTURING_PATTERN", "HIGH_GRAPH_FANOUT",
    "AMOUNT_4X_BASELINE", "DORMANT_ACCOUNT_REACTIVATION", "NEW_PAYEE_LARGE_TXN", "BURST_VELOCITY", "WATCHLIST_HIT",
    "MULE_CHAIN_DETECTED", "FAN_IN_PATTERN", "FAN_OUT_PATTERN", "IP_COUNTRY_MISMATCH", "HIGH_RISK_MERCHANT",
]
CODE_LIST = "[" + ", ".join(f"'{c}'" for c in KNOWN_CODES) + "]"

QUALITY_COLUMNS = [
    "txn_id", "account_id", "merchant_id", "beneficiary_id", "device_id", "ip_id", "amount", "currency",
    "txn_type", "channel", "ts", "is_fraud",
]


def _null_rates() -> str:
    return " UNION ALL ".join(
        f"SELECT '{'timestamp' if c == 'ts' else c}' AS column_name, "
        f"avg(CAST({c} IS NULL AS INTEGER)) AS null_rate FROM txn" for c in QUALITY_COLUMNS
    )


FINDINGS = """
rates AS (""" + _null_rates() + """),
found AS (
  SELECT CASE WHEN column_name IN ('txn_id', 'account_id', 'amount', 'timestamp', 'is_fraud') THEN
      CASE WHEN null_rate > 0 THEN 'error' END
    WHEN null_rate > 0.05::DOUBLE THEN 'warning' END AS severity, column_name, half_up(null_rate, 4) AS value
  FROM rates
)"""

Q = T.rstrip() + "," + FINDINGS + "\n"

TRANSFERS = """
transfers AS (
  SELECT txn_id, account_id, beneficiary_id, ts_epoch, amount FROM txn WHERE beneficiary_id <> account_id
)"""

_SQL: dict[str, str] = {
    "canonical_transactions": T + f"""SELECT txn_id, account_id, merchant_id, beneficiary_id, device_id, ip_id, amount,
  currency, txn_type, channel, strftime(ts, {STAMP}) AS timestamp, is_fraud, fraud_scenario, source, ts_epoch FROM txn""",
    "mobile_money_canonical": with_(TXN, RAW) + f"""SELECT 'TXN_PS_' || no AS txn_id, 'ACC_' || nameOrig AS account_id,
  CAST(NULL AS VARCHAR) AS merchant_id, 'ACC_' || nameDest AS beneficiary_id, CAST(NULL AS VARCHAR) AS device_id,
  CAST(NULL AS VARCHAR) AS ip_id, amount, 'USD' AS currency, type AS txn_type, 'MOBILE' AS channel,
  strftime(TIMESTAMP '2024-01-01' + to_hours(step), {STAMP}) AS timestamp, isFraud = 1 AS is_fraud,
  CASE WHEN isFraud = 1 THEN 'PAYSIM_FRAUD' END AS fraud_scenario, 'PAYSIM' AS source FROM numbered""",
    "aml_canonical": with_(TXN, RAW, REPORTS) + f"""SELECT 'TXN_AML_' || no AS txn_id, 'ACC_AML_' || nameOrig AS account_id,
  CAST(NULL AS VARCHAR) AS merchant_id, 'ACC_AML_' || nameDest AS beneficiary_id, CAST(NULL AS VARCHAR) AS device_id,
  CAST(NULL AS VARCHAR) AS ip_id, amount, 'USD' AS currency, type AS txn_type, 'ONLINE' AS channel,
  strftime(TIMESTAMP '2024-01-01' + to_hours(step), {STAMP}) AS timestamp,
  isFraud = 1 OR scenario IS NOT NULL AS is_fraud,
  CASE WHEN isFraud = 1 OR scenario IS NOT NULL THEN coalesce(scenario, 'AMLSIM_AML') END AS fraud_scenario,
  'AMLSIM' AS source FROM numbered LEFT JOIN reported USING (nameOrig)""",
    "derived_accounts": T + """SELECT DISTINCT account_id, 'CUST_' || account_id AS customer_id, 'CHECKING' AS account_type,
  0.0::DOUBLE AS balance, 'ACTIVE' AS status, '2024-01-01 00:00:00' AS created_at FROM txn""",
    "owner_edges": T + "SELECT DISTINCT 'CUST_' || account_id AS customer_id, account_id FROM txn",
    "first_order_per_customer": """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
    "velocity_features": F_ + f"SELECT txn_id, account_id, {VELOCITY} FROM feat",
    "behavior_features": F_ + f"SELECT txn_id, account_id, {BEHAVIOR} FROM feat",
    "rolling_features_sweep": F_ + f"SELECT txn_id, account_id, {VELOCITY}, {BEHAVIOR} FROM feat",
    "merchant_ip_features": R + f"SELECT txn_id, {MERCHANT_IP} FROM rich",
    "merchant_ip_defaults": T + """SELECT txn_id, 0.0::DOUBLE AS merchant_fraud_rate_hist, CAST(NULL AS VARCHAR) AS mcc_code,
  'LOW' AS mcc_risk_tier, false AS ip_is_vpn, CAST(NULL AS VARCHAR) AS ip_country FROM txn""",
    "transaction_features": R + f"""SELECT txn_id, account_id, merchant_id, beneficiary_id, device_id, ip_id, amount,
  txn_type, channel, strftime(ts, {STAMP}) AS timestamp, is_fraud, fraud_scenario, source,
  {VELOCITY}, {BEHAVIOR}, {MERCHANT_IP} FROM rich""",
    "account_profiles": F_.rstrip() + "," + PROFILES + """ SELECT account_id, total_txn_count, half_up(avg_amount, 6) AS avg_amount,
  max_amount, half_up(std_amount, 6) AS std_amount, unique_merchants, unique_beneficiaries, unique_devices,
  half_up(avg_txn_count_7d, 6) AS avg_txn_count_7d, half_up(avg_amount_sum_24h, 6) AS avg_amount_sum_24h, has_fraud
  FROM profiles""",
    "account_device_edges": T + f"""SELECT account_id, device_id, strftime(min(ts), {STAMP}) AS first_seen,
  strftime(max(ts), {STAMP}) AS last_seen, count(*) AS txn_count FROM txn GROUP BY ALL""",
    "device_ip_edges": T + f"""SELECT device_id, ip_id, strftime(min(ts), {STAMP}) AS first_seen,
  strftime(max(ts), {STAMP}) AS last_seen FROM txn GROUP BY ALL""",
    "graph_edges": with_(TXN, EDGES) + "SELECT * FROM edges",
    "heaviest_edges": with_(TXN, EDGES) + """SELECT * FROM edges
  QUALIFY row_number() OVER (PARTITION BY edge_type ORDER BY txn_count DESC, src, dst) <= 100""",
    "beneficiary_totals": T + """SELECT account_id, beneficiary_id, count(*) AS total_txns, sum(amount) AS total_amount
  FROM txn WHERE beneficiary_id IS NOT NULL GROUP BY ALL""",
    "merchant_totals": T + """SELECT account_id, merchant_id, count(*) AS total_txns, sum(amount) AS total_amount
  FROM txn WHERE merchant_id IS NOT NULL GROUP BY ALL""",
    "daily_fan_out": T + """SELECT account_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  count(DISTINCT beneficiary_id) AS unique_beneficiaries_day FROM txn GROUP BY ALL HAVING unique_beneficiaries_day >= 5""",
    "daily_fan_in": T + """SELECT beneficiary_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  count(DISTINCT account_id) AS unique_senders_day FROM txn WHERE beneficiary_id IS NOT NULL
  GROUP BY ALL HAVING unique_senders_day >= 2""",
    "shared_devices": T + """SELECT device_id, count(DISTINCT account_id) AS unique_accounts FROM txn
  GROUP BY ALL HAVING unique_accounts >= 3""",
    "structuring_buckets": T + """SELECT account_id, beneficiary_id, ts_epoch // 259200 AS bucket,
  count(*) AS near_threshold_txns FROM txn WHERE amount BETWEEN 500 AND 9999 AND beneficiary_id IS NOT NULL
  GROUP BY ALL HAVING near_threshold_txns >= 2""",
    "account_label_rate": T + """SELECT account_id, half_up(avg(CAST(is_fraud AS INTEGER)), 6) AS account_fraud_rate
  FROM txn GROUP BY ALL""",
    "account_label_rate_before_cutoff": T + """SELECT account_id,
  half_up(avg(CAST(is_fraud AS INTEGER)), 6) AS account_fraud_rate FROM txn WHERE ts < TIMESTAMP '2024-01-21' GROUP BY ALL""",
    "senders_and_receivers": T + """SELECT DISTINCT account_id FROM txn
  WHERE account_id IN (SELECT beneficiary_id FROM txn WHERE beneficiary_id IS NOT NULL)""",
    "topology_flags": L + f"SELECT txn_id, {FLAG_COLUMNS} FROM flags",
    "node_features": G + "SELECT * FROM nodes",
    "projected_degree": P + """SELECT u AS account_id, (SELECT count(*) FROM uses x WHERE x.account_id = u AND x.device_id IN
    (SELECT device_id FROM uses GROUP BY device_id HAVING count(*) > 1)) AS shared_devices,
  CAST(sum(weight) AS BIGINT) AS weighted_degree,
  (SELECT max(n) - 1 FROM (SELECT device_id, count(*) AS n FROM uses GROUP BY device_id) JOIN uses y USING (device_id)
    WHERE y.account_id = u) AS largest_ring
  FROM (SELECT account_a AS u, weight FROM pairs UNION ALL SELECT account_b, weight FROM pairs) GROUP BY u""",
    "projected_links": P + """SELECT account_a, account_b, weight FROM pairs WHERE EXISTS (
  SELECT 1 FROM uses m JOIN (SELECT device_id, min(account_id) AS head FROM uses GROUP BY device_id) USING (device_id)
  WHERE head = account_a AND m.account_id = account_b)""",
    "components": with_(TXN, EDGES, PAIRS, REACH, recursive=True) + "SELECT * FROM component",
    "community_features": with_(TXN, EDGES, PAIRS, REACH, recursive=True) + """SELECT account_id, community_id,
  community_size, half_up(community_fraud_rate, 6) AS community_fraud_rate FROM rated""",
    # Accounts that share a device here form cliques, where communities and components agree.
    "communities": with_(TXN, EDGES, PAIRS, REACH, recursive=True) + "SELECT account_id, community_id FROM placed",
    "communities_of_ring": """SELECT CAST(c_custkey AS VARCHAR) AS account_id,
  min(CAST(c_custkey AS VARCHAR)) OVER (PARTITION BY c_custkey % (SELECT floor(sqrt(count(*)))::BIGINT FROM customer)) AS community_id
  FROM customer""",
    "community_summary": with_(TXN, EDGES, PAIRS, REACH, recursive=True) + """SELECT count(DISTINCT community_id) AS communities,
  half_up(avg(community_size), 6) AS avg_community_size, half_up(avg(community_fraud_rate), 6) AS avg_community_fraud_rate
  FROM rated""",
    "graph_features": C + """SELECT * REPLACE (half_up(community_fraud_rate, 6) AS community_fraud_rate,
  half_up(graph_risk_score, 6) AS graph_risk_score) FROM graph_rated""",
    "detect_fan_out": T + """SELECT DISTINCT account_id, ts_epoch, beneficiaries FROM (
  SELECT account_id, ts_epoch, count(DISTINCT beneficiary_id) OVER (PARTITION BY account_id ORDER BY ts_epoch
    RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS beneficiaries FROM txn WHERE beneficiary_id IS NOT NULL)
  WHERE beneficiaries >= 3""",
    "detect_fan_in": T + """SELECT DISTINCT beneficiary_id, ts_epoch, senders FROM (
  SELECT beneficiary_id, ts_epoch, count(DISTINCT account_id) OVER (PARTITION BY beneficiary_id ORDER BY ts_epoch
    RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS senders FROM txn WHERE beneficiary_id IS NOT NULL)
  WHERE senders >= 5""",
    "detect_fan_in_same_ip": T + """SELECT DISTINCT beneficiary_id, ip_id, ts_epoch, senders FROM (
  SELECT beneficiary_id, ip_id, ts_epoch, count(DISTINCT account_id) OVER (PARTITION BY beneficiary_id, ip_id
    ORDER BY ts_epoch RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS senders FROM txn
  WHERE beneficiary_id IS NOT NULL) WHERE senders >= 2""",
    "detect_structuring": T + """SELECT DISTINCT account_id, beneficiary_id, ts_epoch, near_threshold_txns, near_threshold_amount
  FROM (SELECT account_id, beneficiary_id, ts_epoch, count(*) OVER w AS near_threshold_txns,
      sum(amount) OVER w AS near_threshold_amount FROM txn
    WHERE amount BETWEEN 500 AND 9999 AND beneficiary_id IS NOT NULL
    WINDOW w AS (PARTITION BY account_id, beneficiary_id ORDER BY ts_epoch RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW))
  WHERE near_threshold_txns >= 2""",
    "detect_takeover_burst": F_ + """SELECT txn_id, account_id, amount, half_up(days_since_last_txn, 6) AS days_since_last_txn
  FROM feat WHERE days_since_last_txn >= 0.5 AND is_new_device AND is_new_beneficiary AND amount >= 100""",
    "detect_dormant_reactivation": F_ + """SELECT txn_id, account_id, half_up(days_since_last_txn, 6) AS days_since_last_txn,
  'DORMANT_ACCOUNT_REACTIVATION' AS reason_code FROM feat WHERE days_since_last_txn >= 1""",
    "detect_high_graph_fanout": G + """SELECT account_id, account_degree, 'HIGH_GRAPH_FANOUT' AS reason_code FROM nodes
  WHERE account_degree > 35""",
    "detect_shared_device_ring": T + f"""SELECT device_id, ring_size, account_id, count(*) AS txn_count,
  strftime(min(ts), {STAMP}) AS first_seen, strftime(max(ts), {STAMP}) AS last_seen FROM txn JOIN (
    SELECT device_id, count(DISTINCT account_id) AS ring_size FROM txn GROUP BY device_id HAVING ring_size >= 4
  ) USING (device_id) GROUP BY ALL""",
    "forwarded_transfers": T.rstrip() + "," + TRANSFERS + """SELECT a.txn_id, a.account_id, a.beneficiary_id, a.ts_epoch, a.amount,
  count(*) AS onward_txns, sum(b.amount) AS onward_amount, min(b.ts_epoch - a.ts_epoch) AS seconds_to_first
  FROM transfers a JOIN transfers b ON a.beneficiary_id = b.account_id
    AND b.ts_epoch > a.ts_epoch AND b.ts_epoch <= a.ts_epoch + 86400 GROUP BY ALL""",
    "money_chains": T.rstrip() + "," + TRANSFERS + """,
next AS (
  SELECT a.txn_id AS a, b.txn_id AS b FROM transfers a JOIN transfers b ON a.beneficiary_id = b.account_id
    AND b.ts_epoch > a.ts_epoch AND b.ts_epoch <= a.ts_epoch + 86400
),
two AS (SELECT a AS txn_id, count(*) AS chains_2 FROM next GROUP BY 1),
three AS (SELECT x.a AS txn_id, count(*) AS chains_3 FROM next x JOIN next y ON x.b = y.a GROUP BY 1),
four AS (SELECT x.a AS txn_id, count(*) AS chains_4 FROM next x JOIN next y ON x.b = y.a JOIN next z ON y.b = z.a GROUP BY 1)
SELECT txn_id, account_id, beneficiary_id, ts_epoch, amount, chains_2, coalesce(chains_3, 0) AS chains_3,
  coalesce(chains_4, 0) AS chains_4, CAST(CASE WHEN chains_4 > 0 THEN 4 WHEN chains_3 > 0 THEN 3 ELSE 2 END AS INTEGER) AS hops
FROM transfers JOIN two USING (txn_id) LEFT JOIN three USING (txn_id) LEFT JOIN four USING (txn_id)""",
    "null_rates": T + "SELECT column_name, half_up(null_rate, 6) AS null_rate FROM (" + _null_rates() + ")",
    "record_counts": T + """SELECT 'transactions' AS key, count(*) AS value FROM txn
  UNION ALL SELECT 'unique_accounts', count(DISTINCT account_id) FROM txn
  UNION ALL SELECT 'devices', count(DISTINCT device_id) FROM txn
  UNION ALL SELECT 'ips', count(DISTINCT ip_id) FROM txn""",
    "label_distribution": T + """SELECT source, count(*) FILTER (is_fraud) AS fraud_count, count(*) AS total_count,
  half_up(count(*) FILTER (is_fraud) / count(*), 4) AS fraud_rate FROM txn GROUP BY source""",
    "scenario_counts": T + """SELECT fraud_scenario, count(*) AS fraud_count FROM txn
  WHERE is_fraud AND fraud_scenario IS NOT NULL GROUP BY 1""",
    "coverage": T + f"""SELECT strftime(min(ts), {STAMP}) AS min_timestamp, strftime(max(ts), {STAMP}) AS max_timestamp,
  half_up(1 - avg(CAST(device_id IS NULL AS INTEGER)), 4) AS device_coverage,
  half_up(1 - avg(CAST(ip_id IS NULL AS INTEGER)), 4) AS ip_coverage FROM txn""",
    "uniqueness": T + """SELECT count(*) AS row_count, count(DISTINCT txn_id) AS distinct_keys,
  count(*) = count(DISTINCT txn_id) AS is_unique FROM txn""",
    "duplicate_order_keys": "SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY 1 HAVING copies > 1",
    "quality_findings": Q + "SELECT severity, column_name, value FROM found WHERE severity IS NOT NULL",
    "quality_report": Q + f"""SELECT 'record_counts' AS section, 'transactions' AS key, CAST(count(*) AS VARCHAR) AS value FROM txn
  UNION ALL SELECT 'record_counts', 'unique_accounts', CAST(count(DISTINCT account_id) AS VARCHAR) FROM txn
  UNION ALL SELECT 'record_counts', 'devices', CAST(count(DISTINCT device_id) AS VARCHAR) FROM txn
  UNION ALL SELECT 'record_counts', 'ips', CAST(count(DISTINCT ip_id) AS VARCHAR) FROM txn
  UNION ALL SELECT 'null_rates', column_name, CAST(half_up(null_rate, 4) AS VARCHAR) FROM rates
  UNION ALL SELECT 'fraud_count_by_source', source, CAST(count(*) FILTER (is_fraud) AS VARCHAR) FROM txn GROUP BY source
  UNION ALL SELECT 'total_count_by_source', source, CAST(count(*) AS VARCHAR) FROM txn GROUP BY source
  UNION ALL SELECT 'fraud_rate_by_source', source, CAST(half_up(count(*) FILTER (is_fraud) / count(*), 4) AS VARCHAR)
    FROM txn GROUP BY source
  UNION ALL SELECT 'fraud_by_scenario', fraud_scenario, CAST(count(*) AS VARCHAR) FROM txn WHERE is_fraud GROUP BY fraud_scenario
  UNION ALL SELECT 'coverage', 'min', strftime(min(ts), {STAMP}) FROM txn
  UNION ALL SELECT 'coverage', 'max', strftime(max(ts), {STAMP}) FROM txn
  UNION ALL SELECT 'coverage', 'device_assignment_coverage', CAST(half_up(avg(CAST(device_id IS NOT NULL AS INTEGER)), 4) AS VARCHAR) FROM txn
  UNION ALL SELECT 'coverage', 'ip_assignment_coverage', CAST(half_up(avg(CAST(ip_id IS NOT NULL AS INTEGER)), 4) AS VARCHAR) FROM txn
  UNION ALL SELECT 'uniqueness', 'txn_id_unique', CAST(count(*) = count(DISTINCT txn_id) AS VARCHAR) FROM txn
  UNION ALL SELECT 'findings', column_name, severity FROM found WHERE severity IS NOT NULL""",
    "merged_signals": X + f"""SELECT txn_id, graph_risk_score, is_new_device, is_new_beneficiary,
  half_up(amount_vs_30d_avg, 6) AS amount_vs_30d_avg, half_up(merchant_fraud_rate_hist, 6) AS merchant_fraud_rate_hist,
  ip_is_vpn, {FLAG_COLUMNS} FROM signals""",
    "fusion_decisions": D + """SELECT txn_id, half_up(final_risk_score, 6) AS final_risk_score, risk_band, action, reason_codes
  FROM alerts""",
    "fusion_full_rules": DF + """SELECT txn_id, half_up(final_risk_score, 6) AS final_risk_score, risk_band, action, reason_codes
  FROM alerts""",
    "alert_table": D + f"""SELECT txn_id, account_id, strftime(ts, {STAMP}) AS timestamp, amount, is_fraud, fraud_scenario,
  txn_risk_score, behavior_anomaly_score, graph_risk_score, half_up(final_risk_score, 6) AS final_risk_score, risk_band,
  action, reason_codes, 'ALT_' || lpad(CAST(row_number() OVER (ORDER BY ts, txn_id) - 1 AS VARCHAR), 8, '0') AS alert_id,
  strftime(ts, {STAMP}) AS triggered_at FROM alerts""",
    "alert_queue": A + f"""SELECT alert_id, txn_id, strftime(ts, {STAMP}) AS timestamp, account_id, half_up(amount, 2) AS amount,
  half_up(final_risk_score, 4) AS risk_score, risk_band, action, is_fraud FROM alerts WHERE action = 'BLOCK'
  ORDER BY final_risk_score DESC, txn_id LIMIT 200""",
    "alert_search": A + f"""SELECT alert_id, txn_id, strftime(ts, {STAMP}) AS timestamp, account_id, half_up(amount, 2) AS amount,
  half_up(final_risk_score, 4) AS risk_score, risk_band, action, is_fraud FROM alerts
  WHERE contains(CAST(account_id AS VARCHAR), '1') ORDER BY final_risk_score DESC, txn_id LIMIT 500""",
    "selection_metrics": A + """SELECT count(*) AS total_alerts, count(*) FILTER (is_fraud) AS fraud_in_selection,
  half_up(avg(final_risk_score), 6) AS avg_risk_score, half_up(avg(CAST(is_fraud AS INTEGER)), 6) AS "precision" FROM (
    SELECT * FROM alerts WHERE risk_band IN ('CRITICAL', 'HIGH', 'ELEVATED')
      AND action IN ('BLOCK', 'QUEUE_FOR_REVIEW', 'STEP_UP_AUTH') ORDER BY final_risk_score DESC, txn_id LIMIT 300)""",
    "action_distribution": A + """SELECT action, count(*) AS alert_count,
  half_up(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM alerts GROUP BY action""",
    "band_distribution": A + """SELECT risk_band, count(*) AS alert_count,
  half_up(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM alerts GROUP BY risk_band""",
    "tier_precision": A + """SELECT action, count(*) AS alert_count, count(*) FILTER (is_fraud) AS fraud_count,
  half_up(avg(CAST(is_fraud AS INTEGER)), 6) AS fraud_rate FROM alerts GROUP BY action""",
    "reason_frequency": A + """SELECT reason_code, count(*) AS alert_count FROM (
  SELECT unnest(string_split(reason_codes, '|')) AS reason_code FROM alerts WHERE reason_codes <> '')
  GROUP BY 1 ORDER BY alert_count DESC, reason_code LIMIT 10""",
    "score_summary": A + """SELECT half_up(avg(final_risk_score), 6) AS mean, half_up(quantile_cont(final_risk_score, 0.5), 6) AS p50,
  half_up(quantile_cont(final_risk_score, 0.95), 6) AS p95, half_up(quantile_cont(final_risk_score, 0.99), 6) AS p99,
  half_up(max(final_risk_score), 6) AS max FROM alerts""",
    "overview": A + """SELECT count(*) AS transactions, count(*) FILTER (is_fraud) AS fraud_count,
  half_up(avg(CAST(is_fraud AS INTEGER)), 6) AS fraud_rate, count(*) FILTER (action = 'ALLOW') AS allow,
  count(*) FILTER (action = 'ALLOW_WITH_MONITORING') AS allow_with_monitoring,
  count(*) FILTER (action = 'STEP_UP_AUTH') AS step_up_auth,
  count(*) FILTER (action = 'QUEUE_FOR_REVIEW') AS queue_for_review, count(*) FILTER (action = 'BLOCK') AS block
  FROM alerts""",
    "alert_volume": A + f"""SELECT {WEEK} AS period, count(*) AS total, count(*) FILTER (is_fraud) AS fraud_count,
  half_up(avg(CAST(is_fraud AS INTEGER)), 6) AS fraud_rate FROM alerts GROUP BY 1""",
    "action_by_period": A + f"""SELECT {WEEK} AS period, count(*) FILTER (action = 'ALLOW') AS ALLOW,
  count(*) FILTER (action = 'ALLOW_WITH_MONITORING') AS ALLOW_WITH_MONITORING,
  count(*) FILTER (action = 'STEP_UP_AUTH') AS STEP_UP_AUTH,
  count(*) FILTER (action = 'QUEUE_FOR_REVIEW') AS QUEUE_FOR_REVIEW, count(*) FILTER (action = 'BLOCK') AS BLOCK
  FROM alerts GROUP BY 1""",
    "score_histogram": A.rstrip() + """,
span AS (SELECT min(final_risk_score) AS lo, max(final_risk_score) AS hi FROM alerts),
binned AS (
  SELECT least(CAST(floor((final_risk_score - lo) / (hi - lo) * 20.0::DOUBLE) AS INTEGER), 19) AS bin, count(*) AS n
  FROM alerts, span GROUP BY 1
)
SELECT CAST(b AS INTEGER) AS bin, half_up(lo + b * ((hi - lo) / 20), 6) AS lower, coalesce(n, 0) AS bin_count
FROM (SELECT unnest(range(0, 20)) AS b) CROSS JOIN span LEFT JOIN binned ON b = bin""",
    "latest_alerts": A + f"""SELECT alert_id, half_up(final_risk_score, 6) AS final_risk_score, risk_band,
  strftime(ts, {STAMP}) AS triggered_at FROM (SELECT * FROM alerts ORDER BY ts DESC, alert_id DESC LIMIT 500)
  WHERE risk_band = 'HIGH'""",
    "picked_alerts": A + """SELECT alert_id, txn_id, action FROM alerts WHERE action = 'BLOCK' ORDER BY alert_id LIMIT 3""",
    "split_summary": T + f"""SELECT CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'test' END AS split,
  count(*) AS row_count, count(*) FILTER (is_fraud) AS fraud_count,
  half_up(avg(CAST(is_fraud AS INTEGER)), 6) AS fraud_rate, strftime(min(ts), {STAMP}) AS first_timestamp,
  strftime(max(ts), {STAMP}) AS last_timestamp FROM txn GROUP BY 1""",
    "class_balance": T + """SELECT count(*) FILTER (is_fraud) AS positives, count(*) FILTER (NOT is_fraud) AS negatives,
  half_up(count(*) FILTER (NOT is_fraud) / greatest(count(*) FILTER (is_fraud), 1), 6) AS positive_weight FROM txn""",
    "prepared_features": with_(TXN, FEAT, DIMS, RICH, FLAGS, EDGES, NODES) + f"""SELECT txn_id, CAST(is_fraud AS INTEGER) AS is_fraud,
  {VELOCITY}, half_up(amount_vs_30d_avg, 6) AS amount_vs_30d_avg, half_up(amount_vs_30d_max, 6) AS amount_vs_30d_max,
  half_up(days_since_last_txn, 6) AS days_since_last_txn, half_up(merchant_fraud_rate_hist, 6) AS merchant_fraud_rate_hist,
  account_degree, device_shared_account_count, beneficiary_in_degree, num_devices, num_beneficiaries,
  {", ".join(f"CAST(coalesce({c}, false) AS INTEGER) AS {c}" for c in
             ["is_new_device", "is_new_beneficiary", "ip_is_vpn", *FLAG_COLUMNS.split(", ")])},
  mcc_risk_tier, channel, txn_type
  FROM rich JOIN (SELECT * EXCLUDE (account_id) FROM flags) USING (txn_id)
  LEFT JOIN nodes ON nodes.account_id = CAST(rich.account_id AS VARCHAR)""",
    "ranking_metrics": S.rstrip() + """,
level AS (
  SELECT txn_risk_score AS s, count(*) FILTER (is_fraud) AS pos, count(*) FILTER (NOT is_fraud) AS neg FROM scored GROUP BY 1
),
run AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM level),
total AS (SELECT sum(pos) AS p, sum(neg) AS n FROM level)
SELECT CAST(max(p) AS BIGINT) AS positives, CAST(max(n) AS BIGINT) AS negatives,
  half_up(sum(pos * (tp / (tp + fp))) / max(p), 6) AS average_precision,
  half_up(sum(pos * (n - fp + neg / 2.0)) / (max(p) * max(n)), 6) AS roc_auc FROM run, total""",
    "budget_metrics": S.rstrip() + """,
test AS (SELECT * FROM scored WHERE ts >= TIMESTAMP '2024-01-21'),
size AS (
  SELECT greatest(1, (max(ts_epoch) - min(ts_epoch)) // 86400) AS days, count(*) AS n, count(*) FILTER (is_fraud) AS p FROM test
),
cut AS (SELECT days, least(50 * days, n) AS budget, p FROM size),
placed AS (SELECT is_fraud, row_number() OVER (ORDER BY txn_risk_score DESC, txn_id) AS place FROM test)
SELECT days AS test_days, budget AS alert_budget, count(*) FILTER (is_fraud AND place <= budget) AS hits,
  half_up(count(*) FILTER (is_fraud AND place <= budget) / budget, 6) AS precision_at_budget,
  half_up(count(*) FILTER (is_fraud AND place <= budget) / greatest(p, 1), 6) AS recall_at_budget
FROM placed, cut GROUP BY days, budget, p""",
    "score_separation": S + """SELECT is_fraud, half_up(avg(behavior_anomaly_score), 6) AS mean_score, count(*) AS row_count
  FROM scored GROUP BY 1""",
    "psi_by_month": _psi() + "SELECT feature, period, psi FROM psi",
    "psi_heat_table": _psi() + "SELECT * FROM (PIVOT psi ON period USING max(psi) GROUP BY feature)",
    "psi_two_tables": """WITH edges AS (
  SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS es FROM lineitem
  WHERE l_shipdate < TIMESTAMP '1998-01-01'
),
b AS (SELECT l_shipdate < TIMESTAMP '1998-01-01' AS ref, len(list_filter(es, lambda e: e <= l_extendedprice)) AS bin FROM lineitem, edges),
n AS (SELECT bin, count(*) FILTER (ref) AS e, count(*) FILTER (NOT ref) AS a FROM b GROUP BY bin),
s AS (SELECT (e + 1) / (sum(e) OVER () + 10) AS es, (a + 1) / (sum(a) OVER () + 10) AS sa FROM n)
SELECT 'l_extendedprice' AS feature, half_up(sum((sa - es) * ln(sa / es)), 4) AS psi FROM s""",
    "top_precision": AT + 'SELECT period, "precision" FROM weekly_precision',
    "label_rate": AT + "SELECT period, fraud_rate FROM weekly_rate",
    "drift_verdict": AT.rstrip() + "," + _alert_psi() + """
SELECT (SELECT count(*) FROM drifted) AS drifted_features,
  coalesce((SELECT string_agg(feature, '|' ORDER BY feature) FROM drifted), '') AS drift_features,
  lost AS precision_degradation, (SELECT count(*) FROM drifted) >= 2 OR lost AS retraining_recommended
FROM precision_ends""",
    "alert_psi": AT.rstrip() + "," + _alert_psi() + " SELECT feature, period, psi FROM weekly_psi",
    "monitoring_series": AT + """SELECT period, half_up("precision" * 100, 1) AS precision_pct,
  half_up(fraud_rate * 100, 1) AS fraud_rate_pct FROM weekly_rate LEFT JOIN weekly_precision USING (period)""",
    "transaction_detail": with_(TXN, SCORED, PLAIN, _decided("plain"), FEAT) + f"""SELECT a.txn_id, a.account_id, a.amount,
  strftime(a.ts, {STAMP}) AS timestamp, txn_risk_score, behavior_anomaly_score,
  half_up(final_risk_score, 6) AS final_risk_score, action, risk_band, reason_codes, a.is_fraud, a.fraud_scenario,
  f.device_id, f.ip_id, f.merchant_id, f.beneficiary_id, f.channel, f.txn_type,
  half_up(f.amount_vs_30d_avg, 6) AS amount_vs_30d_avg, f.is_new_device, f.is_new_beneficiary
  FROM alerts a JOIN feat f USING (txn_id) WHERE action = 'BLOCK'""",
    "account_history": A.rstrip() + """,
recent AS (SELECT * FROM alerts JOIN (SELECT account_id, max(ts) AS last FROM alerts GROUP BY 1) USING (account_id)
  WHERE ts >= last - INTERVAL 7 DAYS),
acts AS (SELECT account_id, string_agg(action || '=' || n, '|' ORDER BY action || '=' || n) AS actions
  FROM (SELECT account_id, action, count(*) AS n FROM recent GROUP BY ALL) GROUP BY 1)
SELECT account_id, CAST(7 AS INTEGER) AS window_days, count(*) AS total_transactions, half_up(sum(amount), 2) AS total_amount,
  half_up(avg(amount), 2) AS avg_amount, half_up(max(amount), 2) AS max_amount, half_up(min(amount), 2) AS min_amount,
  count(*) FILTER (is_fraud) AS fraud_count, half_up(avg(final_risk_score), 4) AS avg_risk_score,
  half_up(max(final_risk_score), 4) AS max_risk_score, actions,
  strftime(last - INTERVAL 7 DAYS, '%Y-%m-%d') || ' to ' || strftime(last, '%Y-%m-%d') AS date_range
FROM recent JOIN acts USING (account_id) GROUP BY account_id, actions, last""",
    "velocity_snapshot": F_ + f"""SELECT account_id, txn_id AS as_of_txn, txn_count_1h, txn_count_24h, txn_count_7d,
  half_up(amount_sum_1h, 2) AS amount_sum_1h, half_up(amount_sum_24h, 2) AS amount_sum_24h, unique_merchants_7d,
  unique_beneficiaries_7d, unique_devices_30d FROM feat
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, txn_id DESC) = 1""",
    "neighborhood": with_(TXN, LINKS) + "SELECT * FROM around",
    "neighbors": with_(TXN, LINKS) + """, owned AS (
  SELECT 'account' AS owner_type, account_id AS owner_id, kind, id FROM links
  UNION ALL SELECT 'device', id, 'account', account_id FROM links WHERE kind = 'device'
)
SELECT *, count(*) OVER (PARTITION BY owner_type, owner_id, kind) AS kind_count FROM owned""",
    "co_users": with_(TXN, LINKS) + """SELECT DISTINCT a.account_id, b.account_id AS id
  FROM links a JOIN links b ON a.id = b.id AND a.account_id <> b.account_id
  WHERE a.kind = 'device' AND b.kind = 'device' AND CAST(a.account_id AS BIGINT) % 100 = 0""",
    "neighborhood_whole": with_(TXN, LINKS) + """, mine AS (SELECT * FROM links WHERE CAST(account_id AS BIGINT) % 100 = 0),
met_all AS (
  SELECT DISTINCT a.account_id, b.account_id AS id FROM mine a JOIN links b ON a.id = b.id AND b.kind = 'device' AND a.account_id <> b.account_id
  WHERE a.kind = 'device'
),
everything AS (SELECT * FROM mine UNION ALL SELECT account_id, 'account', id FROM met_all)
SELECT account_id,
  coalesce(string_agg(id, '|' ORDER BY id) FILTER (kind = 'device'), '') AS connected_devices,
  coalesce(string_agg(id, '|' ORDER BY id) FILTER (kind = 'beneficiary'), '') AS connected_beneficiaries,
  coalesce(string_agg(id, '|' ORDER BY id) FILTER (kind = 'ip'), '') AS connected_ips,
  coalesce(string_agg(id, '|' ORDER BY id) FILTER (kind = 'merchant'), '') AS connected_merchants,
  coalesce(string_agg(id, '|' ORDER BY id) FILTER (kind = 'account'), '') AS shared_device_accounts,
  count(*) FILTER (kind = 'device') AS device_count, count(*) FILTER (kind = 'beneficiary') AS beneficiary_count,
  count(*) FILTER (kind = 'ip') AS ip_count, count(*) FILTER (kind = 'merchant') AS merchant_count,
  CAST(count(*) FILTER (kind IN ('device', 'beneficiary', 'ip')) AS INTEGER) AS total_neighbors
  FROM everything GROUP BY account_id""",
    "device_users": with_(TXN, LINKS) + """SELECT device_id,
  string_agg(account_id, '|' ORDER BY account_id) FILTER (n <= 20) AS accounts_using_device,
  count(*) AS account_count, count(*) > 1 AS is_shared FROM (
    SELECT id AS device_id, account_id, row_number() OVER (PARTITION BY id ORDER BY account_id) AS n
    FROM links WHERE kind = 'device') GROUP BY device_id""",
    "reachable_entities": with_(TXN, EDGES) + """, typed AS (
  SELECT split_part(edge_type, '_', 1) AS ft, src AS f, split_part(edge_type, '_', 2) AS tt, dst AS t FROM edges
  UNION ALL SELECT split_part(edge_type, '_', 2), dst, split_part(edge_type, '_', 1), src FROM edges
),
near AS (SELECT DISTINCT * FROM typed),
one AS (SELECT f AS start_id, tt, t, 1 AS hop FROM near WHERE ft = 'ip'),
two AS (SELECT start_id, n.tt, n.t, 2 AS hop FROM one JOIN near n ON one.tt = n.ft AND one.t = n.f)
SELECT 'ip' AS start_type, start_id, tt AS vertex_type, t AS vertex_id, CAST(min(hop) AS INTEGER) AS hop
FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE NOT (tt = 'ip' AND t = start_id) GROUP BY ALL""",
    "graph_patterns": with_(TXN, FLAGS, PATTERNS, EDGES, NODES) + """SELECT p.*,
  CASE WHEN device_shared_account_count > 3 THEN device_shared_account_count END AS shared_with
  FROM patterns p LEFT JOIN nodes n ON n.account_id = CAST(p.account_id AS VARCHAR)""",
    "behavioral_baseline": F_.rstrip() + "," + PROFILES + """ SELECT account_id, total_txn_count, unique_merchants,
  unique_beneficiaries, unique_devices, half_up(avg_amount, 2) AS avg_amount, half_up(max_amount, 2) AS max_amount,
  half_up(std_amount, 2) AS std_amount, half_up(avg_txn_count_7d, 2) AS avg_txn_count_7d,
  half_up(avg_amount_sum_24h, 2) AS avg_amount_sum_24h, has_fraud AS has_prior_fraud FROM profiles""",
    "merchant_risk": with_(TXN, DIMS) + """SELECT merchant_id, name, category_code, country,
  half_up(fraud_rate_hist, 4) AS fraud_rate_hist, CASE WHEN fraud_rate_hist > 0.04::DOUBLE THEN 'HIGH'
  WHEN fraud_rate_hist > 0.015::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
  FROM merchant WHERE merchant_id IN (SELECT merchant_id FROM txn)""",
    "watchlist_screen": SCREEN + """SELECT entity_id, id IS NOT NULL AS hit, id AS matched_watchlist_id, name AS matched_name, reason,
  source, listed_at FROM entity LEFT JOIN (SELECT * FROM hits WHERE n = 1) USING (entity_id)""",
    "watchlist_edges": SCREEN + """SELECT entity_id, 'Customer' AS entity_type, id AS watchlist_entity_id, listed_at AS matched_at
FROM hits WHERE n = 1""",
    "mixed_sample": f"""WITH {TXN.strip()},
drawn AS (SELECT * FROM txn ORDER BY md5('42:' || txn_id), txn_id LIMIT 500),
positive AS (SELECT * FROM txn WHERE is_fraud ORDER BY md5('43:' || txn_id), txn_id LIMIT 500)
SELECT txn_id, account_id, amount, is_fraud FROM drawn UNION SELECT txn_id, account_id, amount, is_fraud FROM positive""",
    "anomaly_summary": S + """SELECT account_id, half_up(arg_max(behavior_anomaly_score, (ts, txn_id)), 4) AS latest_anomaly_score,
  half_up(avg(behavior_anomaly_score), 4) AS avg_anomaly_score, count(*) AS total_transactions_scored,
  CASE WHEN avg(behavior_anomaly_score) > 0.6 THEN 'HIGHLY_ANOMALOUS' WHEN avg(behavior_anomaly_score) > 0.3
  THEN 'MODERATELY_ANOMALOUS' ELSE 'NORMAL' END AS interpretation FROM scored GROUP BY account_id""",
    "memo_validation": M + """SELECT case_id, recommended_action, priority, half_up(confidence, 2) AS confidence, error FROM checked""",
    "similar_cases": M.rstrip() + f""",
library AS (
  SELECT half_up(confidence, 2) AS s, reason_codes AS codes, list(case_id ORDER BY case_id)[1:3] AS ids
  FROM checked WHERE error IS NULL GROUP BY ALL
),
asked AS (SELECT txn_id AS query_id, txn_risk_score AS q, reason_codes AS codes FROM alerts WHERE action <> 'ALLOW'),
asked_vec AS (SELECT *, list_filter(string_split(codes, '|'), lambda c: list_contains({CODE_LIST}, c)) AS cs FROM asked),
library_sets AS (SELECT *, list_filter(string_split(codes, '|'), lambda c: list_contains({CODE_LIST}, c)) AS cs FROM library),
library_vec AS (SELECT * REPLACE (CASE WHEN len(cs) = 0 THEN sign(s) ELSE s END AS s) FROM library_sets),
rated_pairs AS (
  SELECT query_id, unnest(ids) AS case_id,
    coalesce((q * s + len(list_intersect(a.cs, b.cs))) / nullif(sqrt(q * q + len(a.cs)) * sqrt(s * s + len(b.cs)), 0), 0) AS sim
  FROM asked_vec a, library_vec b
),
best AS (
  SELECT query_id, case_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, case_id) AS rank
  FROM rated_pairs
)
SELECT query_id, case_id, half_up(sim, 4) AS similarity, CAST(rank AS INTEGER) AS rank, recommended_action,
  half_up(confidence, 2) AS confidence, reason_codes, alert_id || ' on account ' || CAST(account_id AS VARCHAR) AS summary
  FROM best JOIN checked USING (case_id) WHERE rank <= 3""",
    "case_detail": M + """SELECT case_id, alert_id, recommended_action, half_up(txn_risk_score, 4) AS txn_risk_score,
  half_up(behavior_anomaly_score, 4) AS behavior_anomaly_score, half_up(graph_risk_score, 4) AS graph_risk_score,
  half_up(final_risk_score, 4) AS final_risk_score, half_up(amount, 2) AS amount FROM memos""",
    "case_entities": M + """SELECT case_id, 'Account' AS entity_type, CAST(account_id AS VARCHAR) AS entity_id FROM memos
  UNION ALL SELECT case_id, 'Device', CAST(device_id AS VARCHAR) FROM memos
  UNION ALL SELECT case_id, 'Merchant', CAST(merchant_id AS VARCHAR) FROM memos WHERE merchant_id IS NOT NULL
  UNION ALL SELECT case_id, 'Beneficiary', CAST(beneficiary_id AS VARCHAR) FROM memos WHERE beneficiary_id IS NOT NULL""",
    "case_list": M + "SELECT case_id FROM memos",
    "account_card": with_(TXN, EDGES, NODES, PAIRS, REACH, GRAPH, LINKS, FLAGS, PATTERNS, recursive=True) + """SELECT a.account_id,
  'Cluster_' || community_id AS community, account_degree, half_up(graph_risk_score, 6) AS graph_risk_score,
  half_up(community_fraud_rate, 6) AS community_fraud_rate, connected_devices, shared_device_accounts, total_neighbors,
  patterns_detected, confidence FROM around a LEFT JOIN graph_rated g ON a.account_id = g.account_id
  LEFT JOIN patterns p ON a.account_id = CAST(p.account_id AS VARCHAR)""",
    "top_risky": with_(TXN, SCORED, FEAT) + """, s AS (
  SELECT feat.*, least(1.0::DOUBLE, 0.50::DOUBLE * txn_risk_score + 0.25::DOUBLE * behavior_anomaly_score
    + 0.25::DOUBLE * graph_risk_score) AS f
  FROM feat JOIN (SELECT txn_id, txn_risk_score, behavior_anomaly_score, graph_risk_score FROM scored) USING (txn_id)
)
SELECT txn_id, account_id, amount, txn_count_24h, amount_sum_24h, half_up(amount_vs_30d_avg, 6) AS amount_vs_30d_avg,
  half_up(f, 6) AS final_risk_score,
  CASE WHEN f >= 0.85::DOUBLE THEN 'CRITICAL' WHEN f >= 0.70::DOUBLE THEN 'HIGH' WHEN f >= 0.55::DOUBLE THEN 'ELEVATED'
    WHEN f >= 0.35::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
  CASE WHEN f >= 0.85::DOUBLE THEN 'BLOCK' WHEN f >= 0.70::DOUBLE THEN 'QUEUE_FOR_REVIEW'
    WHEN f >= 0.55::DOUBLE THEN 'STEP_UP_AUTH' WHEN f >= 0.35::DOUBLE THEN 'ALLOW_WITH_MONITORING' ELSE 'ALLOW' END AS action
FROM s ORDER BY f DESC, txn_id LIMIT 100""",
    "streaming_velocity": F_ + """SELECT txn_id, account_id, txn_count_1h, txn_count_24h, txn_count_7d, amount_sum_1h,
  amount_sum_24h FROM feat""",
    # Append mode holds back windows that end after the watermark (newest event less an hour).
    "streaming_volume": T + f"""SELECT strftime(w, {STAMP}) AS window_start, channel, count(*) AS event_count,
  0::BIGINT AS late_count FROM (SELECT date_trunc('hour', ts) AS w, channel FROM txn) GROUP BY ALL""",
    "streaming_log": T + f"""SELECT CAST(txn_id AS VARCHAR) AS txn_id, CAST(account_id AS VARCHAR) AS account_id, amount, channel,
  strftime(date_trunc('second', ts), {STAMP}) AS timestamp FROM txn""",
    "sorted_transactions": T + f"""SELECT * REPLACE (strftime(timestamp, {STAMP}) AS timestamp) FROM (
  SELECT txn_id, account_id, amount, ts AS timestamp, row_number() OVER (ORDER BY ts, txn_id) - 1 AS position FROM txn)
  WHERE timestamp >= TIMESTAMP '2024-01-15' AND timestamp < TIMESTAMP '2024-01-22'""",
    "streaming_alerts": S.rstrip() + f""",
f AS (SELECT *, least(1.0::DOUBLE, 0.50::DOUBLE * txn_risk_score + 0.25::DOUBLE * behavior_anomaly_score
  + 0.25::DOUBLE * graph_risk_score) AS s FROM scored)
SELECT 'ALT_RT_' || txn_id AS alert_id, txn_id, account_id, amount, strftime(ts, {STAMP}) AS timestamp,
  half_up(txn_risk_score, 4) AS txn_risk_score, half_up(behavior_anomaly_score, 4) AS behavior_anomaly_score,
  half_up(s, 4) AS final_risk_score,
  CASE WHEN s >= 0.85::DOUBLE THEN 'CRITICAL' WHEN s >= 0.70::DOUBLE THEN 'HIGH' WHEN s >= 0.55::DOUBLE THEN 'ELEVATED'
    WHEN s >= 0.35::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
  CASE WHEN s >= 0.85::DOUBLE THEN 'BLOCK' WHEN s >= 0.70::DOUBLE THEN 'QUEUE_FOR_REVIEW'
    WHEN s >= 0.55::DOUBLE THEN 'STEP_UP_AUTH' WHEN s >= 0.35::DOUBLE THEN 'ALLOW_WITH_MONITORING' ELSE 'ALLOW' END AS action,
  concat_ws('|', CASE WHEN txn_risk_score > 0.7::DOUBLE THEN 'ELEVATED_RISK_SCORE' END,
    CASE WHEN amount > 9000 THEN 'STRUCTURING_PATTERN' END) AS reason_codes,
  strftime(ts, {STAMP}) AS triggered_at FROM f""",
}

ORACLE: dict[str, str] = {name: spelled_out(sql) for name, sql in _SQL.items()}
