"""Column lists, schemas, allowed values and thresholds."""

from __future__ import annotations


HOUR = 3600
DAY = 86400

# --- fixed values: they must equal the published contract for right results ---

CANONICAL_COLUMNS = [
    "txn_id", "account_id", "merchant_id", "beneficiary_id", "device_id", "ip_id",
    "amount", "currency", "txn_type", "channel", "timestamp", "is_fraud",
    "fraud_scenario", "source",
]
CRITICAL_COLUMNS = ["txn_id", "account_id", "amount", "timestamp", "is_fraud"]
MONITORED_COLUMNS = [
    "txn_id", "account_id", "merchant_id", "beneficiary_id", "device_id", "ip_id",
    "amount", "currency", "txn_type", "channel", "timestamp", "is_fraud",
]

VELOCITY_COLUMNS = [
    "txn_count_1h", "txn_count_24h", "txn_count_7d", "amount_sum_1h", "amount_sum_24h",
    "unique_merchants_7d", "unique_beneficiaries_7d", "unique_devices_30d",
]
BEHAVIOR_COLUMNS = [
    "amount_vs_30d_avg", "amount_vs_30d_max", "days_since_last_txn",
    "is_new_device", "is_new_beneficiary",
]
MERCHANT_IP_COLUMNS = [
    "merchant_fraud_rate_hist", "mcc_code", "mcc_risk_tier", "ip_is_vpn", "ip_country",
]
CARRIED_COLUMNS = [c for c in CANONICAL_COLUMNS if c != "currency"]
FEATURE_COLUMNS = CARRIED_COLUMNS + VELOCITY_COLUMNS + BEHAVIOR_COLUMNS + MERCHANT_IP_COLUMNS

GRAPH_FEATURES = [
    "account_degree", "device_shared_account_count", "beneficiary_in_degree",
    "num_devices", "num_beneficiaries", "community_size", "community_fraud_rate",
    "graph_risk_score",
]
TOPOLOGY_FLAGS = [
    "is_fan_out_source", "is_fan_in_target", "is_shared_device",
    "structuring_flag", "is_mule_chain_member",
]
NUMERIC_FEATURES = VELOCITY_COLUMNS + BEHAVIOR_COLUMNS[:3] + ["merchant_fraud_rate_hist"] + GRAPH_FEATURES
BOOLEAN_FEATURES = ["is_new_device", "is_new_beneficiary", "ip_is_vpn"] + TOPOLOGY_FLAGS
CATEGORICAL_FEATURES = ["mcc_risk_tier", "channel", "txn_type"]
ANOMALY_FEATURES = [
    "txn_count_7d", "amount_sum_24h", "unique_merchants_7d", "unique_beneficiaries_7d",
    "unique_devices_30d", "days_since_last_txn", "amount_vs_30d_avg",
]

ACTIONS = ["ALLOW", "ALLOW_WITH_MONITORING", "STEP_UP_AUTH", "QUEUE_FOR_REVIEW", "BLOCK"]
PRIORITIES = ["LOW", "MEDIUM", "HIGH"]
ACTION_CUTS = [
    (0.85, "BLOCK", "CRITICAL"),
    (0.70, "QUEUE_FOR_REVIEW", "HIGH"),
    (0.55, "STEP_UP_AUTH", "ELEVATED"),
    (0.35, "ALLOW_WITH_MONITORING", "MEDIUM"),
]
REASON_CODES = [
    "NEW_DEVICE_HIGH_VALUE_TXN", "SHARED_DEVICE_CLUSTER", "STRUCTURING_PATTERN",
    "HIGH_GRAPH_FANOUT", "AMOUNT_4X_BASELINE", "DORMANT_ACCOUNT_REACTIVATION",
    "NEW_PAYEE_LARGE_TXN", "BURST_VELOCITY", "WATCHLIST_HIT", "MULE_CHAIN_DETECTED",
    "FAN_IN_PATTERN", "FAN_OUT_PATTERN", "IP_COUNTRY_MISMATCH", "HIGH_RISK_MERCHANT",
]
ALERT_COLUMNS = [
    "txn_id", "account_id", "timestamp", "amount", "is_fraud", "fraud_scenario",
    "txn_risk_score", "behavior_anomaly_score", "graph_risk_score", "final_risk_score",
    "risk_band", "action", "reason_codes", "alert_id", "triggered_at",
]
DRIFT_FEATURES = ["txn_risk_score", "behavior_anomaly_score", "final_risk_score", "amount"]

# --- end of fixed values ---

# DDL strings, usable wherever Spark takes a schema.
MOBILE_MONEY = "step int, type string, amount double, nameOrig string, nameDest string, isFraud int"
AML_TRANSACTIONS = (
    "step int, type string, amount double, nameOrig string, nameDest string, isSAR int, alertID string"
)
AML_ALERT_ACCOUNTS = "alertID string, reason string, accountID string, isSAR boolean"
AML_ACCOUNTS = "accountID string"
STREAM_EVENT = (
    "txn_id string, account_id string, amount double, txn_type string, channel string, timestamp string"
)
DIMENSIONS = {
    "customer": "customer_id string, name string, dob timestamp, country string, "
                "created_at timestamp, risk_tier string",
    "account": "account_id string, customer_id string, account_type string, balance double, "
               "status string, created_at timestamp",
    "device": "device_id string, device_type string, os string, fingerprint_hash string, "
              "first_seen_at timestamp",
    "ip_address": "ip_id string, ip_addr string, country string, isp string, "
                  "is_vpn boolean, is_datacenter boolean",
    "merchant": "merchant_id string, name string, category_code string, country string, "
                "fraud_rate_hist double",
    "beneficiary": "beneficiary_id string, name string, account_ref string, bank_code string, "
                   "added_at timestamp",
    "watchlist_entity": "entity_id string, entity_type string, name string, reason string, "
                        "listed_at timestamp, source string",
}
CASE_MEMO = (
    "case_id string, alert_id string, recommended_action string, confidence double, priority string, "
    "reason_codes array<string>, entities_involved struct<account_ids: array<string>, "
    "device_ids: array<string>, merchant_ids: array<string>, beneficiary_ids: array<string>>, "
    "summary string, supporting_evidence array<string>, tools_called array<string>, "
    "next_steps array<string>, created_at string"
)
