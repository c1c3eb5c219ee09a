"""Named queries over the checking tables; each reads whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywatch.functions.keys import unique_by
from paywatch.functions.numbers import settle
from paywatch.functions.ordered import read_sorted, write_sorted
from paywatch.operators import (
    alerts, attribution, community, detect, drift, features, forest, fusion, graph, investigate,
    metrics, model, quality,
)
from paywatch.plans import stages
from paywatch.runtime import scratch_path, settled
from paywatch.schemas import (
    BEHAVIOR_COLUMNS, CANONICAL_COLUMNS, FEATURE_COLUMNS, MERCHANT_IP_COLUMNS, VELOCITY_COLUMNS,
)
from paywatch.sources import ingest
from paywatch.sources import testdata as data
from paywatch.streaming import events as live
from paywatch.streaming.velocity import drained_velocity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The data holds one month, and smaller amounts than the usual reporting limit.
SPLIT = "2024-01-21"
NEAR = {"lo": 500, "hi": 9999, "min_count": 2}
BANDS, ACTIONS = ["CRITICAL", "HIGH", "ELEVATED"], ["BLOCK", "QUEUE_FOR_REVIEW", "STEP_UP_AUTH"]


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def stamp(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text, so that both engines print them alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: settle(c, places) for c in columns})


def joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


# --- sources and canonical mapping ---------------------------------------------------


@query
def canonical_transactions(spark, sf):
    txn = data.transactions(spark, sf)
    both = ingest.union_sources([txn.filter("source = 'A'"), txn.filter("source = 'B'")], CANONICAL_COLUMNS)
    return stamp(features.timeline.with_epoch(both), "timestamp")


def _raw_mobile_money(spark, sf):
    start = F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    return data.transactions(spark, sf).select(
        F.floor((F.unix_timestamp("timestamp") - start) / 3600).cast("int").alias("step"),
        F.upper("txn_type").alias("type"),
        "amount",
        F.concat(F.lit("C"), F.col("account_id").cast("string")).alias("nameOrig"),
        F.concat(F.lit("M"), F.coalesce("beneficiary_id", F.lit(0)).cast("string")).alias("nameDest"),
        F.col("is_fraud").cast("int").alias("isFraud"),
    )


@query
def mobile_money_canonical(spark, sf):
    return stamp(ingest.canonical_mobile_money(_raw_mobile_money(spark, sf)), "timestamp")


@query
def aml_canonical(spark, sf):
    raw = _raw_mobile_money(spark, sf).withColumnRenamed("isFraud", "isSAR")
    reasons = F.array(*map(F.lit, ["fan_in", "Fan_Out", "cycle", "other"]))
    reports = data.transactions(spark, sf).filter("txn_type = 'signup'").select(
        F.col("txn_id").alias("alertID"),
        F.element_at(reasons, (F.col("txn_id") % 4 + 1).cast("int")).alias("reason"),
        F.concat(F.lit("C"), F.col("account_id").cast("string")).alias("accountID"),
        (F.col("txn_id") % 3 == 0).alias("isSAR"),
    )
    return stamp(ingest.canonical_aml(raw, reports, order="alertID"), "timestamp")


@query
def derived_accounts(spark, sf):
    return stamp(ingest.derive_accounts(data.transactions(spark, sf)), "created_at")


@query
def owner_edges(spark, sf):
    return graph.owner_edges(ingest.derive_accounts(data.transactions(spark, sf)))


@query
def first_order_per_customer(spark, sf):
    orders = data.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return unique_by(orders, ["o_custkey"], [F.col("o_orderkey")])


@query
def mixed_sample(spark, sf):
    return ingest.mixed_sample(data.transactions(spark, sf), 1000).select("txn_id", "account_id", "amount", "is_fraud")


# --- features ------------------------------------------------------------------------


def _feature_table(spark, sf, method="auto"):
    return features.transaction_features(
        data.transactions(spark, sf), data.merchants(spark, sf), data.ip_addresses(spark, sf), method
    )


_RATIOS = ["amount_vs_30d_avg", "amount_vs_30d_max", "days_since_last_txn"]


@query
def velocity_features(spark, sf):
    return features.velocity(data.transactions(spark, sf)).select("txn_id", "account_id", *VELOCITY_COLUMNS)


@query
def behavior_features(spark, sf):
    rows = features.behavioral(data.transactions(spark, sf)).select("txn_id", "account_id", *BEHAVIOR_COLUMNS)
    return rounded(rows, *_RATIOS)


@query
def rolling_features_sweep(spark, sf):
    rows = features.rolling_features(data.transactions(spark, sf), "sweep")
    return rounded(rows.select("txn_id", "account_id", *VELOCITY_COLUMNS, *BEHAVIOR_COLUMNS), *_RATIOS)


@query
def merchant_ip_features(spark, sf):
    rows = features.merchant_ip(data.transactions(spark, sf), data.merchants(spark, sf), data.ip_addresses(spark, sf))
    return rounded(rows.select("txn_id", *MERCHANT_IP_COLUMNS), "merchant_fraud_rate_hist")


@query
def merchant_ip_defaults(spark, sf):
    return features.merchant_ip(data.transactions(spark, sf)).select("txn_id", *MERCHANT_IP_COLUMNS)


@query
def transaction_features(spark, sf):
    rows = stamp(_feature_table(spark, sf).select(*FEATURE_COLUMNS), "timestamp")
    return rounded(rows, *_RATIOS, "merchant_fraud_rate_hist")


@query
def account_profiles(spark, sf):
    profiles = features.account_profiles(features.velocity(data.transactions(spark, sf)))
    return rounded(profiles, "avg_amount", "std_amount", "avg_txn_count_7d", "avg_amount_sum_24h")


# --- edges, flags, graph ---------------------------------------------------------------


@query
def account_device_edges(spark, sf):
    return stamp(graph.usage_edges(data.transactions(spark, sf), "account_id", "device_id"), "first_seen", "last_seen")


@query
def device_ip_edges(spark, sf):
    edges = graph.usage_edges(data.transactions(spark, sf), "device_id", "ip_id", count=None)
    return stamp(edges, "first_seen", "last_seen")


@query
def graph_edges(spark, sf):
    return graph.edges(data.transactions(spark, sf))


@query
def heaviest_edges(spark, sf):
    return graph.edges(data.transactions(spark, sf), max_edges_per_type=100)


@query
def beneficiary_totals(spark, sf):
    return graph.payment_totals(data.transactions(spark, sf), "beneficiary_id")


@query
def merchant_totals(spark, sf):
    return graph.payment_totals(data.transactions(spark, sf), "merchant_id")


@query
def daily_fan_out(spark, sf):
    return graph.daily_fan_out(data.transactions(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query
def daily_fan_in(spark, sf):
    return graph.daily_fan_in(data.transactions(spark, sf), 2).withColumn("day", F.col("day").cast("string"))


@query
def shared_devices(spark, sf):
    return graph.shared_devices(data.transactions(spark, sf))


@query
def structuring_buckets(spark, sf):
    return graph.structuring_buckets(data.transactions(spark, sf), **NEAR)


@query
def account_label_rate(spark, sf):
    return rounded(graph.account_label_rate(data.transactions(spark, sf)), "account_fraud_rate")


@query
def account_label_rate_before_cutoff(spark, sf):
    return rounded(graph.account_label_rate(data.transactions(spark, sf), SPLIT), "account_fraud_rate")


@query
def senders_and_receivers(spark, sf):
    return graph.senders_and_receivers(data.transactions(spark, sf))


@query
def topology_flags(spark, sf):
    return graph.topology_flags(data.transactions(spark, sf), **NEAR)


@query
def sorted_transactions(spark, sf):
    """The transactions of the third week, from a table kept in the order of time."""
    path = scratch_path(spark, "sorted")
    rows = data.transactions(spark, sf).select("txn_id", "account_id", "amount", "timestamp")
    write_sorted(rows, path, ["timestamp", "txn_id"])
    week = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp")
    return stamp(read_sorted(spark, path, "timestamp", week("15"), week("22")), "timestamp")


@query
def node_features(spark, sf):
    return graph.node_features(graph.edges(data.transactions(spark, sf)))


def _shared(spark, sf):
    return community.incidence(graph.edges(data.transactions(spark, sf)))


@query
def projected_degree(spark, sf):
    return community.projected_degree(_shared(spark, sf))


@query
def projected_links(spark, sf):
    return community.projected_links(_shared(spark, sf))


@query
def components(spark, sf):
    return community.components(_shared(spark, sf))


def _communities(spark, sf):
    edges = graph.edges(data.transactions(spark, sf))
    return community.communities(graph.node_features(edges), community.incidence(edges))


@query
def communities(spark, sf):
    return _communities(spark, sf)


@query
def communities_of_ring(spark, sf):
    """Customers in about as many groups as a group has members; each group shares a device and
    its first member another one with the first member of the next group: one component."""
    customers = data.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    groups = F.lit(max(math.isqrt(customers.count()), 1))
    ring = customers.withColumn("g", F.pmod("id", groups))
    heads = ring.groupBy("g").agg(F.min("id").alias("id"))
    device = lambda kind, g: F.concat(F.lit(kind), g.cast("string")).alias("dst")
    uses = ring.select("id", device("group ", F.col("g"))).unionByName(
        heads.select("id", F.explode(F.array("g", F.pmod(F.col("g") + 1, groups))).alias("g")).select("id", device("bridge ", F.col("g")))
    )
    table = uses.select(F.col("id").cast("string").alias("src"), "dst", F.lit("account_device").alias("edge_type"))
    accounts = customers.select(F.col("id").cast("string").alias("account_id"))
    return community.communities(accounts, community.incidence(table))


@query
def community_features(spark, sf):
    rated = community.community_features(_communities(spark, sf), data.transactions(spark, sf))
    return rounded(rated, "community_fraud_rate")


@query
def community_summary(spark, sf):
    rated = community.community_features(_communities(spark, sf), data.transactions(spark, sf))
    return rounded(community.community_summary(rated), "avg_community_size", "avg_community_fraud_rate")


@query
def graph_features(spark, sf):
    txn = data.transactions(spark, sf)
    rated = community.community_features(_communities(spark, sf), txn)
    table = graph.graph_features(graph.node_features(graph.edges(txn)), rated)
    return rounded(table, "community_fraud_rate", "graph_risk_score")


# --- detectors -------------------------------------------------------------------------


@query
def detect_fan_out(spark, sf):
    return detect.fan_out(data.transactions(spark, sf), minimum=3)


@query
def detect_fan_in(spark, sf):
    return detect.fan_in(data.transactions(spark, sf))


@query
def detect_fan_in_same_ip(spark, sf):
    return detect.fan_in(data.transactions(spark, sf), minimum=2, same="ip_id")


@query
def detect_structuring(spark, sf):
    return detect.structuring(data.transactions(spark, sf), lo=500, hi=9999, minimum=2)


@query
def detect_takeover_burst(spark, sf):
    found = detect.takeover_burst(features.rolling_features(data.transactions(spark, sf)), dormant_days=0.5, amount=100)
    return rounded(found.select("txn_id", "account_id", "amount", "days_since_last_txn"), "days_since_last_txn")


@query
def detect_dormant_reactivation(spark, sf):
    found = detect.dormant_reactivation(features.rolling_features(data.transactions(spark, sf)), dormant_days=1)
    return rounded(found.select("txn_id", "account_id", "days_since_last_txn", "reason_code"), "days_since_last_txn")


@query
def detect_high_graph_fanout(spark, sf):
    nodes = graph.node_features(graph.edges(data.transactions(spark, sf)))
    return detect.high_graph_fanout(nodes, 35).select("account_id", "account_degree", "reason_code")


@query
def detect_shared_device_ring(spark, sf):
    return stamp(detect.shared_device_ring(data.transactions(spark, sf)), "first_seen", "last_seen")


@query
def forwarded_transfers(spark, sf):
    return detect.forwarded(data.transactions(spark, sf))


@query
def money_chains(spark, sf):
    chains = detect.money_chains(data.transactions(spark, sf))
    return chains.withColumns({f"chains_{h}": F.col(f"chains_{h}").cast("bigint") for h in (2, 3, 4)})


# --- quality ---------------------------------------------------------------------------


@query
def null_rates(spark, sf):
    return rounded(quality.null_rates(data.transactions(spark, sf)), "null_rate")


@query
def record_counts(spark, sf):
    return quality.record_counts(data.transactions(spark, sf))


@query
def label_distribution(spark, sf):
    return quality.label_distribution(data.transactions(spark, sf))


@query
def scenario_counts(spark, sf):
    return quality.scenario_counts(data.transactions(spark, sf))


@query
def coverage(spark, sf):
    return stamp(quality.coverage(data.transactions(spark, sf)), "min_timestamp", "max_timestamp")


@query
def uniqueness(spark, sf):
    return quality.uniqueness(data.transactions(spark, sf))


@query
def duplicate_order_keys(spark, sf):
    return quality.duplicates(data.table(spark, sf, "lineitem"), "l_orderkey")


@query
def quality_findings(spark, sf):
    return quality.findings(data.transactions(spark, sf))


@query
def quality_report(spark, sf):
    return quality.report(data.transactions(spark, sf))


# --- fusion and alerts -----------------------------------------------------------------


def _signals(spark, sf):
    txn = data.transactions(spark, sf)
    return fusion.merge_signals(
        data.scored(spark, sf), _feature_table(spark, sf), data.account_risk(spark, sf),
        graph.topology_flags(txn, **NEAR),
    )


@query
def merged_signals(spark, sf):
    rows = _signals(spark, sf).select(
        "txn_id", "graph_risk_score", *fusion.RULE_FEATURES, *graph.TOPOLOGY_FLAGS
    )
    return rounded(rows, "amount_vs_30d_avg", "merchant_fraud_rate_hist")


@query
def fusion_decisions(spark, sf):
    rows = fusion.decide(_signals(spark, sf)).select("txn_id", "final_risk_score", "risk_band", "action", "reason_codes")
    return rounded(joined(rows, "reason_codes"), "final_risk_score")


@query
def fusion_full_rules(spark, sf):
    signals = _signals(spark, sf).withColumn("watchlist_hit", F.col("account_id") % 19 == 0)
    rows = fusion.decide(signals, ruleset="full").select("txn_id", "final_risk_score", "risk_band", "action", "reason_codes")
    return rounded(joined(rows, "reason_codes"), "final_risk_score")


@query
def alert_table(spark, sf):
    rows = fusion.run_fusion(
        data.scored(spark, sf), _feature_table(spark, sf), data.account_risk(spark, sf),
        graph.topology_flags(data.transactions(spark, sf), **NEAR),
    )
    return rounded(stamp(joined(rows, "reason_codes"), "timestamp", "triggered_at"), "final_risk_score")


def _alerts(spark, sf):
    """Alerts whose rule signals need no history, for the queries that only read alerts."""
    rows = data.scored(spark, sf).withColumns({
        "graph_risk_score": F.col("account_id") * 53 % 1000 / F.lit(1000.0),
        "is_shared_device": F.col("device_id") < 100000,
        "is_new_beneficiary": F.col("beneficiary_id").isNotNull() & (F.col("txn_id") % 3 == 0),
        "is_new_device": F.col("txn_id") % 5 == 0,
        "ip_is_vpn": F.col("ip_id") % 20 == 0,
        "merchant_fraud_rate_hist": F.col("merchant_id") % 15 * F.lit(0.005),
        "amount_vs_30d_avg": F.col("amount") / F.lit(2500.0),
    })
    decided = fusion.decide(fusion.fill_signals(rows))
    return decided.withColumns({
        "alert_id": F.concat(F.lit("ALT_"), F.lpad(F.col("txn_id").cast("string"), 8, "0")),
        "triggered_at": F.col("timestamp"),
    })


@query
def alert_queue(spark, sf):
    return stamp(alerts.queue(_alerts(spark, sf), 200, action="BLOCK"), "timestamp")


@query
def alert_search(spark, sf):
    return stamp(alerts.queue(_alerts(spark, sf), 500, risk_band="all", search="1"), "timestamp")


@query
def selection_metrics(spark, sf):
    return rounded(alerts.selection_metrics(_alerts(spark, sf), BANDS, ACTIONS, 300), "avg_risk_score", "precision")


@query
def action_distribution(spark, sf):
    return rounded(alerts.distribution(_alerts(spark, sf)), "percent")


@query
def band_distribution(spark, sf):
    return rounded(alerts.distribution(_alerts(spark, sf), "risk_band"), "percent")


@query
def tier_precision(spark, sf):
    return rounded(alerts.tier_precision(_alerts(spark, sf)), "fraud_rate")


@query
def reason_frequency(spark, sf):
    return alerts.reason_frequency(_alerts(spark, sf))


@query
def score_summary(spark, sf):
    return rounded(alerts.score_summary(_alerts(spark, sf)), "mean", "p50", "p95", "p99", "max")


@query
def overview(spark, sf):
    return rounded(alerts.overview(_alerts(spark, sf)), "fraud_rate")


@query
def alert_volume(spark, sf):
    return rounded(alerts.by_month(_alerts(spark, sf), "week"), "fraud_rate")


@query
def action_by_period(spark, sf):
    return alerts.action_by_month(_alerts(spark, sf), "week")


@query
def score_histogram(spark, sf):
    return rounded(alerts.histogram(_alerts(spark, sf)), "lower")


@query
def latest_alerts(spark, sf):
    rows = live.latest_alerts(_alerts(spark, sf), 500, "HIGH")
    return rounded(stamp(rows, "triggered_at"), "final_risk_score").select(
        "alert_id", "final_risk_score", "risk_band", "triggered_at"
    )


@query
def picked_alerts(spark, sf):
    return alerts.pick_for_investigation(_alerts(spark, sf)).select("alert_id", "txn_id", "action")


# --- model table, metrics, drift -------------------------------------------------------


@query
def split_summary(spark, sf):
    rows = model.split_summary(data.transactions(spark, sf), SPLIT)
    return rounded(stamp(rows, "first_timestamp", "last_timestamp"), "fraud_rate")


@query
def class_balance(spark, sf):
    return rounded(model.class_balance(data.transactions(spark, sf)), "positive_weight")


def _prepared(spark, sf):
    txn = data.transactions(spark, sf)
    nodes = graph.node_features(graph.edges(txn)).withColumn("account_id", F.col("account_id").cast("bigint"))
    return settled(model.prepare(_feature_table(spark, sf), nodes, graph.topology_flags(txn, **NEAR)), "prepared")


@query
def prepared_features(spark, sf):
    rows = _prepared(spark, sf)
    return rounded(
        rows.select("txn_id", "is_fraud", *model.feature_columns(rows)), *_RATIOS, "merchant_fraud_rate_hist"
    )


@query
def ranking_metrics(spark, sf):
    return rounded(metrics.ranking_metrics(data.scored(spark, sf)), "average_precision", "roc_auc")


@query
def budget_metrics(spark, sf):
    _, test = model.temporal_split(data.scored(spark, sf), SPLIT)
    return rounded(metrics.budget_metrics(test, per_day=50), "precision_at_budget", "recall_at_budget")


@query
def score_separation(spark, sf):
    return rounded(forest.separation(data.scored(spark, sf)), "mean_score")


def _shipments(spark, sf):
    return data.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("timestamp"), "l_extendedprice", "l_discount"
    )


def _shipment_psi(spark, sf):
    return drift.psi_by_period(_shipments(spark, sf), "1998-01-01", ["l_extendedprice", "l_discount", "absent"])


@query
def psi_by_month(spark, sf):
    return _shipment_psi(spark, sf)


@query
def psi_heat_table(spark, sf):
    return drift.heat_table(_shipment_psi(spark, sf))


@query
def psi_two_tables(spark, sf):
    rows = _shipments(spark, sf)
    at = F.lit("1998-01-01").cast("timestamp")
    return drift.psi(rows.filter(F.col("timestamp") < at), rows.filter(F.col("timestamp") >= at), "l_extendedprice")


@query
def top_precision(spark, sf):
    return drift.top_precision(_alerts(spark, sf), unit="week")


@query
def label_rate(spark, sf):
    return drift.label_rate(_alerts(spark, sf), unit="week")


@query
def alert_psi(spark, sf):
    return drift.psi_by_period(_alerts(spark, sf), SPLIT, unit="week")


@query
def drift_verdict(spark, sf):
    psi = drift.psi_by_period(_alerts(spark, sf), SPLIT, unit="week")
    return drift.verdict(psi, drift.top_precision(_alerts(spark, sf), unit="week"))


@query
def monitoring_series(spark, sf):
    rows = _alerts(spark, sf)
    return drift.monitoring_series(drift.top_precision(rows, unit="week"), drift.label_rate(rows, unit="week"))


# --- investigation ---------------------------------------------------------------------


@query
def transaction_detail(spark, sf):
    rows = _alerts(spark, sf)
    found = investigate.transaction_detail(rows.filter("action = 'BLOCK'"), rows, features.rolling_features(data.transactions(spark, sf)))
    return rounded(stamp(joined(found, "reason_codes"), "timestamp"), "final_risk_score", "amount_vs_30d_avg")


@query
def account_history(spark, sf):
    rows = _alerts(spark, sf)
    found = investigate.account_history(rows, rows, 7)
    actions = F.transform(
        F.map_entries("actions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return found.withColumn("actions", F.array_join(F.array_sort(actions), "|"))


@query
def velocity_snapshot(spark, sf):
    txn = data.transactions(spark, sf)
    return investigate.velocity_snapshot(txn, features.velocity(txn))


@query
def neighborhood(spark, sf):
    txn = data.transactions(spark, sf)
    found = investigate.neighborhood(txn, txn, caps=investigate.REPORT_CAPS)
    return joined(found, *[c for c in found.columns if c.startswith(("connected", "shared"))])


@query
def neighbors(spark, sf):
    """Every link as a row; ``neighborhood`` has the report's lists."""
    txn = data.transactions(spark, sf)
    return investigate.neighbors(txn, txn)


@query
def co_users(spark, sf):
    """Whom the accounts with an id divisible by 100 meet on their devices."""
    txn = data.transactions(spark, sf)
    return investigate.co_users(txn.filter("account_id % 100 = 0"), txn)


@query
def neighborhood_whole(spark, sf):
    """Whole lists, for the accounts with an id divisible by 100."""
    txn = data.transactions(spark, sf)
    found = investigate.neighborhood(txn.filter("account_id % 100 = 0"), txn)
    return joined(found, *[c for c in found.columns if c.startswith(("connected", "shared"))])


@query
def device_users(spark, sf):
    txn = data.transactions(spark, sf)
    return joined(investigate.device_users(txn, txn, cap=20), "accounts_using_device")


@query
def reachable_entities(spark, sf):
    edges = graph.edges(data.transactions(spark, sf))
    starts = edges.filter("edge_type = 'device_ip'").select(F.lit("ip").alias("vertex_type"), F.col("dst").alias("vertex_id"))
    return investigate.reachable(starts, edges, hops=2)


@query
def graph_patterns(spark, sf):
    txn = data.transactions(spark, sf)
    nodes = graph.node_features(graph.edges(txn)).withColumn("community_fraud_rate", F.lit(0.0))
    found = investigate.graph_patterns(txn, txn, graph.topology_flags(txn, **NEAR), nodes)
    return joined(found.drop("community_rate"), "patterns_detected")


@query
def behavioral_baseline(spark, sf):
    txn = data.transactions(spark, sf)
    return investigate.baseline(txn, features.account_profiles(features.velocity(txn)))


@query
def merchant_risk(spark, sf):
    return investigate.merchant_risk(data.transactions(spark, sf), data.merchants(spark, sf))


def _screened(spark, sf):
    entities = data.table(spark, sf, "customer").select(
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN lpad(cast(c_custkey AS string), 4, '0') "
               "WHEN c_custkey % 3 = 1 THEN cast(c_custkey AS string) ELSE c_name END").alias("entity_id")
    )
    return investigate.watchlist_screen(entities, data.watchlist(spark, sf))


@query
def watchlist_screen(spark, sf):
    return stamp(_screened(spark, sf), "listed_at")


@query
def watchlist_edges(spark, sf):
    return stamp(investigate.watchlist_edges(_screened(spark, sf), "Customer", F.col("listed_at")), "matched_at")


@query
def anomaly_summary(spark, sf):
    rows = data.scored(spark, sf)
    return investigate.anomaly_summary(rows, rows)


def _memos(spark, sf):
    """Case memos written from the stronger alerts."""
    rows = _alerts(spark, sf).filter("action in ('BLOCK', 'QUEUE_FOR_REVIEW', 'STEP_UP_AUTH')")
    none = F.array().cast("array<string>")
    listed = {
        "account_ids": F.array(F.col("account_id").cast("string")),
        "device_ids": F.array(F.col("device_id").cast("string")),
        "merchant_ids": F.when(F.col("merchant_id").isNull(), none).otherwise(F.array(F.col("merchant_id").cast("string"))),
        "beneficiary_ids": F.when(F.col("beneficiary_id").isNull(), none).otherwise(F.array(F.col("beneficiary_id").cast("string"))),
    }
    return rows.select(
        F.concat(F.lit("CASE_"), F.lpad(F.col("txn_id").cast("string"), 8, "0")).alias("case_id"),
        "alert_id",
        F.when(F.col("txn_id") % 11 == 0, "ESCALATE").otherwise(F.col("action")).alias("recommended_action"),
        (F.col("final_risk_score") + F.when(F.col("txn_id") % 13 == 0, 1.0).otherwise(0.0)).alias("confidence"),
        F.when(F.col("txn_id") % 17 == 0, "URGENT").otherwise("HIGH").alias("priority"),
        "reason_codes",
        F.concat(F.col("alert_id"), F.lit(" on account "), F.col("account_id").cast("string")).alias("summary"),
        F.struct(*[c.alias(n) for n, c in listed.items()]).alias("entities_involved"),
    )


@query
def memo_validation(spark, sf):
    return quality.check_memos(_memos(spark, sf)).select("case_id", "recommended_action", "priority", "confidence", "error")


@query
def similar_cases(spark, sf):
    cases, _ = quality.validate_memos(_memos(spark, sf))
    asked = _alerts(spark, sf).filter("action <> 'ALLOW'").select(
        F.col("txn_id").alias("query_id"), "txn_risk_score", "reason_codes"
    )
    return joined(investigate.similar_cases(asked, cases), "reason_codes")


@query
def case_detail(spark, sf):
    found = investigate.case_detail(_memos(spark, sf), _alerts(spark, sf))
    return found.select(
        "case_id", "alert_id", "recommended_action", "txn_risk_score", "behavior_anomaly_score",
        "graph_risk_score", "final_risk_score", "amount",
    )


@query
def case_entities(spark, sf):
    return investigate.case_entities(_memos(spark, sf))


@query
def case_list(spark, sf):
    return investigate.case_ids(_memos(spark, sf))


@query
def account_card(spark, sf):
    txn = data.transactions(spark, sf)
    rated = community.community_features(_communities(spark, sf), txn)
    table = graph.graph_features(graph.node_features(graph.edges(txn)), rated)
    card = investigate.account_card(txn, txn, graph.topology_flags(txn, **NEAR), table, investigate.REPORT_CAPS)
    kept = card.select(
        "account_id", "community", "account_degree", "graph_risk_score", "community_fraud_rate",
        "connected_devices", "shared_device_accounts", "total_neighbors", "patterns_detected", "confidence",
    )
    return rounded(
        joined(kept, "connected_devices", "shared_device_accounts", "patterns_detected"),
        "graph_risk_score", "community_fraud_rate",
    )


@query
def top_risky(spark, sf):
    scores = data.scored(spark, sf).withColumn("graph_risk_score", F.col("account_id") * 53 % 1000 / F.lit(1000.0))
    rows = stages.top_risky(data.transactions(spark, sf), scores)
    return rounded(
        rows.select("txn_id", "account_id", "amount", "txn_count_24h", "amount_sum_24h", "amount_vs_30d_avg",
                    "final_risk_score", "risk_band", "action"),
        "amount_vs_30d_avg", "final_risk_score",
    )


# --- models (no SQL counterpart) -------------------------------------------------------


@query
def stratified_split(spark, sf):
    rest, held = model.stratified_split(data.transactions(spark, sf))
    both = rest.withColumn("part", F.lit("rest")).unionByName(held.withColumn("part", F.lit("held")))
    return both.groupBy("part", "is_fraud").agg(F.count(F.lit(1)).alias("row_count"))


@query
def risk_model_scores(spark, sf):
    prepared = _prepared(spark, sf)
    train, _ = model.temporal_split(prepared, SPLIT)
    risk = model.train_risk(train)
    return model.risk_score(risk, prepared).select("txn_id", "is_fraud", "txn_risk_score")


@query
def anomaly_forest_scores(spark, sf):
    rows = features.rolling_features(data.transactions(spark, sf))
    trees = forest.train_forest(rows.filter("not is_fraud and timestamp < '2024-01-21'"))
    return forest.forest_score(rows, trees).select("txn_id", "is_fraud", "behavior_anomaly_score")


@query
def attribution_importance(spark, sf):
    prepared = _prepared(spark, sf)
    train, test = model.temporal_split(prepared, SPLIT)
    explained = attribution.attributions(test, model.train_risk(train))
    return model.categorized_importance(attribution.global_importance(explained))


# --- streaming -------------------------------------------------------------------------


def _stream(spark, sf):
    """The event table read as a stream of files."""
    schema = data.table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return data.as_transactions(rows)


@query
def streaming_velocity(spark, sf):
    return drained_velocity(_stream(spark, sf)).select(
        "txn_id", "account_id", *[c for c in VELOCITY_COLUMNS if not c.startswith("unique")]
    )


@query
def streaming_volume(spark, sf):
    counts = live.drained_volume(_stream(spark, sf), by="channel")
    return stamp(counts, "window_start")


@query
def streaming_log(spark, sf):
    """The events written as an append-only log and read back as a stream of it."""
    rows = data.transactions(spark, sf).select(
        F.col("txn_id").cast("string").alias("txn_id"), F.col("account_id").cast("string").alias("account_id"), "amount", "channel",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )
    topic = live.write_log(rows, scratch_path(spark, "topic"))
    return stamp(live.drained(live.read_events(spark, "log", {"path": topic}), "log").select(rows.columns), "timestamp")


@query
def streaming_alerts(spark, sf):
    rows = _stream(spark, sf).withColumns({
        "txn_risk_score": F.col("txn_id") * 37 % 1000 / F.lit(1000.0),
        "behavior_anomaly_score": F.col("txn_id") * 91 % 1000 / F.lit(1000.0),
        "graph_risk_score": F.col("account_id") * 53 % 1000 / F.lit(1000.0),
    })
    sink = live.drained(live.decide_events(rows), "alerts")
    return stamp(joined(sink, "reason_codes"), "timestamp", "triggered_at")


@query
def streaming_model_scores(spark, sf):
    prepared = _prepared(spark, sf)
    models = stages.training_stage(prepared, SPLIT)
    known = graph.node_features(graph.edges(data.transactions(spark, sf))).withColumn(
        "account_id", F.col("account_id").cast("bigint")
    )
    sink = live.drained(live.score(_stream(spark, sf), *models, features=known), "scored")
    return stamp(joined(sink, "reason_codes"), "timestamp", "triggered_at")
