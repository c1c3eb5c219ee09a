"""Account-device-IP-beneficiary edges, degree features, topology flags and graph risk.

Vertices are keyed by (type, id), so an account that is also paid as a beneficiary
keeps both roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywatch.functions.keys import spread_join
from paywatch.functions.ordered import running_totals
from paywatch.schemas import DAY, TOPOLOGY_FLAGS

# edge type -> (source column, target column, source vertex type, target vertex type)
EDGE_TYPES = {
    "account_device": ("account_id", "device_id", "account", "device"),
    "device_ip": ("device_id", "ip_id", "device", "ip"),
    "account_beneficiary": ("account_id", "beneficiary_id", "account", "beneficiary"),
}


def edges(txn: DataFrame, max_edges_per_type: int | None = None) -> DataFrame:
    """All three edge sets from one scan and one shuffle: count and amount per pair.

    ``max_edges_per_type`` keeps only the heaviest edges of each type; off by default.
    """
    triples = F.array(*[
        F.struct(
            F.lit(kind).alias("edge_type"),
            F.col(src).cast("string").alias("src"),
            F.col(dst).cast("string").alias("dst"),
        )
        for kind, (src, dst, _, _) in EDGE_TYPES.items()
    ])
    pairs = (
        txn.select(F.explode(triples).alias("_e"), "amount")
        .select("_e.*", "amount")
        .filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    )
    weighted = pairs.groupBy("edge_type", "src", "dst").agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("total_amount")
    )
    return weighted if max_edges_per_type is None else heaviest_edges(weighted, max_edges_per_type)


def heaviest_edges(weighted: DataFrame, k: int) -> DataFrame:
    """The ``k`` edges of each type with the largest count, ties by id (action).

    The cut is found from the number of edges per count. Everything above it stays; only
    the edges at the cut are ordered, over all tasks.
    """
    levels = weighted.groupBy("edge_type", "txn_count").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy("edge_type").orderBy(F.col("txn_count").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = levels.withColumn("_before", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    # One row per edge type: the last level that still gets edges, and how many.
    cuts = before.filter(F.col("_before") < k).groupBy("edge_type").agg(
        F.min("txn_count").alias("_cut"), F.max("_before").alias("_taken")
    )
    marked = weighted.join(F.broadcast(cuts), "edge_type")
    tied = marked.filter(F.col("txn_count") == F.col("_cut")).withColumn("_one", F.lit(1).cast("bigint"))
    placed = running_totals(tied, [F.col("edge_type"), F.col("src"), F.col("dst")], {"_place": "_one"})
    starts = placed.groupBy("edge_type").agg((F.min("_place") - 1).alias("_start"))
    chosen = placed.join(F.broadcast(starts), "edge_type").filter(
        F.col("_place") - F.col("_start") <= F.lit(k) - F.col("_taken")
    )
    whole = marked.filter(F.col("txn_count") > F.col("_cut"))
    return whole.select(*weighted.columns).unionByName(chosen.select(*weighted.columns))


def usage_edges(txn: DataFrame, src: str, dst: str, count: str | None = "txn_count") -> DataFrame:
    """First and last use per pair, e.g. account-device or device-IP."""
    measures = [F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")]
    if count:
        measures.append(F.count("txn_id").alias(count))
    known = txn.filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    return known.groupBy(src, dst).agg(*measures)


def payment_totals(txn: DataFrame, dst: str) -> DataFrame:
    """Number and amount of payments per account and beneficiary (or merchant)."""
    return txn.filter(F.col(dst).isNotNull()).groupBy("account_id", dst).agg(
        F.count("txn_id").alias("total_txns"), F.sum("amount").alias("total_amount")
    )


def owner_edges(accounts: DataFrame) -> DataFrame:
    return accounts.select("customer_id", "account_id").distinct()


def node_features(edge_table: DataFrame) -> DataFrame:
    """Degree features per account, from the edge table and the in-degree of its targets."""
    owned = edge_table.filter(F.col("edge_type").isin("account_device", "account_beneficiary")).select(
        "edge_type", "src", "dst"
    )
    in_degree = owned.groupBy("edge_type", "dst").agg(F.count(F.lit(1)).alias("_accounts"))
    to_device = F.col("edge_type") == "account_device"
    to_payee = F.col("edge_type") == "account_beneficiary"
    return (
        spread_join(owned, in_degree, ["edge_type", "dst"], ["src"], "inner")
        .groupBy(F.col("src").alias("account_id"))
        .agg(
            F.count(F.lit(1)).alias("account_degree"),
            F.coalesce(F.max(F.when(to_device, F.col("_accounts") - 1)), F.lit(0)).alias(
                "device_shared_account_count"
            ),
            F.coalesce(F.max(F.when(to_payee, F.col("_accounts"))), F.lit(0)).alias(
                "beneficiary_in_degree"
            ),
            F.count_if(to_device).alias("num_devices"),
            F.count_if(to_payee).alias("num_beneficiaries"),
        )
    )


def daily_fan_out(txn: DataFrame, minimum: int = 5) -> DataFrame:
    """Account-days that paid at least ``minimum`` distinct beneficiaries."""
    return _daily_distinct(txn, "account_id", "beneficiary_id", "unique_beneficiaries_day", minimum)


def daily_fan_in(txn: DataFrame, minimum: int = 5) -> DataFrame:
    """Beneficiary-days paid by at least ``minimum`` distinct accounts."""
    return _daily_distinct(txn, "beneficiary_id", "account_id", "unique_senders_day", minimum)


def _daily_distinct(txn: DataFrame, key: str, value: str, name: str, minimum: int) -> DataFrame:
    paid = txn.filter(F.col("beneficiary_id").isNotNull())
    return (
        paid.groupBy(key, F.to_date("timestamp").alias("day"))
        .agg(F.countDistinct(value).alias(name))
        .filter(F.col(name) >= minimum)
    )


def shared_devices(txn: DataFrame, minimum: int = 3) -> DataFrame:
    """Devices used by at least ``minimum`` accounts."""
    return (
        txn.filter(F.col("device_id").isNotNull())
        .groupBy("device_id")
        .agg(F.countDistinct("account_id").alias("unique_accounts"))
        .filter(F.col("unique_accounts") >= minimum)
    )


def structuring_buckets(
    txn: DataFrame, lo: float = 9000, hi: float = 9999, min_count: int = 3
) -> DataFrame:
    """Near-threshold payments per account, beneficiary and fixed 3-day bucket."""
    near = txn.filter(F.col("amount").between(lo, hi) & F.col("beneficiary_id").isNotNull())
    bucket = F.floor(F.unix_timestamp("timestamp") / (3 * DAY)).alias("bucket")
    return (
        near.groupBy("account_id", "beneficiary_id", bucket)
        .agg(F.count(F.lit(1)).alias("near_threshold_txns"))
        .filter(F.col("near_threshold_txns") >= min_count)
    )


def senders_and_receivers(txn: DataFrame) -> DataFrame:
    """Accounts that also appear as a beneficiary.

    Both sides are made distinct first: ``intersect`` alone would shuffle every row by account.
    """
    senders = txn.select("account_id").distinct()
    receivers = txn.select(F.col("beneficiary_id").alias("account_id")).distinct()
    return senders.join(receivers, "account_id", "left_semi")


def topology_flags(
    txn: DataFrame,
    fan: int = 5,
    shared: int = 3,
    lo: float = 9000,
    hi: float = 9999,
    min_count: int = 3,
) -> DataFrame:
    """Pattern flags per transaction; one bad day flags the account for good.

    The three account-level sets are folded into one small table first, so the
    transactions are joined once per key (account, beneficiary, device).
    """
    marks = (
        _marked(daily_fan_out(txn, fan), "is_fan_out_source")
        .unionByName(_marked(structuring_buckets(txn, lo, hi, min_count), "structuring_flag"))
        .unionByName(_marked(senders_and_receivers(txn), "is_mule_chain_member"))
        .groupBy("account_id")
        .agg(*[
            F.bool_or(F.col("mark") == name).alias(name)
            for name in ("is_fan_out_source", "structuring_flag", "is_mule_chain_member")
        ])
    )
    targets = daily_fan_in(txn, fan).select("beneficiary_id").distinct().withColumn(
        "is_fan_in_target", F.lit(True)
    )
    devices = shared_devices(txn, shared).select("device_id", F.lit(True).alias("is_shared_device"))
    rows = txn.select("txn_id", "account_id", "beneficiary_id", "device_id")
    n = rows.count()
    joined = (
        spread_join(rows, marks, ["account_id"], ["txn_id"], "left", rows, n)
        .transform(spread_join, targets, ["beneficiary_id"], ["txn_id"], "left", rows, n)
        .transform(spread_join, devices, ["device_id"], ["txn_id"], "left", rows, n)
    )
    return joined.select(
        "txn_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in TOPOLOGY_FLAGS]
    )


def _marked(accounts: DataFrame, mark: str) -> DataFrame:
    return accounts.select("account_id", F.lit(mark).alias("mark")).distinct()


def account_label_rate(txn: DataFrame, label_cutoff=None) -> DataFrame:
    """Share of positive transactions per account, optionally only before a cutoff."""
    seen = txn if label_cutoff is None else txn.filter(F.col("timestamp") < F.lit(label_cutoff))
    return seen.groupBy("account_id").agg(
        F.avg(F.col("is_fraud").cast("int")).alias("account_fraud_rate")
    )


def graph_features(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """Node and community features side by side, missing numbers as 0, plus the risk score."""
    merged = nodes.join(communities, "account_id", "full_outer")
    numbers = [f.name for f in merged.schema if f.dataType.typeName() in ("long", "integer", "double")]
    return merged.fillna(0, numbers).withColumn("graph_risk_score", risk_score())


def risk_score() -> Column:
    """Weighted sum of sharing, payee in-degree, community rate and size, clipped to [0, 1]."""
    high_degree = F.when(F.col("account_degree") > 10, 0.15).otherwise(0.0)
    many_payees = F.when(F.col("num_beneficiaries") > 5, 0.15).otherwise(0.0)
    total = (
        F.col("device_shared_account_count") * F.lit(0.15)
        + F.least("beneficiary_in_degree", F.lit(20)) / F.lit(20.0) * F.lit(0.25)
        + F.col("community_fraud_rate") * F.lit(0.30)
        + high_degree
        + many_payees
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
