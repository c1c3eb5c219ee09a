"""Detectors for laundering patterns over the transaction table.

Sliding windows go through ``functions.timeline``, so a busy account or beneficiary is
split over time and no pairs of transactions are produced. Tables that several steps of a
detector read are settled first (actions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywatch.functions import timeline
from paywatch.functions.keys import spread_join
from paywatch.functions.timeline import MONEY
from paywatch.runtime import settled
from paywatch.schemas import DAY, HOUR


def _burst(paid: DataFrame, keys: list[str], value: str, width: int, minimum: int, name: str) -> DataFrame:
    """Seconds at which a key has at least ``minimum`` distinct values in the last ``width``."""
    uses = timeline.with_epoch(paid).select(*keys, value, "ts_epoch").distinct()
    seen = settled(timeline.previous_second(uses, [*keys, value], "ts_epoch"), "uses")
    points = timeline.distinct_points(seen, keys, "ts_epoch", name, width)
    counted = timeline.sweep([points], seen, keys, "ts_epoch")
    return counted.filter(F.col(name) >= minimum).select(*keys, "ts_epoch", name)


def fan_out(txn: DataFrame, window: int = 2 * HOUR, minimum: int = 5) -> DataFrame:
    """One account paying many beneficiaries within a sliding window."""
    paid = txn.filter(F.col("beneficiary_id").isNotNull())
    return _burst(paid, ["account_id"], "beneficiary_id", window, minimum, "beneficiaries")


def fan_in(
    txn: DataFrame, window: int = DAY, minimum: int = 5, same: str | None = None
) -> DataFrame:
    """Many accounts paying one beneficiary, optionally from the same device or IP."""
    paid = txn.filter(F.col("beneficiary_id").isNotNull())
    keys = ["beneficiary_id"]
    if same:
        paid, keys = paid.filter(F.col(same).isNotNull()), [*keys, same]
    return _burst(paid, keys, "account_id", window, minimum, "senders")


def structuring(
    txn: DataFrame, lo: float = 9000, hi: float = 9999, days: int = 3, minimum: int = 3
) -> DataFrame:
    """Runs of just-below-threshold payments to one beneficiary in a sliding window."""
    keys = ["account_id", "beneficiary_id"]
    near = timeline.with_epoch(
        txn.filter(F.col("amount").between(lo, hi) & F.col("beneficiary_id").isNotNull())
    )
    per_second = near.groupBy(*keys, "ts_epoch").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").try_cast(MONEY)).alias("total")
    )
    points = timeline.window_points(per_second, keys, "ts_epoch", {
        "near_threshold_txns": ("n", -days * DAY, 0),
        "near_threshold_amount": ("total", -days * DAY, 0),
    })
    runs = timeline.sweep([points], per_second, keys, "ts_epoch")
    return runs.filter(F.col("near_threshold_txns") >= minimum).select(
        *keys, "ts_epoch", "near_threshold_txns",
        F.col("near_threshold_amount").cast("double").alias("near_threshold_amount"),
    )


def takeover_burst(
    features: DataFrame, dormant_days: float = 30, amount: float = 3000
) -> DataFrame:
    """A dormant account that pays a new beneficiary a large amount from a new device."""
    return features.filter(
        (F.col("days_since_last_txn") >= dormant_days)
        & F.col("is_new_device")
        & F.col("is_new_beneficiary")
        & (F.col("amount") >= amount)
    )


def dormant_reactivation(features: DataFrame, dormant_days: float = 30) -> DataFrame:
    return features.filter(F.col("days_since_last_txn") >= dormant_days).withColumn(
        "reason_code", F.lit("DORMANT_ACCOUNT_REACTIVATION")
    )


def high_graph_fanout(nodes: DataFrame, min_degree: int = 10) -> DataFrame:
    return nodes.filter(F.col("account_degree") > min_degree).withColumn(
        "reason_code", F.lit("HIGH_GRAPH_FANOUT")
    )


def shared_device_ring(txn: DataFrame, minimum: int = 4) -> DataFrame:
    """Members of devices used by many accounts, one row per device and account."""
    used = txn.filter(F.col("device_id").isNotNull()).groupBy("device_id", "account_id").agg(
        F.count("txn_id").alias("txn_count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
    rings = used.groupBy("device_id").agg(F.count(F.lit(1)).alias("ring_size")).filter(
        F.col("ring_size") >= minimum
    )
    return spread_join(used, rings, ["device_id"], ["account_id"], "inner").select(
        "device_id", "ring_size", "account_id", "txn_count", "first_seen", "last_seen"
    )


def _transfers(txn: DataFrame) -> DataFrame:
    """Payments between two different accounts."""
    return timeline.with_epoch(txn).filter(F.col("beneficiary_id") != F.col("account_id")).select(
        "txn_id", "account_id", "beneficiary_id", "ts_epoch", "amount"
    )


def forwarded(txn: DataFrame, within: int = DAY) -> DataFrame:
    """Per transfer: what its receiver paid on to others within the time limit.

    Gives the number and amount of onward transfers and the first onward second; the
    numbers equal those of the interval self-join, without its pairs.
    """
    moves = settled(_transfers(txn), "transfers")
    key = ["account_id"]
    sent = moves.groupBy("account_id", "ts_epoch").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").try_cast(MONEY)).alias("total")
    )
    received = moves.select(F.col("beneficiary_id").alias("account_id"), "ts_epoch").distinct()
    points = timeline.window_points(sent, key, "ts_epoch", {
        "onward_txns": ("n", 1, within), "onward_amount": ("total", 1, within),
    })
    onward = timeline.sweep([points], received, key, "ts_epoch").drop("previous")
    first = timeline.next_second(sent, received, key, "ts_epoch")
    known = onward.join(first, [*key, "ts_epoch"]).withColumnRenamed("account_id", "beneficiary_id")
    return (
        spread_join(moves, known, ["beneficiary_id", "ts_epoch"], ["txn_id"], "inner")
        .filter(F.col("onward_txns") > 0)
        .select(
            "txn_id", "account_id", "beneficiary_id", "ts_epoch", "amount", "onward_txns",
            F.col("onward_amount").cast("double").alias("onward_amount"),
            (F.col("following") - F.col("ts_epoch")).alias("seconds_to_first"),
        )
    )


def money_chains(txn: DataFrame, max_hops: int = 4, within: int = DAY) -> DataFrame:
    """Chains of transfers, each sent on within the limit, counted by length (action per hop).

    ``chains_h`` is the number of chains of h transfers that start with this one, times
    strictly increasing. Counts are added up hop by hop, so the chains themselves, whose
    number grows exponentially, are never listed. A chain may come back to an account.
    """
    exact = "decimal(38,0)"
    rows = settled(_transfers(txn).withColumn("chains_1", F.lit(1).cast(exact)), "chains-1")
    for hop in range(2, max_hops + 1):
        name, shorter = f"chains_{hop}", f"chains_{hop - 1}"
        sent = rows.filter(F.col(shorter) > 0).groupBy("account_id", "ts_epoch").agg(
            F.sum(shorter).cast(exact).alias(shorter)
        )
        received = rows.select(F.col("beneficiary_id").alias("account_id"), "ts_epoch").distinct()
        points = timeline.window_points(sent, ["account_id"], "ts_epoch", {name: (shorter, 1, within)})
        onward = timeline.sweep([points], received, ["account_id"], "ts_epoch").select(
            F.col("account_id").alias("beneficiary_id"), "ts_epoch", F.col(name).cast(exact).alias(name)
        )
        joined = spread_join(rows, onward, ["beneficiary_id", "ts_epoch"], ["txn_id"], "inner")
        rows = settled(joined, name.replace("_", "-"))
    hops = range(2, max_hops + 1)
    longest = F.greatest(F.lit(1), *[F.when(F.col(f"chains_{h}") > 0, h).otherwise(1) for h in hops])
    return rows.filter(F.col("chains_2") > 0).select(
        "txn_id", "account_id", "beneficiary_id", "ts_epoch", "amount",
        *[f"chains_{h}" for h in hops], longest.alias("hops"),
    )
