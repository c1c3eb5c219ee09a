"""Canonical views over the generic star-schema tables used for checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log seen as canonical transactions."""
    return as_transactions(table(spark, sf_dir, "events"))


def as_transactions(events: DataFrame) -> DataFrame:
    """Stateless, so the same mapping serves batch and streaming input."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.col("event_type")
    fraud = kind == "error"
    base = events.select("event_id", "user_id", "event_type", "value", "ts", k.alias("k"))
    device = F.when(F.col("k") % 10 == 0, F.floor(F.col("user_id") / 4)).otherwise(
        100000 + F.col("user_id") * 3 + F.col("k") % 3
    )
    rows = base.select(
        F.col("event_id").alias("txn_id"),
        F.col("user_id").alias("account_id"),
        F.when(kind != "signup", F.col("event_id") % 120).alias("merchant_id"),
        F.when(kind.isin("purchase", "click", "error"), F.col("k").cast("bigint")).alias("beneficiary_id"),
        device.cast("bigint").alias("device_id"),
        F.round(F.col("value") * 50, 2).alias("amount"),
        F.lit("USD").alias("currency"),
        kind.alias("txn_type"),
        F.element_at(
            F.array(*map(F.lit, ["MOBILE", "ONLINE", "BRANCH", "ATM"])), F.col("k") % 4 + 1
        ).alias("channel"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        fraud.alias("is_fraud"),
        F.when(
            fraud,
            F.element_at(
                F.array(*map(F.lit, ["STRUCTURING", "FAN_OUT", "MULE_CHAIN"])), F.col("k") % 3 + 1
            ),
        ).alias("fraud_scenario"),
        F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("source"),
    )
    return rows.withColumn("ip_id", F.col("device_id") % 50)


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("merchant_id"),
        F.col("s_name").alias("name"),
        (F.col("s_suppkey") % 15).cast("string").alias("category_code"),
        F.col("s_nationkey").cast("string").alias("country"),
        ((F.col("s_suppkey") % 15) * F.lit(0.005)).alias("fraud_rate_hist"),
    )


def ip_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips = transactions(spark, sf_dir).select("ip_id").distinct()
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("_nation"), F.col("n_name").alias("country")
    )
    return ips.join(nation, F.col("ip_id") % 25 == F.col("_nation"), "left").select(
        "ip_id", "country", (F.col("ip_id") % 20 == 0).alias("is_vpn")
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source")
    )
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").cast("string").alias("entity_id"),
        F.lit("INDIVIDUAL").alias("entity_type"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("LISTED_"), F.col("s_nationkey").cast("string")).alias("reason"),
        "source",
        F.expr("timestampadd(DAY, cast(s_suppkey AS int), timestamp'2023-01-01')").alias("listed_at"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with arithmetic stand-ins for the two model scores."""
    return transactions(spark, sf_dir).select(
        "*",
        (F.col("txn_id") * 37 % 1000 / F.lit(1000.0)).alias("txn_risk_score"),
        (F.col("txn_id") * 91 % 1000 / F.lit(1000.0)).alias("behavior_anomaly_score"),
    )


def account_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic stand-in for the account graph score."""
    return transactions(spark, sf_dir).select("account_id").distinct().select(
        "account_id", (F.col("account_id") * 53 % 1000 / F.lit(1000.0)).alias("graph_risk_score")
    )
