"""Rolling velocity, behaviour against own history, merchant/IP risk and account profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywatch.functions import timeline
from paywatch.functions.keys import spread_join, unique_by
from paywatch.functions.timeline import MONEY
from paywatch.runtime import settled
from paywatch.schemas import BEHAVIOR_COLUMNS, DAY, FEATURE_COLUMNS, HOUR, VELOCITY_COLUMNS

MONTH = 30 * DAY

# Above this many rows an account leaves the plain window for the block-wise sweep.
HOT_ROWS = 20_000

# Rows of about so many transactions that one task holds in the plain windows. Left to the
# bytes of the shuffle, a task took ten times more memory on ten times the rows.
WINDOW_ROWS = 100_000

# A row without account or time has no history but itself: it gets a key of its own.
KEY = ["_account", "_alone"]

DISTINCT_WINDOWS = {
    "merchant_id": ("unique_merchants_7d", 7 * DAY),
    "beneficiary_id": ("unique_beneficiaries_7d", 7 * DAY),
    "device_id": ("unique_devices_30d", MONTH),
}


def rolling_features(df: DataFrame, method: str = "auto", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Velocity and behaviour columns for every transaction.

    ``window`` uses range windows per account: one shuffle, but the whole account in one
    task and work proportional to the frame. ``sweep`` splits accounts over time and is
    linear (action: settles its per-second tables). ``auto`` measures account sizes (one narrow aggregate job) and sends only the
    accounts above ``hot_rows`` through the sweep.

    All three give the same rows: money is added up as exact decimals with ten places in
    every form. A row without account or time counts only itself. An amount that is null, no
    number, or too large for the money type adds nothing to sums and is no part of a mean or
    maximum.
    """
    keyed = _keyed(df)
    if method == "window":
        return _by_window(keyed, df.columns)
    if method == "sweep":
        return _by_sweep(keyed, df.columns)
    sizes = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    rows, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil((rows or 0) / WINDOW_ROWS))
    if (largest or 0) <= hot_rows:
        return _by_window(keyed.repartition(tasks, *KEY), df.columns)
    hot = settled(sizes.filter(F.col("_n") > hot_rows).select(*KEY), "hot-accounts")
    calm = spread_join(keyed, hot, KEY, ["txn_id"], "left_anti", rows=rows)
    busy = spread_join(keyed, hot, KEY, ["txn_id"], "left_semi", rows=rows)
    return _by_window(calm.repartition(tasks, *KEY), df.columns).unionByName(_by_sweep(busy, df.columns))


def _keyed(df: DataFrame) -> DataFrame:
    """Adds the second and a key without nulls."""
    rows = timeline.with_epoch(df)
    alone = F.col("account_id").isNull() | F.col("ts_epoch").isNull()
    return rows.withColumns({
        "_account": F.coalesce(F.col("account_id").cast("string"), F.lit("")),
        "_alone": F.when(alone, F.coalesce(F.col("txn_id").cast("string"), F.lit("?"))).otherwise(""),
        "ts_epoch": F.coalesce("ts_epoch", F.lit(0)),
        "_money": F.col("amount").try_cast(MONEY),
    }).withColumn("_amount", F.when(F.col("_money").isNotNull(), F.col("amount")))


def velocity(df: DataFrame, method: str = "auto") -> DataFrame:
    return rolling_features(df, method).select(*df.columns, *VELOCITY_COLUMNS)


def behavioral(df: DataFrame, method: str = "auto") -> DataFrame:
    return rolling_features(df, method).select(*df.columns, *BEHAVIOR_COLUMNS)


def _ratio(amount: str, base: Column) -> Column:
    return F.when(base > 0, F.col(amount) / base).otherwise(1.0)


def _is_new(previous: Column) -> Column:
    """Not seen in the 30 days before; the very first use is new."""
    return F.coalesce(previous < F.col("ts_epoch") - MONTH, F.lit(True))


def _novelty(previous_device: Column, previous_beneficiary: Column) -> dict[str, Column]:
    return {
        "is_new_device": F.when(F.col("device_id").isNotNull(), _is_new(previous_device)),
        "is_new_beneficiary": F.when(
            F.col("beneficiary_id").isNotNull(), _is_new(previous_beneficiary)
        ).otherwise(False),
    }


def _by_window(keyed: DataFrame, carried: list[str]) -> DataFrame:
    own = Window.partitionBy(*KEY).orderBy("ts_epoch")
    past_month = own.rangeBetween(-MONTH, -1)

    def trailing(seconds: int):
        return own.rangeBetween(-seconds, 0)

    def last_use(value: str) -> Column:
        # Same account hash as the other windows, so only the sort differs.
        uses = Window.partitionBy(*KEY, value).orderBy("ts_epoch")
        return F.max("ts_epoch").over(uses.rangeBetween(Window.unboundedPreceding, -1))

    in_order = Window.partitionBy(*KEY).orderBy("ts_epoch", "txn_id")
    counted = {
        "txn_count_1h": F.count("txn_id").over(trailing(HOUR)),
        "txn_count_24h": F.count("txn_id").over(trailing(DAY)),
        "txn_count_7d": F.count("txn_id").over(trailing(7 * DAY)),
        "amount_sum_1h": F.sum("_money").over(trailing(HOUR)).cast("double"),
        "amount_sum_24h": F.sum("_money").over(trailing(DAY)).cast("double"),
        "_avg_30d": F.sum("_money").over(past_month).cast("double") / F.nullif(F.count("_money").over(past_month), F.lit(0)),
        "_max_30d": F.max("_amount").over(past_month),
        "_before": F.lag("ts_epoch").over(in_order),
    }
    for column, (name, seconds) in DISTINCT_WINDOWS.items():
        counted[name] = F.size(F.collect_set(column).over(trailing(seconds)))
    rows = (
        keyed.withColumns(counted)
        .withColumns({"_device": last_use("device_id"), "_payee": last_use("beneficiary_id")})
    )
    return _finish(rows, carried, F.col("_device"), F.col("_payee"))


def _by_sweep(rows: DataFrame, carried: list[str]) -> DataFrame:
    key = KEY
    at = [*key, "ts_epoch"]
    # Tables with one row per key and second, each read by several of the steps below.
    per_second = settled(rows.groupBy(*at).agg(
        F.count("txn_id").alias("n"),
        F.count("_money").alias("amounts"),
        F.coalesce(F.sum("_money"), F.lit(0)).cast("decimal(38,10)").alias("total"),
        F.max("_amount").alias("amount"),
        F.min("txn_id").alias("_first_txn"),
    ), "per-second")
    points = [
        timeline.window_points(per_second, key, "ts_epoch", {
            "txn_count_1h": ("n", -HOUR, 0),
            "txn_count_24h": ("n", -DAY, 0),
            "txn_count_7d": ("n", -7 * DAY, 0),
            "amount_sum_1h": ("total", -HOUR, 0),
            "amount_sum_24h": ("total", -DAY, 0),
            "_n_30d": ("amounts", -MONTH, -1),
            "_sum_30d": ("total", -MONTH, -1),
        })
    ]
    seen: dict[str, DataFrame] = {}
    for column, (name, seconds) in DISTINCT_WINDOWS.items():
        uses = rows.filter(F.col(column).isNotNull()).select(*key, column, "ts_epoch").distinct()
        seen[column] = settled(timeline.previous_second(uses, [*key, column], "ts_epoch"), column)
        points.append(timeline.distinct_points(seen[column], key, "ts_epoch", name, seconds))

    last = per_second.agg(F.max("ts_epoch")).first()[0]
    totals = timeline.sweep(points, per_second, key, "ts_epoch", last=last)
    peaks = timeline.trailing_max(per_second, key, "ts_epoch", "amount", MONTH)
    firsts = per_second.select(*at, "_first_txn")
    by_second = totals.join(peaks, at).join(firsts, at).withColumns({
        "amount_sum_1h": F.col("amount_sum_1h").cast("double"),
        "amount_sum_24h": F.col("amount_sum_24h").cast("double"),
        "_avg_30d": F.when(F.col("_n_30d") > 0, F.col("_sum_30d").cast("double") / F.col("_n_30d")),
        "_max_30d": F.col("trailing_amount"),
    }).withColumnRenamed("previous", "_previous_second")
    devices = seen["device_id"].withColumnRenamed("previous", "_device")
    payees = seen["beneficiary_id"].withColumnRenamed("previous", "_payee")
    n = rows.count()
    joined = (
        spread_join(rows, by_second, at, ["txn_id"], "inner", rows, n)
        .transform(spread_join, devices, [*key, "device_id", "ts_epoch"], ["txn_id"], "left", rows, n)
        .transform(spread_join, payees, [*key, "beneficiary_id", "ts_epoch"], ["txn_id"], "left", rows, n)
        .withColumn("_before", F.when(F.col("txn_id") > F.col("_first_txn"), F.col("ts_epoch"))
                    .otherwise(F.col("_previous_second")))
    )
    return _finish(joined, carried, F.col("_device"), F.col("_payee"))


def _finish(rows: DataFrame, carried: list[str], device: Column, payee: Column) -> DataFrame:
    novelty = _novelty(device, payee)
    since = F.coalesce((F.col("ts_epoch") - F.col("_before")) / F.lit(float(DAY)), F.lit(0.0))
    return rows.select(
        *carried,
        *[F.col(c).cast("bigint").alias(c) for c in ("txn_count_1h", "txn_count_24h", "txn_count_7d")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("amount_sum_1h", "amount_sum_24h")],
        *[F.col(name).cast("bigint").alias(name) for name, _ in DISTINCT_WINDOWS.values()],
        _ratio("amount", F.col("_avg_30d")).alias("amount_vs_30d_avg"),
        _ratio("amount", F.col("_max_30d")).alias("amount_vs_30d_max"),
        since.alias("days_since_last_txn"),
        *[c.alias(name) for name, c in novelty.items()],
    )


def risk_tier(rate: str | Column) -> Column:
    """HIGH above 0.04, MEDIUM above 0.015, otherwise (also when unknown) LOW."""
    value = F.col(rate) if isinstance(rate, str) else rate
    return F.when(value > 0.04, "HIGH").when(value > 0.015, "MEDIUM").otherwise("LOW")


def merchant_ip(
    df: DataFrame, merchant: DataFrame | None = None, ip: DataFrame | None = None, measured: DataFrame | None = None
) -> DataFrame:
    """Left joins to the merchant and IP tables; a missing table gives constant columns.

    The dimensions are reduced to one row per key first, so they cannot multiply facts.
    Whether a side is broadcast is left to the optimizer, which knows its measured size;
    beyond that size, rows without a merchant and dominant merchants are spread. ``measured``
    is a cheaper table with the same rows to count them on.
    """
    facts = df if measured is None else measured
    n = None if merchant is None and ip is None else facts.count()
    if merchant is None:
        df = df.withColumns({
            "merchant_fraud_rate_hist": F.lit(0.0),
            "mcc_code": F.lit(None).cast("string"),
        })
    else:
        rates = unique_by(
            merchant.select(
                "merchant_id",
                F.col("fraud_rate_hist").alias("merchant_fraud_rate_hist"),
                F.col("category_code").alias("mcc_code"),
            ),
            ["merchant_id"], [F.col("mcc_code"), F.col("merchant_fraud_rate_hist")],
        )
        df = spread_join(df, rates, ["merchant_id"], ["txn_id"], "left", facts, n)
    if ip is None:
        df = df.withColumns({"ip_is_vpn": F.lit(False), "ip_country": F.lit(None).cast("string")})
    else:
        places = unique_by(
            ip.select("ip_id", F.col("is_vpn").alias("ip_is_vpn"), F.col("country").alias("ip_country")),
            ["ip_id"], [F.col("ip_country"), F.col("ip_is_vpn")],
        )
        df = spread_join(df, places, ["ip_id"], ["txn_id"], "left", facts, n)
    return df.withColumns({
        "mcc_risk_tier": risk_tier("merchant_fraud_rate_hist"),
        "merchant_fraud_rate_hist": F.coalesce("merchant_fraud_rate_hist", F.lit(0.0)),
        "ip_is_vpn": F.coalesce("ip_is_vpn", F.lit(False)),
    })


def transaction_features(
    txn: DataFrame, merchant: DataFrame | None = None, ip: DataFrame | None = None, method: str = "auto"
) -> DataFrame:
    """The full per-transaction feature table."""
    return merchant_ip(rolling_features(txn, method), merchant, ip, measured=txn).select(*FEATURE_COLUMNS)


def account_profiles(features: DataFrame) -> DataFrame:
    """All-time profile per account."""
    return features.groupBy("account_id").agg(
        F.count("txn_id").alias("total_txn_count"),
        F.avg("amount").alias("avg_amount"),
        F.max("amount").alias("max_amount"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std_amount"),
        F.countDistinct("merchant_id").alias("unique_merchants"),
        F.countDistinct("beneficiary_id").alias("unique_beneficiaries"),
        F.countDistinct("device_id").alias("unique_devices"),
        F.avg("txn_count_7d").alias("avg_txn_count_7d"),
        F.avg("amount_sum_24h").alias("avg_amount_sum_24h"),
        F.bool_or("is_fraud").alias("has_fraud"),
    )
