"""Alert queue, selection metrics, distributions and dashboard series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywatch.functions.numbers import settle
from paywatch.functions.quantiles import exact_quantiles
from paywatch.functions.topk import top_n
from paywatch.schemas import ACTIONS


def by_score() -> list[Column]:
    """Highest final score first; equal scores by transaction id."""
    return [F.col("final_risk_score").desc(), F.col("txn_id").asc()]


def _wanted(column: str, value: str | None) -> Column | None:
    return F.col(column) == value if value and value != "all" else None


def filtered(
    alerts: DataFrame, risk_band: str | None = None, action: str | None = None, search: str | None = None,
    regex: bool = False,
) -> DataFrame:
    """Equality filters ("all" passes everything) and a case-insensitive account search."""
    for condition in (_wanted("risk_band", risk_band), _wanted("action", action)):
        if condition is not None:
            alerts = alerts.filter(condition)
    if search:
        account = F.col("account_id").cast("string")
        found = account.rlike(f"(?i){search}") if regex else F.lower(account).contains(search.lower())
        alerts = alerts.filter(found)
    return alerts


def queue(
    alerts: DataFrame, limit: int = 50, risk_band: str | None = None, action: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Top alerts by final score among those that pass the filters."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    top = top_n(filtered(alerts, risk_band, action, search), by_score(), limit, ["txn_id"])
    return top.select(
        "alert_id", "txn_id", "timestamp", "account_id",
        settle("amount", 2).alias("amount"),
        settle("final_risk_score", 4).alias("risk_score"),
        "risk_band", "action", "is_fraud",
    )


def selection(
    alerts: DataFrame, bands: Sequence[str], actions: Sequence[str], n: int = 100
) -> DataFrame:
    chosen = alerts.filter(F.col("risk_band").isin(*bands) & F.col("action").isin(*actions))
    return top_n(chosen, by_score(), n, ["txn_id"])


def selection_metrics(
    alerts: DataFrame, bands: Sequence[str], actions: Sequence[str], n: int = 100
) -> DataFrame:
    """Rows, positives, mean score and precision of the top-n selection."""
    return selection(alerts, bands, actions, n).agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if("is_fraud").alias("fraud_in_selection"),
        F.avg("final_risk_score").alias("avg_risk_score"),
        F.avg(F.col("is_fraud").cast("int")).alias("precision"),
    )


def pick_for_investigation(alerts: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` blocked alerts, or the top ``n`` by score when nothing is blocked.

    Blocked alerts rank first, so one ordered limit covers both branches; rows of the
    other branch are then dropped.
    """
    blocked = F.col("action") == "BLOCK"
    order = [
        blocked.cast("int").desc(),
        F.when(blocked, F.col("alert_id")).asc_nulls_last(),
        *by_score(),
    ]
    top = top_n(alerts, order, n, ["txn_id"])
    any_blocked = F.max(blocked.cast("int")).over(Window.partitionBy(F.lit(0))) == 1
    return top.withColumn("_any", any_blocked).filter(~F.col("_any") | blocked).drop("_any")


def latest(alerts: DataFrame, limit: int = 50, risk_band: str | None = None) -> DataFrame:
    """The last ``limit`` alerts, and of those the wanted band (in that order)."""
    order = [F.col("triggered_at").desc(), F.col("alert_id").desc()]
    newest = top_n(alerts, order, limit, ["alert_id"])
    return filtered(newest, risk_band)


def distribution(alerts: DataFrame, column: str = "action") -> DataFrame:
    """Count and percentage per value; the total is a window over one row per value."""
    counts = alerts.groupBy(column).agg(F.count(F.lit(1)).alias("alert_count"))
    total = F.sum("alert_count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.col("alert_count") / total * 100)


def tier_precision(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("action").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.count_if("is_fraud").alias("fraud_count"),
        F.avg(F.col("is_fraud").cast("int")).alias("fraud_rate"),
    )


def reason_frequency(alerts: DataFrame, top: int = 10) -> DataFrame:
    codes = alerts.select(F.explode("reason_codes").alias("reason_code"))
    counts = codes.groupBy("reason_code").agg(F.count(F.lit(1)).alias("alert_count"))
    return counts.orderBy(F.col("alert_count").desc(), "reason_code").limit(top)


def score_summary(df: DataFrame, column: str = "final_risk_score") -> DataFrame:
    """Mean, exact p50/p95/p99 and maximum (the quantiles are an action)."""
    quantiles = exact_quantiles(df, column, [0.5, 0.95, 0.99]) or [None] * 3
    return df.agg(
        F.avg(column).alias("mean"),
        *[F.lit(q).cast("double").alias(n) for q, n in zip(quantiles, ["p50", "p95", "p99"])],
        F.max(column).alias("max"),
    )


def overview(alerts: DataFrame) -> DataFrame:
    """Rows, positives, rate and one count per action, in a single pass."""
    return alerts.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if("is_fraud").alias("fraud_count"),
        F.avg(F.col("is_fraud").cast("int")).alias("fraud_rate"),
        *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ACTIONS],
    )


def period(ts: str = "timestamp", unit: str = "month") -> Column:
    """Period label: month as yyyy-MM, or the first day of the week."""
    if unit == "month":
        return F.date_format(ts, "yyyy-MM")
    return F.date_format(F.date_trunc(unit, ts), "yyyy-MM-dd")


def by_month(alerts: DataFrame, unit: str = "month") -> DataFrame:
    return alerts.groupBy(period(unit=unit).alias("period")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_fraud").alias("fraud_count"),
        F.avg(F.col("is_fraud").cast("int")).alias("fraud_rate"),
    )


def action_by_month(alerts: DataFrame, unit: str = "month") -> DataFrame:
    """Period by action counts, missing cells 0. Named values spare the pivot a scan."""
    counts = alerts.groupBy(period(unit=unit).alias("period")).pivot("action", ACTIONS).count()
    return counts.fillna(0, ACTIONS)


def histogram(df: DataFrame, column: str = "final_risk_score", bins: int = 20) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed, empty bins kept.

    Two narrow passes: the bounds come back as two numbers.
    """
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if bounds["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, bin_count bigint")
    lo, hi = float(bounds["lo"]), float(bounds["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    place = F.floor((F.col(column) - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins)))
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit((hi - lo) / bins)).alias("lower"),
        F.coalesce("_n", F.lit(0)).alias("bin_count"),
    )
