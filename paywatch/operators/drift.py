"""Population stability, precision over time and the retraining verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywatch.functions.numbers import settle
from paywatch.functions.quantiles import column_quantiles
from paywatch.functions.topk import top_k
from paywatch.operators.alerts import period
from paywatch.runtime import settled
from paywatch.schemas import DRIFT_FEATURES

PSI_THRESHOLD = 0.2
MIN_REFERENCE = 100
MIN_PERIOD = 50
TOP_ALERTS = 500


def binnings(reference: DataFrame, features: Sequence[str], bins: int = 10, least: int = 0) -> dict[str, Column]:
    """Bin number of a value per feature (actions: find the edges of all features together).

    A reference within [0, 1] gives equal steps, and values outside get no bin. Otherwise
    the edges are reference quantiles with open ends. The bin is the number of inner edges
    at or below the value, so equal edges leave empty bins. Features with fewer than ``least``
    reference values are left out.
    """
    out = {}
    for feature, spread in column_quantiles(reference, features, [i / bins for i in range(1, bins)]).items():
        if (spread.n if spread else 0) < least:
            continue
        value = F.col(feature).cast("double")
        unit_range = spread is not None and spread.low >= 0 and spread.high <= 1
        edges = [i * (1.0 / bins) for i in range(1, bins)] if unit_range else spread.at if spread else []
        place = F.lit(0)
        for edge in edges:
            place = place + F.when(value >= F.lit(float(edge)), 1).otherwise(0)
        out[feature] = F.when(value.between(0.0, 1.0), place) if unit_range else place
    return out


def _usable(feature: str) -> Column:
    value = F.col(feature).cast("double")
    return value.isNotNull() & ~F.isnan(value)


def psi_by_period(
    df: DataFrame,
    cutoff,
    features: Sequence[str] = tuple(DRIFT_FEATURES),
    bins: int = 10,
    unit: str = "month",
    ts: str = "timestamp",
) -> DataFrame:
    """PSI of each feature and period after the cutoff against the rows before it.

    The edges are found first (per feature a few numbers); then one pass counts all
    features, periods and bins together. Needs 100 reference and 50 period values.
    Features that are absent are skipped.
    """
    before = F.col(ts) < F.lit(cutoff).cast("timestamp")
    reference = df.filter(before)
    present = [f for f in features if f in df.columns]
    placed = [
        F.struct(F.lit(f).alias("feature"), _usable(f).alias("usable"), place.alias("bin"))
        for f, place in binnings(reference, present, bins, MIN_REFERENCE).items()
    ]
    if not placed:
        return df.sparkSession.createDataFrame([], "feature string, period string, psi double")
    label = F.when(before, F.lit("reference")).otherwise(period(ts, unit))
    counts = (
        df.select(label.alias("period"), F.explode(F.array(*placed)).alias("_f"))
        .filter("_f.usable")
        .groupBy(F.col("_f.feature").alias("feature"), "period", F.col("_f.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return psi_from_counts(counts, bins)


def psi_from_counts(counts: DataFrame, bins: int = 10, min_values: int = MIN_PERIOD) -> DataFrame:
    """PSI from (feature, period, bin, n); bin null counts values outside all bins.

    From here on the data is a few rows per feature and period.
    """
    sizes = [F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)) for b in range(bins)]
    wide = counts.groupBy("feature", "period").agg(
        F.sum("n").alias("values"), F.array(*sizes).alias("c")
    )
    share = F.transform(
        "c", lambda n: (n + 1) / (F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x) + bins)
    )
    shares = wide.select("feature", "period", "values", share.alias("share"))
    reference = shares.filter("period = 'reference'").select("feature", F.col("share").alias("expected"))
    periods = shares.filter((F.col("period") != "reference") & (F.col("values") >= min_values))
    parts = F.zip_with("share", "expected", lambda a, e: (a - e) * F.ln(a / e))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return periods.join(reference, "feature").select("feature", "period", settle(total, 4).alias("psi"))


def psi(reference: DataFrame, actual: DataFrame, feature: str, bins: int = 10) -> DataFrame:
    """PSI between two tables for one feature, without minimum sizes."""
    place = binnings(reference, [feature], bins)[feature]

    def counted(df: DataFrame, label: str) -> DataFrame:
        counts = df.filter(_usable(feature)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        return counts.select(F.lit(feature).alias("feature"), F.lit(label).alias("period"), "bin", "n")

    both = counted(reference, "reference").unionByName(counted(actual, "actual"))
    return psi_from_counts(both, bins, min_values=0).select("feature", "psi")


def top_precision(
    alerts: DataFrame, cutoff=None, n: int = TOP_ALERTS, unit: str = "month",
    score: str = "final_risk_score",
) -> DataFrame:
    """Precision among the ``n`` best scores of each period; smaller periods are left out."""
    rows = alerts if cutoff is None else alerts.filter(F.col("timestamp") >= F.lit(cutoff).cast("timestamp"))
    rows = rows.select(period(unit=unit).alias("period"), "txn_id", score, "is_fraud")
    best = top_k(rows, ["period"], [F.col(score).desc(), F.col("txn_id")], n, ["txn_id"])
    return (
        best.groupBy("period")
        .agg(F.avg(F.col("is_fraud").cast("int")).alias("_p"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == n)
        .select("period", settle("_p", 4).alias("precision"))
    )


def label_rate(alerts: DataFrame, cutoff=None, unit: str = "month") -> DataFrame:
    rows = alerts if cutoff is None else alerts.filter(F.col("timestamp") >= F.lit(cutoff).cast("timestamp"))
    return rows.groupBy(period(unit=unit).alias("period")).agg(
        settle(F.avg(F.col("is_fraud").cast("int")), 4).alias("fraud_rate")
    )


def drifted_features(psi_table: DataFrame, threshold: float = PSI_THRESHOLD, periods: int = 2) -> DataFrame:
    return (
        psi_table.filter(F.col("psi") > threshold)
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("drifted_periods"))
        .filter(F.col("drifted_periods") >= periods)
    )


def verdict(psi_table: DataFrame, precision: DataFrame) -> DataFrame:
    """Drifted features, precision loss of more than a tenth, and whether to retrain."""
    drifted = drifted_features(psi_table).agg(
        F.count(F.lit(1)).alias("drifted"),
        F.array_join(F.array_sort(F.collect_list("feature")), "|").alias("drift_features"),
    )
    ends = precision.agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("precision", "period").alias("_first"),
        F.max_by("precision", "period").alias("_last"),
    )
    dropped = F.coalesce((F.col("_n") >= 2) & (F.col("_last") < F.col("_first") * 0.9), F.lit(False))
    one = F.lit(1).alias("_one")
    both = drifted.select("*", one).join(ends.select("*", one), "_one")
    return both.select(
        F.col("drifted").alias("drifted_features"),
        "drift_features",
        dropped.alias("precision_degradation"),
        ((F.col("drifted") >= 2) | dropped).alias("retraining_recommended"),
    )


def heat_table(psi_table: DataFrame, periods: Sequence[str] | None = None) -> DataFrame:
    """Features as rows, periods as columns: those named, or all in order (action)."""
    if periods is None:
        psi_table = settled(psi_table, "psi")
    return psi_table.groupBy("feature").pivot("period", periods and list(periods)).agg(F.first("psi"))


def monitoring_series(precision: DataFrame, rates: DataFrame) -> DataFrame:
    """Precision and label rate per period, in percent to one place."""
    return rates.join(precision, "period", "left").select(
        "period",
        settle(F.col("precision") * 100, 1).alias("precision_pct"),
        settle(F.col("fraud_rate") * 100, 1).alias("fraud_rate_pct"),
    )
