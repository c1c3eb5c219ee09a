"""Data quality of the canonical table, and validation of case memos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywatch.functions.numbers import settle
from paywatch.schemas import ACTIONS, CRITICAL_COLUMNS, MONITORED_COLUMNS, PRIORITIES


def require_columns(df: DataFrame, required: list[str], name: str = "input") -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks required columns: {missing}")


def _is_missing(df: DataFrame, column: str) -> Column:
    null = F.col(column).isNull()
    if df.schema[column].dataType.typeName() in ("double", "float"):
        return null | F.isnan(column)
    return null


def null_rates(txn: DataFrame, columns: list[str] = MONITORED_COLUMNS) -> DataFrame:
    """Null rate of every monitored column that exists, all in one pass."""
    present = [c for c in columns if c in txn.columns]
    rates = txn.agg(*[F.avg(_is_missing(txn, c).cast("int")).alias(c) for c in present])
    return rates.unpivot([], present, "column_name", "null_rate")


def record_counts(txn: DataFrame, device: DataFrame | None = None, ip: DataFrame | None = None) -> DataFrame:
    """Rows, distinct accounts, devices and IPs (from the dimension tables when given)."""
    wide = [F.count(F.lit(1)).alias("transactions"), F.countDistinct("account_id").alias("unique_accounts")]
    if device is None:
        wide.append(F.countDistinct("device_id").alias("devices"))
    if ip is None:
        wide.append(F.countDistinct("ip_id").alias("ips"))
    counts = txn.agg(*wide)
    long = counts.unpivot([], counts.columns, "key", "value")
    for name, table in (("devices", device), ("ips", ip)):
        if table is not None:
            long = long.unionByName(
                table.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("key"), "value")
            )
    return long


def label_distribution(txn: DataFrame, by: str = "source") -> DataFrame:
    return txn.groupBy(by).agg(
        F.count_if("is_fraud").alias("fraud_count"),
        F.count("is_fraud").alias("total_count"),
        settle(F.count_if("is_fraud") / F.count("is_fraud"), 4).alias("fraud_rate"),
    )


def scenario_counts(txn: DataFrame) -> DataFrame:
    """Positives per scenario; positives without a scenario are left out."""
    known = txn.filter(F.col("is_fraud") & F.col("fraud_scenario").isNotNull())
    return known.groupBy("fraud_scenario").agg(F.count(F.lit(1)).alias("fraud_count"))


def coverage(txn: DataFrame) -> DataFrame:
    """Timestamp range and share of rows with a device and an IP."""
    return txn.agg(
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        settle(1 - F.avg(F.col("device_id").isNull().cast("int")), 4).alias("device_coverage"),
        settle(1 - F.avg(F.col("ip_id").isNull().cast("int")), 4).alias("ip_coverage"),
    )


def duplicates(df: DataFrame, key: str = "txn_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def uniqueness(txn: DataFrame, key: str = "txn_id") -> DataFrame:
    """Rows, distinct keys and whether they agree; the keys are grouped before counting."""
    per_key = txn.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.max("_n") <= 1, F.lit(True)).alias("is_unique"),
    )


def findings(txn: DataFrame, max_null: float = 0.05) -> DataFrame:
    """Errors (nulls in critical columns, duplicate ids) and warnings (many nulls)."""
    rates = null_rates(txn)
    critical = F.col("column_name").isin(CRITICAL_COLUMNS)
    nulls = rates.select(
        F.when(critical & (F.col("null_rate") > 0), "error")
        .when(~critical & (F.col("null_rate") > max_null), "warning").alias("severity"),
        "column_name",
        settle("null_rate", 4).alias("value"),
    ).filter("severity is not null")
    repeated = uniqueness(txn).filter("not is_unique").select(
        F.lit("error").alias("severity"),
        F.lit("txn_id").alias("column_name"),
        (F.col("row_count") - F.col("distinct_keys")).cast("double").alias("value"),
    )
    return nulls.unionByName(repeated)


def report(
    txn: DataFrame, device: DataFrame | None = None, ip: DataFrame | None = None, max_null: float = 0.05
) -> DataFrame:
    """The whole report in long form: (section, key, value), values as text.

    The table is read twice: one wide aggregate for all counts per column, and one grouping of
    all keys (accounts, devices, IPs, ids, sources, scenarios) together.
    """
    entry = lambda section, key, value: F.struct(
        F.lit(section).alias("section"), (F.lit(key) if isinstance(key, str) else key).cast("string").alias("key"),
        value.cast("string").alias("value"),
    )
    entries = lambda rows, *found: rows.select(F.explode(F.array_compact(F.array(*found))).alias("_e")).select("_e.*")

    present = [c for c in MONITORED_COLUMNS if c in txn.columns]
    share = lambda c: settle(1 - F.avg(F.col(c).isNull().cast("int")), 4)
    wide = txn.agg(
        F.count(F.lit(1)).alias("_rows"), F.min("timestamp").alias("_min"), F.max("timestamp").alias("_max"),
        share("device_id").alias("_device"), share("ip_id").alias("_ip"),
        *[F.avg(_is_missing(txn, c).cast("int")).alias(f"_null_{c}") for c in present],
    )
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    rates = {c: F.col(f"_null_{c}") for c in present}
    totals = entries(
        wide, entry("record_counts", "transactions", F.col("_rows")),
        *[entry("null_rates", c, settle(rate, 4)) for c, rate in rates.items()],
        entry("coverage", "min", stamp("_min")), entry("coverage", "max", stamp("_max")),
        entry("coverage", "device_assignment_coverage", F.col("_device")), entry("coverage", "ip_assignment_coverage", F.col("_ip")),
        *[
            F.when(rate > (0 if c in CRITICAL_COLUMNS else max_null), entry("findings", c, F.lit("error" if c in CRITICAL_COLUMNS else "warning")))
            for c, rate in rates.items()
        ],
    )

    counted = {"account_id": "unique_accounts"}
    counted |= ({"device_id": "devices"} if device is None else {}) | ({"ip_id": "ips"} if ip is None else {})
    kinds = [*counted, "txn_id", "source"]
    keyed = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    scenario = F.when(F.col("is_fraud") & F.col("fraud_scenario").isNotNull(), keyed("scenario", F.col("fraud_scenario")))
    keys = txn.select("is_fraud", F.explode(F.array_compact(F.array(*[keyed(k, F.col(k)) for k in kinds], scenario))).alias("_k"))
    per_key = keys.groupBy("_k.kind", "_k.key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_fraud").alias("fraud"), F.count("is_fraud").alias("labels")
    )
    # An empty table has no keys, but its counts are still told.
    none = txn.sparkSession.createDataFrame(
        [(k, None, 0, 0, 0) for k in kinds if k != "source"], "kind string, key string, n bigint, fraud bigint, labels bigint"
    )
    named = F.when(F.col("kind").isin("source", "scenario"), F.col("key")).alias("name")
    small = per_key.select("kind", "key", "n", "fraud", "labels").unionByName(none).groupBy("kind", named).agg(
        F.count("key").alias("keys"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("fraud").alias("fraud"), F.sum("labels").alias("labels"),
    )
    is_kind = lambda kind, made: F.when(F.col("kind") == kind, made)
    grouped = entries(
        small, *[is_kind(k, entry("record_counts", name, F.col("keys"))) for k, name in counted.items()],
        is_kind("txn_id", entry("uniqueness", "txn_id_unique", F.col("most") <= 1)),
        is_kind("txn_id", F.when(F.col("most") > 1, entry("findings", "txn_id", F.lit("error")))),
        is_kind("source", entry("fraud_count_by_source", F.col("name"), F.col("fraud"))),
        is_kind("source", entry("total_count_by_source", F.col("name"), F.col("labels"))),
        is_kind("source", entry("fraud_rate_by_source", F.col("name"), settle(F.col("fraud") / F.nullif(F.col("labels"), F.lit(0)), 4))),
        is_kind("scenario", entry("fraud_by_scenario", F.col("name"), F.col("n"))),
    )
    out = totals.unionByName(grouped)
    for name, table in (("devices", device), ("ips", ip)):
        if table is not None:
            out = out.unionByName(entries(table.agg(F.count(F.lit(1)).alias("_n")), entry("record_counts", name, F.col("_n"))))
    return out


def enforce(found: DataFrame) -> None:
    """Raise when there are errors (action). At most one row per checked column comes back."""
    errors = [r.column_name for r in found.filter("severity = 'error'").collect()]
    if errors:
        raise ValueError(f"validation failed with {len(errors)} error(s): {sorted(errors)}")


def memo_problem() -> Column:
    """First rule a case memo breaks, or null."""
    return (
        F.when(~F.coalesce(F.col("recommended_action").isin(ACTIONS), F.lit(False)), "invalid action")
        .when(~F.coalesce(F.col("priority").isin(PRIORITIES), F.lit(False)), "invalid priority")
        .when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "invalid confidence")
    )


def check_memos(memos: DataFrame) -> DataFrame:
    """Memos with the confidence rounded to 2 places and an ``error`` column."""
    return memos.withColumn("error", memo_problem()).withColumn(
        "confidence", settle("confidence", 2)
    )


def validate_memos(memos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows carry the ``error``."""
    checked = check_memos(memos)
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")
