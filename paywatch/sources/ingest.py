"""Raw readers, the mapping to canonical transactions, dimensions and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paywatch.functions.keys import spread_join
from paywatch.functions.ordered import with_ordinal
from paywatch.functions.sampling import hash_sample
from paywatch.operators.quality import require_columns
from paywatch.schemas import (
    AML_ACCOUNTS, AML_ALERT_ACCOUNTS, AML_TRANSACTIONS, CANONICAL_COLUMNS, CASE_MEMO, DIMENSIONS,
    MOBILE_MONEY,
)

# --- fixed values of the raw-to-canonical mapping ---
BASE_DATE = "2024-01-01"
REASON_TO_SCENARIO = {"fan_in": "FAN_IN", "fan_out": "FAN_OUT", "cycle": "MULE_CHAIN"}
DEFAULT_AML_SCENARIO = "AMLSIM_AML"
MOBILE_MONEY_SOURCE = "PAYSIM"
MOBILE_MONEY_SCENARIO = "PAYSIM_FRAUD"
AML_SOURCE = "AMLSIM"
# --- end of fixed values ---

AML_FILES = {
    "transactions": AML_TRANSACTIONS,
    "accounts": AML_ACCOUNTS,
    "alert_accounts": AML_ALERT_ACCOUNTS,
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its own file system (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_csv(spark: SparkSession, path: str, schema: str, keep_rest: bool = False) -> DataFrame:
    """CSV with a header. Columns are matched by header name and cast to the schema; a cell
    that cannot be cast becomes null. Other columns are dropped, or kept as text."""
    raw = spark.read.option("header", True).csv(path)
    wanted = spark.createDataFrame([], schema).schema
    require_columns(raw, [f.name for f in wanted], path)
    rest = [c for c in raw.columns if c not in wanted.names] if keep_rest else []
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted], *rest)


def read_mobile_money(spark: SparkSession, path: str) -> DataFrame:
    """Raw mobile-money log without rows that lack amount, sender or receiver."""
    return read_csv(spark, path, MOBILE_MONEY).dropna(subset=["amount", "nameOrig", "nameDest"])


def read_aml(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The AML tables that are present in the folder; accounts with all their columns."""
    found = {}
    for name, schema in AML_FILES.items():
        path = f"{folder.rstrip('/')}/{name}.csv"
        if exists(spark, path):
            found[name] = read_csv(spark, path, schema, keep_rest=name == "accounts")
    return found


def _at_step(step: str) -> Column:
    return F.timestamp_seconds(
        F.unix_timestamp(F.lit(BASE_DATE).cast("timestamp")) + F.col(step).cast("bigint") * 3600
    )


def _numbered(df: DataFrame, order: Sequence[str], prefix: str) -> DataFrame:
    """Dense ids in the order of all mapped columns: equal rows are interchangeable."""
    placed = with_ordinal(df, [F.col(c) for c in order], "_no")
    return placed.withColumn("txn_id", F.concat(F.lit(prefix), F.col("_no").cast("string")))


def canonical_mobile_money(raw: DataFrame) -> DataFrame:
    """Mobile-money rows in the canonical layout (action: rows are numbered)."""
    order = ["step", "type", "amount", "nameOrig", "nameDest", "isFraud"]
    fraud = F.col("isFraud") == 1
    return _numbered(raw.select(*order), order, "TXN_PS_").select(
        "txn_id",
        F.concat(F.lit("ACC_"), "nameOrig").alias("account_id"),
        F.lit(None).cast("string").alias("merchant_id"),
        F.concat(F.lit("ACC_"), "nameDest").alias("beneficiary_id"),
        F.lit(None).cast("string").alias("device_id"),
        F.lit(None).cast("string").alias("ip_id"),
        "amount",
        F.lit("USD").alias("currency"),
        F.col("type").alias("txn_type"),
        F.lit("MOBILE").alias("channel"),
        _at_step("step").alias("timestamp"),
        fraud.alias("is_fraud"),
        F.when(fraud, MOBILE_MONEY_SCENARIO).alias("fraud_scenario"),
        F.lit(MOBILE_MONEY_SOURCE).alias("source"),
    )


def scenario_of_reason(reason: Column) -> Column:
    out = F
    for name, scenario in REASON_TO_SCENARIO.items():
        out = out.when(F.lower(reason) == name, scenario)
    return out.otherwise(DEFAULT_AML_SCENARIO)


def flagged_accounts(alert_accounts: DataFrame, order: str | None = None) -> DataFrame:
    """Reported accounts with their scenario; the last alert row of an account wins.

    ``order`` names a column giving the row order; without it the file order is used.
    """
    rank = F.col(order) if order else F.monotonically_increasing_id()
    reported = alert_accounts.withColumn("_at", rank).filter(F.col("isSAR"))
    return reported.groupBy(F.col("accountID").cast("string").alias("nameOrig")).agg(
        scenario_of_reason(F.max_by("reason", "_at")).alias("_scenario")
    )


def canonical_aml(
    raw: DataFrame, alert_accounts: DataFrame | None = None, order: str | None = None
) -> DataFrame:
    """AML rows in the canonical layout (action: rows are numbered).

    A row is fraud when it is reported itself or its sender is a reported account.
    """
    columns = ["step", "type", "amount", "nameOrig", "nameDest", "isSAR"]
    rows = _numbered(raw.select(*columns), columns, "TXN_AML_")
    if alert_accounts is None:
        joined = rows.withColumn("_scenario", F.lit(None).cast("string"))
    else:
        named = rows.withColumn("nameOrig", F.col("nameOrig").cast("string"))
        joined = spread_join(named, flagged_accounts(alert_accounts, order), ["nameOrig"], ["txn_id"])
    fraud = (F.coalesce(F.col("isSAR").cast("int"), F.lit(0)) == 1) | F.col("_scenario").isNotNull()
    return joined.select(
        "txn_id",
        F.concat(F.lit("ACC_AML_"), F.col("nameOrig").cast("string")).alias("account_id"),
        F.lit(None).cast("string").alias("merchant_id"),
        F.concat(F.lit("ACC_AML_"), F.col("nameDest").cast("string")).alias("beneficiary_id"),
        F.lit(None).cast("string").alias("device_id"),
        F.lit(None).cast("string").alias("ip_id"),
        "amount",
        F.lit("USD").alias("currency"),
        F.col("type").alias("txn_type"),
        F.lit("ONLINE").alias("channel"),
        _at_step("step").alias("timestamp"),
        fraud.alias("is_fraud"),
        F.when(fraud, F.coalesce("_scenario", F.lit(DEFAULT_AML_SCENARIO))).alias("fraud_scenario"),
        F.lit(AML_SOURCE).alias("source"),
    )


def union_sources(frames: Sequence[DataFrame], columns: Sequence[str] = tuple(CANONICAL_COLUMNS)) -> DataFrame:
    """All sources on the same columns; none at all is an error."""
    if not frames:
        raise ValueError("no transaction source")
    first, *rest = [df.select(*columns) for df in frames]
    for df in rest:
        first = first.unionByName(df)
    return first


def load_transactions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of the parquet sources that exist."""
    return union_sources([spark.read.parquet(p) for p in paths if exists(spark, p)])


def load_dimensions(
    spark: SparkSession, roots: Sequence[str], names: Sequence[str] = tuple(DIMENSIONS)
) -> dict[str, DataFrame]:
    """Each dimension from the first root that has it; absent ones are left out."""
    found = {}
    for name in names:
        for root in roots:
            path = f"{root.rstrip('/')}/{name}.parquet"
            if exists(spark, path):
                found[name] = spark.read.parquet(path)
                break
    return found


def derive_accounts(txn: DataFrame) -> DataFrame:
    """One account row per sender, with constant attributes."""
    account = F.col("account_id").cast("string")
    return txn.select("account_id").distinct().select(
        "account_id",
        F.concat(F.lit("CUST_"), F.replace(account, F.lit("ACC_"), F.lit(""))).alias("customer_id"),
        F.lit("CHECKING").alias("account_type"),
        F.lit(0.0).alias("balance"),
        F.lit("ACTIVE").alias("status"),
        F.lit(BASE_DATE).cast("timestamp").alias("created_at"),
    )


def mixed_sample(
    df: DataFrame, n: int = 1000, label: str = "is_fraud", seed: int = 42, key: str = "txn_id"
) -> DataFrame:
    """About half random rows, half positives, each id once, at most ``n``.

    "Random" is the order of a seeded hash, so the same rows come back on every run.
    """
    some = hash_sample(df, n // 2, key, seed)
    positive = hash_sample(df.filter(F.col(label)), n // 2, key, seed + 1)
    return some.unionByName(positive).dropDuplicates([key]).limit(n)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_memos(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Case memos, one JSON document per file, or one per line without ``multi_line``."""
    return spark.read.schema(CASE_MEMO).option("multiLine", multi_line).json(path)


def write_memos(memos: DataFrame, path: str) -> None:
    """Validated memos as JSON lines, in a folder per recommended action."""
    memos.write.mode("append").partitionBy("recommended_action").json(path)
