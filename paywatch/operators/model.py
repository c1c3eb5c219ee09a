"""Training table, temporal split, the supervised risk model and scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywatch.functions.keys import spread_join
from paywatch.functions.numbers import settle
from paywatch.operators import forest as isolation
from paywatch.schemas import (
    BOOLEAN_FEATURES, CATEGORICAL_FEATURES, GRAPH_FEATURES, NUMERIC_FEATURES, TOPOLOGY_FLAGS,
)

TRAIN_CUTOFF = "2024-10-01"

# --- fixed values: feature categories of the importance report ---
FEATURE_CATEGORIES = {
    "metadata": ["txn_type", "channel"],
    "velocity": [
        "amount_sum_24h", "amount_sum_1h", "txn_count_1h", "txn_count_24h", "txn_count_7d",
        "unique_merchants_7d", "unique_beneficiaries_7d", "unique_devices_30d",
    ],
    "graph": [
        "community_fraud_rate", "account_degree", "graph_risk_score", "device_shared_account_count",
        "beneficiary_in_degree",
    ],
    "behavioral": [
        "is_new_device", "is_new_beneficiary", "amount_vs_30d_avg", "amount_vs_30d_max",
        "days_since_last_txn", "ip_is_vpn", "merchant_fraud_rate_hist",
    ],
}
# --- end of fixed values ---


def prepare(
    features: DataFrame, graph: DataFrame | None = None, flags: DataFrame | None = None
) -> DataFrame:
    """Features with graph columns and flags joined, nulls filled, flags and label as 0/1."""
    df = features
    if graph is not None:
        known = graph.select("account_id", *[c for c in GRAPH_FEATURES if c in graph.columns])
        df = spread_join(df, known, ["account_id"], ["txn_id"])
    if flags is not None:
        df = df.join(flags.select("txn_id", *TOPOLOGY_FLAGS), "txn_id", "left")
    numeric = [c for c in NUMERIC_FEATURES if c in df.columns]
    boolean = [c for c in BOOLEAN_FEATURES if c in df.columns]
    categorical = [c for c in CATEGORICAL_FEATURES if c in df.columns]
    df = df.fillna(0.0, numeric).fillna(False, boolean).fillna("UNKNOWN", categorical)
    return df.withColumns({c: F.col(c).cast("int") for c in [*boolean, "is_fraud"]})


def feature_columns(df: DataFrame) -> list[str]:
    """The named features the table has; absent ones are skipped."""
    return [c for c in NUMERIC_FEATURES + BOOLEAN_FEATURES + CATEGORICAL_FEATURES if c in df.columns]


def temporal_split(df: DataFrame, cutoff=TRAIN_CUTOFF) -> tuple[DataFrame, DataFrame]:
    at = F.lit(cutoff).cast("timestamp")
    return df.filter(F.col("timestamp") < at), df.filter(F.col("timestamp") >= at)


def split_summary(df: DataFrame, cutoff=TRAIN_CUTOFF) -> DataFrame:
    """Rows, positives, rate and time range of both sides, in one pass."""
    side = F.when(F.col("timestamp") < F.lit(cutoff).cast("timestamp"), "train").otherwise("test")
    label = F.col("is_fraud").cast("int")
    return df.groupBy(side.alias("split")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(label).alias("fraud_count"),
        F.avg(label).alias("fraud_rate"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def class_balance(df: DataFrame) -> DataFrame:
    label = F.col("is_fraud").cast("int")
    counts = df.agg(F.sum(label).alias("positives"), F.sum(1 - label).alias("negatives"))
    return counts.withColumn(
        "positive_weight", F.col("negatives") / F.greatest("positives", F.lit(1))
    )


def stratified_split(
    df: DataFrame, label: str = "is_fraud", fraction: float = 0.25, seed: int = 42, key: str = "txn_id"
) -> tuple[DataFrame, DataFrame]:
    """Random (rest, held out) with the same share of each label.

    Rows are ordered by a seeded hash; each label's cut is a quantile of that hash, so the
    split is repeatable and needs no ranking of a whole label in one task.
    """
    place = F.xxhash64(F.col(key), F.lit(seed))
    placed = df.withColumn("_place", place)
    cuts = placed.groupBy(label).agg(F.percentile_approx("_place", fraction, 100_000).alias("_cut"))
    cuts = cuts.withColumnRenamed(label, "_label")  # one row per label, null being one
    joined = placed.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_label")))
    held = joined.filter(F.col("_place") <= F.col("_cut")).select(*df.columns)
    rest = joined.filter(F.col("_place") > F.col("_cut")).select(*df.columns)
    return rest, held


def train_risk(
    train: DataFrame, valid_fraction: float = 0.1, seed: int = 42, rounds: int = 100,
    key: str = "txn_id",
) -> PipelineModel:
    """Boosted trees on the prepared table (action).

    Positives are weighted by the class balance. Early stopping uses a hashed share of the
    training rows, never the test period.
    """
    columns = feature_columns(train)
    texts = [c for c in columns if c in CATEGORICAL_FEATURES]
    coded = [f"{c}_code" for c in texts]
    weight = class_balance(train).first()["positive_weight"]
    rows = train.withColumns({
        "label": F.col("is_fraud").cast("double"),
        "weight": F.when(F.col("is_fraud") == 1, F.lit(float(weight))).otherwise(F.lit(1.0)),
        "held_out": F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000)) < int(valid_fraction * 1000),
    })
    stages = []
    if texts:
        stages.append(StringIndexer(inputCols=texts, outputCols=coded, handleInvalid="keep"))
    stages += [
        VectorAssembler(inputCols=[c for c in columns if c not in texts] + coded, outputCol="features"),
        GBTClassifier(
            featuresCol="features", labelCol="label", weightCol="weight", stepSize=0.05, maxDepth=6,
            minInstancesPerNode=50, maxIter=rounds, seed=seed, validationIndicatorCol="held_out",
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def risk_score(model: PipelineModel, df: DataFrame, name: str = "txn_risk_score") -> DataFrame:
    """Add the probability of fraud; works on batch and streaming tables."""
    texts = [c for c in CATEGORICAL_FEATURES if c in df.columns]
    kept = [F.col(c) for c in df.columns]
    scored = model.transform(df.fillna("UNKNOWN", texts))
    return scored.select(*kept, vector_to_array("probability")[1].alias(name))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_all(df: DataFrame, model: PipelineModel, trees: DataFrame, bounds: tuple[float, float]) -> DataFrame:
    """Both scores for every prepared transaction, in the scored-table layout."""
    scored = isolation.forest_score(risk_score(model, df), trees, bounds)
    return scored.select(
        "txn_id", "account_id", "timestamp", "amount", F.col("is_fraud").cast("boolean").alias("is_fraud"),
        "fraud_scenario", "txn_risk_score", "behavior_anomaly_score",
    )


def feature_category(feature: Column) -> Column:
    out = F
    for category, names in FEATURE_CATEGORIES.items():
        out = out.when(feature.isin(names), category)
    return out.otherwise("other")


def categorized_importance(importance: DataFrame, top: int = 10) -> DataFrame:
    """Most important features with their category."""
    best = importance.orderBy(F.col("importance").desc(), "feature").limit(top)
    return best.select(
        "feature", settle("importance", 4).alias("importance"), feature_category(F.col("feature")).alias("category")
    )


def metrics_row(temporal: DataFrame, random: DataFrame, budget: DataFrame) -> DataFrame:
    """One row with the metrics of both splits; inflation is random minus temporal."""
    one = F.lit(1).alias("_one")
    t = temporal.select(F.col("average_precision").alias("pr_auc_temporal"), F.col("roc_auc").alias("roc_auc_temporal"), one)
    r = random.select(F.col("average_precision").alias("pr_auc_random"), F.col("roc_auc").alias("roc_auc_random"), one)
    joined = t.join(r, "_one").join(budget.select("*", one), "_one").drop("_one")
    return joined.withColumns({
        "auc_inflation_pr": F.col("pr_auc_random") - F.col("pr_auc_temporal"),
        "auc_inflation_roc": F.col("roc_auc_random") - F.col("roc_auc_temporal"),
    })
