"""Ranking metrics of a scored, labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywatch.functions.ordered import running_totals
from paywatch.schemas import DAY


def score_levels(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score with its positives and negatives."""
    positive = F.col(label).cast("boolean")
    return scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def ranking_metrics(scored: DataFrame, score: str = "txn_risk_score", label: str = "is_fraud") -> DataFrame:
    """Average precision and ROC-AUC, ties handled by distinct score (action).

    Average precision adds up precision times the recall gained at each distinct score.
    ROC-AUC counts, per level, the negatives ranked lower plus half of those tied.
    """
    levels = score_levels(scored, score, label)
    ranked = running_totals(levels, [F.col("score").desc()], {"tp": "pos", "fp": "neg"})
    summed = ranked.agg(
        F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("_ap"),
        F.sum(F.col("pos").cast("double") * F.col("fp")).alias("_above"),
        F.sum(F.col("pos").cast("double") * F.col("neg")).alias("_tied"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    # ``fp`` includes the level itself: below = all - fp.
    won = pairs - F.col("_above") + F.col("_tied") / 2
    return summed.select(
        "positives", "negatives",
        F.when(F.col("positives") > 0, F.col("_ap") / F.col("positives")).alias("average_precision"),
        F.when(pairs > 0, won / pairs).alias("roc_auc"),
    )


def budget_metrics(
    scored: DataFrame, per_day: int = 500, score: str = "txn_risk_score", label: str = "is_fraud",
    key: str = "txn_id",
) -> DataFrame:
    """Precision and recall among the top ``per_day * days`` scores (action).

    The budget can be a large share of the table, so the cut is found from the counts per
    distinct score; only the level the budget ends in is ordered by key.
    """
    span = scored.agg(
        F.min(F.unix_timestamp("timestamp")).alias("lo"), F.max(F.unix_timestamp("timestamp")).alias("hi"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label).cast("boolean")).alias("positives"),
    ).first()
    days = max(1, ((span["hi"] or 0) - (span["lo"] or 0)) // DAY)
    budget = min(per_day * days, span["n"])
    levels = score_levels(scored, score, label).withColumn("n", F.col("pos") + F.col("neg"))
    ranked = running_totals(levels, [F.col("score").desc()], {"upto": "n"})
    whole = ranked.filter(F.col("upto") <= budget).agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("taken")
    ).first()
    hits, left = whole["hits"], budget - whole["taken"]
    if left > 0:
        cut = ranked.filter(F.col("upto") > budget).agg(F.max("score").alias("s")).first()["s"]
        tied = scored.filter(F.col(score) == F.lit(cut)).select(
            key, F.col(label).cast("boolean").cast("bigint").alias("hit"), F.lit(1).cast("bigint").alias("one")
        )
        placed = running_totals(tied, [F.col(key)], {"place": "one"})
        hits += placed.filter(F.col("place") <= left).agg(F.coalesce(F.sum("hit"), F.lit(0))).first()[0]
    row = (
        int(days), int(budget), int(hits),
        hits / budget if budget else None, hits / max(span["positives"], 1),
    )
    return scored.sparkSession.createDataFrame(
        [row], "test_days bigint, alert_budget bigint, hits bigint, precision_at_budget double, "
               "recall_at_budget double"
    )
