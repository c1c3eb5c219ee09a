"""Weighted score fusion, rule boosters, actions, bands and reason codes."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywatch.functions.keys import spread_join
from paywatch.functions.ordered import with_ordinal
from paywatch.schemas import ACTION_CUTS, ALERT_COLUMNS, TOPOLOGY_FLAGS

RULE_FEATURES = [
    "is_new_device", "is_new_beneficiary", "amount_vs_30d_avg", "merchant_fraud_rate_hist", "ip_is_vpn",
]
FLAGS = ["is_new_device", "is_new_beneficiary", "ip_is_vpn", *TOPOLOGY_FLAGS]


def merge_signals(
    scored: DataFrame, features: DataFrame, graph: DataFrame, flags: DataFrame
) -> DataFrame:
    """Scored transactions with rule features, graph score and topology flags, nulls filled."""
    extra = [c for c in RULE_FEATURES if c in features.columns and c not in scored.columns]
    # The joins on txn_id keep one row per transaction, so accounts are counted on ``scored``.
    joined = (
        scored.join(features.select("txn_id", *extra), "txn_id", "left")
        .join(flags.select("txn_id", *TOPOLOGY_FLAGS), "txn_id", "left")
        .transform(
            spread_join, graph.select("account_id", "graph_risk_score"), ["account_id"], ["txn_id"], "left", scored
        )
    )
    return fill_signals(joined)


def fill_signals(df: DataFrame) -> DataFrame:
    """Neutral values for missing signals: scores and rates 0, ratio 1, flags False."""
    neutral = {
        "txn_risk_score": 0.0, "behavior_anomaly_score": 0.0, "graph_risk_score": 0.0,
        "amount_vs_30d_avg": 1.0, "merchant_fraud_rate_hist": 0.0,
        **dict.fromkeys([*FLAGS, "watchlist_hit"], False),
    }
    return df.fillna({c: v for c, v in neutral.items() if c in df.columns})


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)


def _number(df: DataFrame, name: str, default: float) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def final_score(df: DataFrame, ruleset: str = "batch") -> Column:
    """Base score plus boosters, clipped to [0, 1]; the full rule set also uses watchlist hits."""
    base = (
        F.lit(0.50) * _number(df, "txn_risk_score", 0.0)
        + F.lit(0.25) * _number(df, "behavior_anomaly_score", 0.0)
        + F.lit(0.25) * _number(df, "graph_risk_score", 0.0)
    )
    ratio = _number(df, "amount_vs_30d_avg", 1.0)
    boosts = [
        (_flag(df, "structuring_flag"), 0.20),
        (_flag(df, "is_shared_device") & _flag(df, "is_new_beneficiary"), 0.15),
        (_flag(df, "is_fan_out_source"), 0.10),
        (_flag(df, "is_mule_chain_member") & (ratio > 3.0), 0.10),
        (_flag(df, "ip_is_vpn") & _flag(df, "is_new_device"), 0.10),
    ]
    if ruleset == "full":
        boosts.append((_flag(df, "watchlist_hit"), 0.30))
    boost = reduce(add, [F.when(rule, F.lit(by)).otherwise(F.lit(0.0)) for rule, by in boosts])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + boost))


def _graded(score: Column, position: int, lowest: str) -> Column:
    grade = F
    for cut in ACTION_CUTS:
        grade = grade.when(score >= cut[0], cut[position])
    return grade.otherwise(lowest)


def action(score: str | Column) -> Column:
    return _graded(F.col(score) if isinstance(score, str) else score, 1, "ALLOW")


def risk_band(score: str | Column) -> Column:
    return _graded(F.col(score) if isinstance(score, str) else score, 2, "LOW")


def reason_codes(df: DataFrame, ruleset: str = "batch") -> Column:
    """Codes of the rules that fire, in a fixed order."""
    ratio = _number(df, "amount_vs_30d_avg", 1.0)
    new_device, new_payee = _flag(df, "is_new_device"), _flag(df, "is_new_beneficiary")
    full = ruleset == "full"
    rules = [
        ("NEW_DEVICE_HIGH_VALUE_TXN", new_device & (ratio > 2.0)),
        ("SHARED_DEVICE_CLUSTER", _flag(df, "is_shared_device")),
        ("STRUCTURING_PATTERN", _flag(df, "structuring_flag")),
        ("FAN_OUT_PATTERN", _flag(df, "is_fan_out_source")),
        ("FAN_IN_PATTERN", _flag(df, "is_fan_in_target")),
        ("AMOUNT_4X_BASELINE", ratio > 4.0),
        *([("WATCHLIST_HIT", _flag(df, "watchlist_hit"))] if full else []),
        ("IP_COUNTRY_MISMATCH", _flag(df, "ip_is_vpn") & new_payee),
        ("HIGH_RISK_MERCHANT", _number(df, "merchant_fraud_rate_hist", 0.0) > 0.05),
        ("MULE_CHAIN_DETECTED", _flag(df, "is_mule_chain_member")),
    ]
    if full:
        burst = (
            (ratio > 1.0)
            & (_number(df, "behavior_anomaly_score", 0.0) > 0.5)
            & (_number(df, "txn_risk_score", 0.0) > 0.3)
        )
        rules += [("NEW_PAYEE_LARGE_TXN", new_payee & (ratio > 2.0)), ("BURST_VELOCITY", burst)]
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))


def decide(df: DataFrame, ruleset: str = "batch") -> DataFrame:
    """Add final score, action, band and reason codes.

    The batch rules give codes to flagged rows only, and ELEVATED_RISK_SCORE where no
    rule fires; the full rules give the fired codes of every row.
    """
    rated = df.withColumn("final_risk_score", final_score(df, ruleset))
    rated = rated.withColumns({"action": action("final_risk_score"), "risk_band": risk_band("final_risk_score")})
    codes = reason_codes(rated, ruleset)
    if ruleset != "full":
        none = F.array().cast("array<string>")
        some = F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("ELEVATED_RISK_SCORE")))
        codes = F.when(F.col("action") == "ALLOW", none).otherwise(some)
    return rated.withColumn("reason_codes", codes)


def alert_table(decided: DataFrame) -> DataFrame:
    """One alert per transaction, numbered by time (action: the order is settled on disk)."""
    numbered = with_ordinal(decided, [F.col("timestamp"), F.col("txn_id")], "_no")
    digits = F.col("_no").cast("string")
    padded = F.when(F.length(digits) >= 8, digits).otherwise(F.lpad(digits, 8, "0"))
    return numbered.withColumns({
        "alert_id": F.concat(F.lit("ALT_"), padded),
        "triggered_at": F.col("timestamp"),
    }).select(*ALERT_COLUMNS)


def run_fusion(scored: DataFrame, features: DataFrame, graph: DataFrame, flags: DataFrame) -> DataFrame:
    return alert_table(decide(merge_signals(scored, features, graph, flags)))
