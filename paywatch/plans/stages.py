"""The batch stages from canonical transactions to alerts and monitoring.

Each stage returns lazy tables, except where a table that several later stages read is
settled once in the shared folder.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from paywatch.functions.topk import top_n
from paywatch.operators import (
    alerts, attribution, community, drift, features, forest, fusion, graph, metrics, model,
)
from paywatch.runtime import settled


class FeatureTables(NamedTuple):
    transactions: DataFrame
    profiles: DataFrame


class GraphTables(NamedTuple):
    accounts: DataFrame
    flags: DataFrame


class Models(NamedTuple):
    risk: PipelineModel
    trees: DataFrame
    bounds: tuple[float, float]


def feature_stage(
    txn: DataFrame, merchant: DataFrame | None = None, ip: DataFrame | None = None, method: str = "auto"
) -> FeatureTables:
    """Transaction features, written once, and the profiles read back from them."""
    table = settled(features.transaction_features(txn, merchant, ip, method), "features")
    return FeatureTables(table, features.account_profiles(table))


def graph_stage(txn: DataFrame, label_cutoff=None, **thresholds) -> GraphTables:
    """Account graph features with communities and risk score, and flags per transaction."""
    edges = settled(graph.edges(txn), "edges")
    nodes = graph.node_features(edges)
    found = community.communities(nodes, community.incidence(edges))
    rated = community.community_features(found, txn, label_cutoff)
    return GraphTables(graph.graph_features(nodes, rated), graph.topology_flags(txn, **thresholds))


def prepared_stage(tables: FeatureTables, network: GraphTables) -> DataFrame:
    """The training table, written once: fitting, bounds and scoring all read it."""
    return settled(model.prepare(tables.transactions, network.accounts, network.flags), "prepared")


def training_stage(prepared: DataFrame, cutoff=model.TRAIN_CUTOFF, rounds: int = 100, trees: int = 200) -> Models:
    """Both models, trained before the cutoff; the forest sees normal transactions only."""
    train, _ = model.temporal_split(prepared, cutoff)
    risk = model.train_risk(train, rounds=rounds)
    grown = forest.train_forest(train.filter("is_fraud = 0"), trees=trees)
    bounds = forest.score_bounds(forest.raw_score(prepared, grown))
    return Models(risk, grown, bounds)


def scoring_stage(prepared: DataFrame, models: Models) -> DataFrame:
    return settled(model.score_all(prepared, models.risk, models.trees, models.bounds), "scored")


def evaluation_stage(
    prepared: DataFrame, models: Models, cutoff=model.TRAIN_CUTOFF, rounds: int = 100
) -> DataFrame:
    """Metrics of the temporal split next to those of a random split, in one row."""
    _, test = model.temporal_split(prepared, cutoff)
    scored = settled(model.risk_score(models.risk, test), "test")
    rest, held = model.stratified_split(prepared)
    other = model.train_risk(rest, rounds=rounds)
    return model.metrics_row(
        metrics.ranking_metrics(scored),
        metrics.ranking_metrics(model.risk_score(other, held)),
        metrics.budget_metrics(scored),
    )


def alert_stage(
    scored: DataFrame, feature_table: DataFrame, graph_table: DataFrame, flags: DataFrame,
    explained: DataFrame | None = None,
) -> DataFrame:
    """The alert table, with each row's top attributions where they were computed."""
    table = fusion.run_fusion(scored, feature_table, graph_table, flags)
    if explained is None:
        return table
    return table.join(attribution.top_features(explained), "txn_id", "left")


def monitoring_stage(alert_table: DataFrame, cutoff=model.TRAIN_CUTOFF, unit: str = "month") -> dict[str, DataFrame]:
    """PSI, precision and label rate per period, and the verdict."""
    psi = drift.psi_by_period(alert_table, cutoff, unit=unit)
    precision = drift.top_precision(alert_table, cutoff, unit=unit)
    return {
        "psi": psi,
        "precision": precision,
        "label_rate": drift.label_rate(alert_table, cutoff, unit),
        "verdict": drift.verdict(psi, precision),
    }


def top_risky(txn: DataFrame, scores: DataFrame, limit: int = 100) -> DataFrame:
    """Highest final scores straight from transactions: velocity, ratio, fusion, top-n."""
    rows = features.rolling_features(txn).join(
        scores.select("txn_id", "txn_risk_score", "behavior_anomaly_score", "graph_risk_score"), "txn_id"
    )
    decided = fusion.decide(rows)
    return top_n(decided, alerts.by_score(), limit, ["txn_id"])
