from pyspark.sql import functions as F

from paywatch.operators import forest
from paywatch.plans import stages
from paywatch.sources import testdata as data

CUTOFF = "2024-01-21"


def test_stages_from_transactions_to_monitoring(spark, sf_dir):
    txn = data.transactions(spark, sf_dir).withColumn("account_id", F.col("account_id").cast("string"))
    tables = stages.feature_stage(txn)
    network = stages.graph_stage(txn)
    prepared = stages.prepared_stage(tables, network)
    rows = txn.count()
    assert prepared.count() == rows
    models = stages.training_stage(prepared, CUTOFF, rounds=3, trees=10)
    scored = stages.scoring_stage(prepared, models)
    outside = " or ".join(f"{c} is null or {c} not between 0 and 1" for c in ("txn_risk_score", "behavior_anomaly_score"))
    assert scored.count() == rows and scored.filter(outside).count() == 0
    alerts = stages.alert_stage(scored, tables.transactions, network.accounts, network.flags)
    assert alerts.select("txn_id").distinct().count() == alerts.count() == rows
    report = stages.monitoring_stage(alerts, CUTOFF, unit="day")
    assert report["label_rate"].count() > 0 and report["verdict"].count() >= 1
    assert stages.evaluation_stage(prepared, models, CUTOFF, rounds=3).count() == 1
    assert forest.separation(scored).count() >= 1
