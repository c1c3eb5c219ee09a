import numpy as np
import pytest
from pyspark.sql import functions as F

from paywatch.operators import attribution, forest, model


@pytest.fixture(scope="module")
def prepared(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(3000):
        amount, tier = float(rng.lognormal(3, 1)), ["LOW", "MEDIUM", "HIGH"][rng.integers(0, 3)]
        risk = 0.05 + 0.5 * (amount > 40) + 0.3 * (tier == "HIGH")
        rows.append((i, f"A{i % 50}", int(rng.random() < risk), amount, float(rng.integers(1, 9)), int(amount > 60), tier))
    df = spark.createDataFrame(
        rows, "txn_id bigint, account_id string, is_fraud int, amount_sum_24h double, txn_count_7d double, "
              "is_new_device int, mcc_risk_tier string"
    )
    return df.withColumn("timestamp", F.timestamp_seconds(F.col("txn_id") * 3600 + 1704067200)).cache()


@pytest.fixture(scope="module")
def trained(prepared):
    return model.train_risk(prepared, rounds=8)


def test_risk_model_ranks_and_survives_saving(spark, prepared, trained, tmp_path):
    from paywatch.operators import metrics

    scored = model.risk_score(trained, prepared)
    assert metrics.ranking_metrics(scored).first().roc_auc > 0.7
    model.save(trained, str(tmp_path / "m"))
    again = model.risk_score(model.load(str(tmp_path / "m")), prepared)
    assert scored.exceptAll(again).count() == 0


def test_attributions_add_up_to_the_margin(prepared, trained):
    from pyspark.ml.functions import vector_to_array

    explained = attribution.attributions(prepared, trained)
    raw = trained.transform(prepared).select("txn_id", vector_to_array("rawPrediction")[1].alias("raw"))
    worst = explained.join(raw, "txn_id").agg(F.max(F.abs(F.col("margin") - F.col("raw")))).first()[0]
    assert worst < 1e-6
    top = attribution.top_features(explained).first().shap_top_features
    assert 1 <= len(top) <= 5
    best = model.categorized_importance(attribution.global_importance(explained)).orderBy(F.col("importance").desc())
    assert best.first().feature == "amount_sum_24h" and best.first().category == "velocity"


def test_forest_puts_outliers_on_top(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (1500, 2)))]
    rows += [(5000 + i, 12.0 + i, -15.0 - i) for i in range(5)]
    df = spark.createDataFrame(rows, "txn_id bigint, txn_count_7d double, amount_sum_24h double")
    trees = forest.train_forest(df.filter("txn_id < 5000"), trees=60, sample=128)
    assert trees.select("tree").distinct().count() == 60
    scored = forest.forest_score(df, trees)
    lo, hi = scored.agg(F.min("behavior_anomaly_score"), F.max("behavior_anomaly_score")).first()
    assert (lo, hi) == (0.0, 1.0)
    top = [r.txn_id for r in scored.orderBy(F.col("behavior_anomaly_score").desc()).limit(5).collect()]
    assert set(top) == {5000 + i for i in range(5)}


def test_forest_survives_saving(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("txn_id"), (F.col("id") * 1.0).alias("txn_count_7d"))
    trees = forest.train_forest(df, trees=5, sample=32)
    bounds = forest.score_bounds(forest.raw_score(df, trees))
    forest.save(trees, bounds, str(tmp_path / "f"))
    again, kept = forest.load(spark, str(tmp_path / "f"))
    assert kept == bounds
    first, second = (forest.forest_score(df, t, b) for t, b in [(trees, bounds), (again, kept)])
    assert first.exceptAll(second).count() == 0


def test_forest_is_repeatable(spark):
    df = spark.range(300).select(F.col("id").alias("txn_id"), (F.col("id") * 1.0).alias("txn_count_7d"))
    first, second = (sorted(forest.train_forest(df, trees=5, sample=32).collect()) for _ in range(2))
    assert first == second


def test_average_path():
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1
    assert forest.average_path(256) == pytest.approx(10.244770920)


def test_stratified_split_keeps_the_label_share(prepared):
    rest, held = model.stratified_split(prepared)
    assert rest.count() + held.count() == prepared.count()
    for label in (0, 1):
        whole = prepared.filter(F.col("is_fraud") == label).count()
        assert held.filter(F.col("is_fraud") == label).count() == pytest.approx(whole * 0.25, abs=3)


def test_stratified_split_keeps_rows_without_label(spark):
    df = spark.range(400).select(F.col("id").alias("txn_id"), F.expr("nullif(id % 3, 2)").alias("is_fraud"))
    rest, held = model.stratified_split(df)
    assert rest.unionByName(held).exceptAll(df).count() == 0 and rest.count() + held.count() == 400


def test_missing_features_are_skipped(prepared):
    assert model.feature_columns(prepared) == ["txn_count_7d", "amount_sum_24h", "is_new_device", "mcc_risk_tier"]


def test_compiled_tree_walks_without_masks():
    import numpy as np

    from paywatch.operators.forest import average_path, compiled

    # Node 0 splits on feature 1, its lower branch 1 on feature 0; 2, 3 and 4 are leaves.
    columns = ([1, 0, -1, -1, -1], [0.5, 2.0, 0.0, 0.0, 0.0], [1, 3, -1, -1, -1], [2, 4, -1, -1, -1], [9, 5, 4, 3, 2])
    levels, feature, threshold, child, value = compiled(*(np.array(c) for c in columns))
    points, at = np.array([[2.0, 0.5], [3.0, 0.0], [0.0, 1.0]]), np.zeros(3, dtype=int)
    for _ in range(levels):
        at = child[2 * at + (points[np.arange(3), feature[at]] <= threshold[at])]
    assert levels == 2 and at.tolist() == [3, 4, 2]
    assert value[at].tolist() == [2 + average_path(3), 2 + average_path(2), 1 + average_path(4)]
