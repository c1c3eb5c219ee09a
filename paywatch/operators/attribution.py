"""Additive attributions of the boosted-tree margin along each row's decision paths.

Every split moves the prediction from the node's mean to the child's mean; that step is
credited to the split feature. The credits and the bias add up to the margin exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywatch.functions.numbers import settle
from paywatch.runtime import scratch_path


def tree_table(model: PipelineModel, spark) -> tuple[list[tuple], list[str]]:
    """Nodes of the trained trees as arrays, and the feature names.

    Read from the saved model; the size is bounded by rounds * 2^(depth + 1) nodes.
    """
    trees, assembler = model.stages[-1], model.stages[-2]
    path = scratch_path(spark, "trees")
    trees.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()
    names = [c.removesuffix("_code") for c in assembler.getInputCols()]
    packed = []
    for tree, part in nodes.groupby("treeID"):
        part = part.sort_values("id")
        size = int(part["id"].max()) + 1
        feature, cut = np.full(size, -1), np.zeros(size)
        left, right, mean = np.zeros(size, int), np.zeros(size, int), np.zeros(size)
        groups: dict[int, frozenset] = {}
        for row in part.itertuples():
            mean[row.id] = row.prediction
            if row.leftChild >= 0:
                split = row.split
                feature[row.id], left[row.id], right[row.id] = split["featureIndex"], row.leftChild, row.rightChild
                if split["numCategories"] > 0:
                    groups[row.id] = frozenset(split["leftCategoriesOrThreshold"])
                else:
                    cut[row.id] = split["leftCategoriesOrThreshold"][0]
        packed.append((trees.treeWeights[int(tree)], feature, cut, left, right, mean, groups))
    return packed, names


def bias(packed: list[tuple]) -> float:
    return float(sum(t[0] * t[5][0] for t in packed))


def attributions(df: DataFrame, model: PipelineModel, key: str = "txn_id") -> DataFrame:
    """(key, margin, values): one attribution per feature, in the order of ``names``."""
    packed, names = tree_table(model, df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def explain(points: np.ndarray) -> np.ndarray:
        credit = np.zeros((len(points), len(names)))
        every = np.arange(len(points))
        for weight, feature, cut, left, right, mean, groups in packed:
            at = np.zeros(len(points), dtype=int)
            inner = feature[at] >= 0
            while inner.any():
                rows, nodes = every[inner], at[inner]
                value = points[rows, feature[nodes]]
                to_left = value <= cut[nodes]
                for node, members in groups.items():
                    here = nodes == node
                    to_left[here] = np.isin(value[here], list(members))
                child = np.where(to_left, left[nodes], right[nodes])
                np.add.at(credit, (rows, feature[nodes]), weight * (mean[child] - mean[nodes]))
                at[inner] = child
                inner = feature[at] >= 0
        return credit

    start = bias(packed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            credit = explain(np.array(batch["v"].tolist(), dtype=float).reshape(len(batch), -1))
            yield pd.DataFrame({key: batch[key], "margin": start + credit.sum(axis=1), "values": list(credit)})

    vectors = PipelineModel(model.stages[:-1]).transform(df).select(key, vector_to_array("features").alias("v"))
    explained = vectors.mapInPandas(run, f"{key} {kind}, margin double, values array<double>")
    return explained.withColumn("features", F.array(*map(F.lit, names)))


def top_features(explained: DataFrame, key: str = "txn_id", top: int = 5) -> DataFrame:
    """Per row a map of the ``top`` attributions by size, rounded to 4 places."""
    named = F.zip_with("features", "values", lambda f, v: F.struct(
        (-F.abs(v)).alias("size"), f.alias("f"), settle(v, 4).alias("v")
    ))
    best = F.slice(F.array_sort(named), 1, top)
    return explained.select(
        key, F.map_from_entries(F.transform(best, lambda p: F.struct(p["f"], p["v"]))).alias("shap_top_features")
    )


def global_importance(explained: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature; one partial aggregate, no exploding of rows."""
    names = explained.select("features").first()
    if names is None:
        return explained.sparkSession.createDataFrame([], "feature string, importance double")
    wide = explained.agg(*[
        F.avg(F.abs(F.col("values")[i])).alias(name) for i, name in enumerate(names[0])
    ])
    return wide.unpivot([], names[0], "feature", "importance")
