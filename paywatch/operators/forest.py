"""Isolation forest (Liu, Ting, Zhou 2008) trained and applied with Spark.

Training draws a small sample per tree, groups it by tree and grows each tree in one
task; the forest is a table of nodes. Scoring walks all trees for a batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paywatch.functions.sampling import hash_sample
from paywatch.runtime import settled
from paywatch.schemas import ANOMALY_FEATURES

NODE = "tree int, node int, feature int, threshold double, below int, above int, size int"


def average_path(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def tree_samples(df: DataFrame, trees: int, sample: int, seed: int, key: str) -> DataFrame:
    """About ``sample`` rows per tree as (tree, columns...).

    The pool is a random ``trees * sample`` rows, dealt out to the trees; a smaller table
    is dealt out several times, each time in another order.
    """
    pool = settled(hash_sample(df, trees * sample, key, seed))
    n = pool.count()
    copies = min(trees, -(-trees * sample // max(n, 1)))
    # At most trees * sample rows reach the window, times the copies that small tables need.
    dealt = pool.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    shuffled = Window.partitionBy("_copy").orderBy(
        F.xxhash64(F.col(key), F.col("_copy"), F.lit(seed)), F.col(key)
    )
    placed = dealt.withColumn("_place", F.row_number().over(shuffled) - 1 + F.col("_copy") * n)
    return placed.withColumn("tree", (F.col("_place") % trees).cast("int")).drop("_copy", "_place")


def train_forest(
    df: DataFrame, columns: Sequence[str] = tuple(ANOMALY_FEATURES), trees: int = 200,
    sample: int = 256, seed: int = 42, key: str = "txn_id",
) -> DataFrame:
    """Node table of a forest grown on ``df``; give it the normal transactions only."""
    names = [c for c in columns if c in df.columns]
    values = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    samples = tree_samples(values, trees, sample, seed, key)
    depth = int(np.ceil(np.log2(max(sample, 2))))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        points = rows.drop_duplicates(key).sort_values(key)[names].to_numpy(float)[:sample]
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = [[]]
        todo = [(0, points, 0)]
        while todo:
            at, part, level = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if level >= depth or len(part) <= 1 or len(usable) == 0:
                nodes[at] = [tree, at, -1, 0.0, -1, -1, len(part)]
                continue
            feature = int(rng.choice(usable))
            cut = float(rng.uniform(low[feature], high[feature]))
            below = part[:, feature] <= cut
            left = len(nodes)
            nodes += [[], []]
            nodes[at] = [tree, at, feature, cut, left, left + 1, len(part)]
            todo += [(left, part[below], level + 1), (left + 1, part[~below], level + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "below", "above", "size"])

    grown = samples.groupBy("tree").applyInPandas(grow, NODE)
    return settled(grown)


def compiled(feature, threshold, below, above, size) -> tuple:
    """A tree as (levels, feature, threshold, child, value): ``child`` holds the branches
    above and below of each node side by side, a leaf leads to itself, and ``value`` is the
    depth of a leaf plus the mean path of its points, so a walk needs no masks."""
    leaf, every = feature < 0, np.arange(len(feature))
    depth = np.zeros(len(feature))
    for node in every:  # children come after their parent
        if not leaf[node]:
            depth[[below[node], above[node]]] = depth[node] + 1
    child = np.column_stack([np.where(leaf, every, above), np.where(leaf, every, below)]).ravel().astype(np.intp)
    return int(depth.max()), np.where(leaf, 0, feature).astype(np.intp), threshold.astype(float), child, depth + average_path(size)


def raw_score(
    df: DataFrame, trees: DataFrame, columns: Sequence[str] = tuple(ANOMALY_FEATURES),
    name: str = "anomaly_raw",
) -> DataFrame:
    """Add 2^(-mean depth / expected depth): near 1 for rows that are isolated early.

    The forest is bounded by trees * (2 * sample - 1) nodes, so it travels with the task.
    """
    names = [c for c in columns if c in df.columns]
    table = trees.orderBy("tree", "node").toPandas()
    packed = [
        tuple(part[c].to_numpy() for c in ("feature", "threshold", "below", "above", "size")) for _, part in table.groupby("tree")
    ]
    expected = float(average_path(max(int(p[4][0]) for p in packed)))
    compact = [compiled(*p) for p in packed]

    def walk(points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        flat, row = np.ascontiguousarray(points).ravel(), np.arange(len(points)) * points.shape[1]
        for levels, feature, threshold, child, value in compact:
            at = np.zeros(len(points), dtype=np.intp)
            for _ in range(levels):
                left = flat.take(row + feature.take(at)) <= threshold.take(at)
                at = child.take(2 * at + left)
            total += value.take(at)
        return np.power(2.0, -(total / len(packed)) / max(expected, 1e-12))

    @F.pandas_udf("double")
    def score(values: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for given in values:
            columns_in = (given,) if isinstance(given, pd.Series) else given  # one column comes bare
            points = np.column_stack([c.fillna(0.0).to_numpy(float) for c in columns_in])
            yield pd.Series(walk(points))

    return df.withColumn(name, score(*[F.col(c).cast("double") for c in names]))


def score_bounds(scored: DataFrame, name: str = "anomaly_raw") -> tuple[float, float]:
    row = scored.agg(F.min(name), F.max(name)).first()
    return float(row[0]), float(row[1])


def forest_score(
    df: DataFrame, trees: DataFrame, bounds: tuple[float, float] | None = None,
    columns: Sequence[str] = tuple(ANOMALY_FEATURES), name: str = "behavior_anomaly_score",
) -> DataFrame:
    """Score rescaled to [0, 1] by the extremes of the scored table.

    Pass the ``bounds`` of the batch run to score a stream on the same scale. Without them
    the raw scores are settled once, so the walk is not repeated to find the extremes.
    """
    raw = raw_score(df, trees, columns, "_raw")
    if bounds is None:
        raw = settled(raw)
        bounds = score_bounds(raw, "_raw")
    lo, hi = bounds
    if hi > lo:
        scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_raw") - lo) / F.lit(hi - lo)))
    else:
        scaled = F.lit(0.0)
    return raw.withColumn(name, scaled).drop("_raw")


def save(trees: DataFrame, bounds: tuple[float, float], path: str) -> None:
    """Write the trees and the bounds of their scores, both of which later scoring needs."""
    trees.write.mode("overwrite").parquet(f"{path}/trees")
    row = trees.sparkSession.createDataFrame([bounds], "low double, high double")
    row.write.mode("overwrite").parquet(f"{path}/bounds")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[float, float]]:
    return spark.read.parquet(f"{path}/trees"), tuple(spark.read.parquet(f"{path}/bounds").first())


def separation(scored: DataFrame, score: str = "behavior_anomaly_score", label: str = "is_fraud") -> DataFrame:
    """Mean score of positives and negatives."""
    return scored.groupBy(F.col(label).cast("boolean").alias("is_fraud")).agg(
        F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("row_count")
    )
