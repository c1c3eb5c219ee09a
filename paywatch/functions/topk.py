"""Best rows per group, also when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread_by: Sequence[str],
    spread: int = 64,
    rank: str | None = None,
) -> DataFrame:
    """First ``k`` rows of each group in ``order``.

    Each group is first cut to ``k`` rows in ``spread`` random shares, so the final
    ranking of a group sees at most ``k * spread`` rows.
    """
    name = rank or "_rank"
    share = F.pmod(F.xxhash64(*spread_by), F.lit(spread))
    in_share = Window.partitionBy(*group, "_share").orderBy(*order)
    in_group = Window.partitionBy(*group).orderBy(*order)
    cut = (
        df.withColumn("_share", share)
        .withColumn(name, F.row_number().over(in_share))
        .filter(F.col(name) <= k)
        .drop("_share", name)
    )
    best = cut.withColumn(name, F.row_number().over(in_group)).filter(F.col(name) <= k)
    return best if rank else best.drop(name)


def top_n(
    df: DataFrame, order: Sequence[Column], n: int, spread_by: Sequence[str], spread: int = 64
) -> DataFrame:
    """First ``n`` rows of the whole table.

    A plain ordered limit sends ``n`` rows of every partition to one task; here shares of
    the table are cut to ``n`` rows first.
    """
    share = F.pmod(F.xxhash64(*spread_by), F.lit(spread))
    in_share = Window.partitionBy("_share").orderBy(*order)
    cut = df.withColumn("_share", share).withColumn("_rank", F.row_number().over(in_share))
    return cut.filter(F.col("_rank") <= n).drop("_share", "_rank").orderBy(*order).limit(n)
