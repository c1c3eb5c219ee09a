"""Repeatable random samples of a fixed size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded(key: Column, seed: int) -> Column:
    """Hex digits that place a key at random but the same way in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest MD5 of seed and key (action: counts the rows).

    A threshold far enough above the expected n-th hash keeps only slightly more than
    ``n`` rows before they are ordered, so no task sees ``n`` rows from every partition.
    Repeated keys can leave fewer below it; then all rows are ordered.
    """
    place = seeded(F.col(key), seed)
    rows = df.count()
    wanted = n + 10 * math.sqrt(n) + 100
    if rows > 2 * wanted:
        low = df.filter(place < F.lit(format(int(16**16 * (wanted / rows)), "016x")))
        if low.count() >= n:
            df = low
    return df.orderBy(place, key).limit(n)
