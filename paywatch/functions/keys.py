"""Key uniqueness, and joins that spread the rows of dominant keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single task may take on in a join.
SHARE_ROWS = 1_000_000


def unique_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``, by a partial aggregate instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    chosen = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*[F.col(k) if k in keys else F.col(f"_row.{k}") for k in df.columns])


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    measured: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Join facts to a lookup with one row per key, however unevenly the keys are filled.

    Adaptive execution splits skewed partitions only when both sides come straight from a
    shuffle, and a lookup made by an aggregate does not. So keys with more than SHARE_ROWS
    facts (the null key included) are cut into shares: their facts are dealt out by a hash,
    and only their lookup rows are repeated, once per share. The table of such keys has at
    most rows / SHARE_ROWS entries, which bounds its broadcast.

    ``rows`` is an upper bound for the facts; without it they are counted (action). Up to
    SHARE_ROWS facts it is a plain join. ``measured`` is a table with the same keys to
    count them on, when the facts themselves are expensive; a chain of joins names the
    table it starts from.
    """
    if rows is None:
        rows = (measured if measured is not None else facts).count()
    if rows <= SHARE_ROWS:
        joined = facts.join(lookup, list(keys), how)
    else:
        joined = _dealt(facts, lookup, keys, spread_by, how, measured if measured is not None else facts)
    added = [] if how in ("left_semi", "left_anti") else [c for c in lookup.columns if c not in keys]
    return joined.select(*facts.columns, *added)


def _dealt(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str,
    measured: DataFrame,
) -> DataFrame:
    names = [f"_key{i}" for i in range(len(keys))]
    crowded = F.broadcast(
        measured.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > SHARE_ROWS)
        .select(
            *[F.col(k).alias(n) for k, n in zip(keys, names)],
            F.ceil(F.col("_n") / SHARE_ROWS).cast("int").alias("_shares"),
        )
    )

    def marked(df: DataFrame) -> DataFrame:
        same = [df[k].eqNullSafe(crowded[n]) for k, n in zip(keys, names)]
        shares = F.coalesce(F.col("_shares"), F.lit(1))
        return df.join(crowded, same, "left").withColumn("_shares", shares).drop(*names)

    dealt = marked(facts).withColumn("_share", F.pmod(F.xxhash64(*spread_by), F.col("_shares")).cast("int"))
    repeated = marked(lookup).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    return dealt.drop("_shares").join(repeated.drop("_shares"), [*keys, "_share"], how)


def only(
    df: DataFrame, ids: DataFrame, key: str, spread_by: Sequence[str], rows: int | None = None
) -> DataFrame:
    """Rows of ``df`` whose key is among the ids."""
    return spread_join(df, ids.select(key).distinct(), [key], spread_by, "left_semi", rows=rows)
