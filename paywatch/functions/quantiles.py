"""Exact quantiles with linear interpolation, without holding all values in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywatch.functions.ordered import running_totals

# Up to this many values the built-in exact percentile fits comfortably in one task.
SMALL = 1_000_000
# The approximate percentile misses a rank by at most n / ACCURACY, so a bracket twice as wide
# on either side is certain to hold a wanted rank of a large column.
ACCURACY = 10_000
MARGIN = 2.0 / ACCURACY


class Spread(NamedTuple):
    """Number of values, the least and the largest one, and the quantiles asked for."""

    n: int
    low: float
    high: float
    at: list[float]


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], small: int = SMALL
) -> list[float] | None:
    """Quantiles at ``probs`` (action). Null and NaN values are ignored; None when empty."""
    found = column_quantiles(df, [value], probs, small)[value]
    return found and found.at


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], small: int = SMALL
) -> dict[str, Spread | None]:
    """Quantiles of many columns at once, in at most four jobs however many columns there are.

    The first pass counts, and brackets every wanted rank by approximate percentiles. Columns
    of up to ``small`` values get the built-in exact percentile, all in one pass. For the
    others a second pass counts values: those inside a bracket one by one (equal ones
    together), all between two brackets as a whole. Running totals over (column, value) then
    hold the wanted ranks.
    """
    if not columns:
        return {}
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    values = df.select(*[v.alias(f"v{i}") for i, v in enumerate(clean.values())])
    lows, highs = ([min(1.0, max(0.0, p + m)) for p in probs] for m in (-MARGIN, MARGIN))
    bounds = F.array(*map(F.lit, lows + highs))
    told = values.agg(*[
        a for i in range(len(columns)) for a in (
            F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"),
            F.percentile_approx(f"v{i}", bounds, ACCURACY).alias(f"e{i}"),
        )
    ]).first()
    sizes = [told[f"n{i}"] for i in range(len(columns))]
    found: dict[int, list[float]] = {}
    small = max(small, 2 * ACCURACY)  # in fewer values the rounding of a rank is wider than a bracket
    few = [i for i, n in enumerate(sizes) if 0 < n <= small]
    if few:
        exact = F.array(*map(F.lit, map(float, probs)))
        row = values.agg(*[F.percentile(f"v{i}", exact).alias(f"q{i}") for i in few]).first()
        found |= {i: list(row[f"q{i}"]) for i in few}
    many = [i for i, n in enumerate(sizes) if n > small]
    if many:
        spans = {}
        for i in many:
            edges = told[f"e{i}"]
            low = [told[f"lo{i}"] if p == 0.0 else e for p, e in zip(lows, edges)]
            high = [told[f"hi{i}"] if p == 1.0 else e for p, e in zip(highs, edges[len(probs):])]
            spans[i] = _merged(sorted(zip(low, high)))
        found |= _ranked(values, spans, {i: sizes[i] for i in many}, probs)
    return {
        c: Spread(sizes[i], told[f"lo{i}"], told[f"hi{i}"], found[i]) if sizes[i] else None for i, c in enumerate(columns)
    }


def _ranked(
    values: DataFrame, spans: dict[int, list[tuple[float, float]]], sizes: dict[int, int], probs: Sequence[float],
) -> dict[int, list[float]]:
    """Quantiles of large columns. Bracket k of a column is slot 2k + 1, the gap before it slot 2k."""

    def placed(i: int) -> Column:
        v, slot = F.col(f"v{i}"), F.lit(2 * len(spans[i]))
        for k, (a, b) in reversed(list(enumerate(spans[i]))):
            slot = F.when(v < a, 2 * k).when(v <= b, 2 * k + 1).otherwise(slot)
        return F.struct(F.lit(i).alias("column"), F.when(v.isNotNull(), slot).alias("slot"), F.when(slot % 2 == 1, v).alias("v"))

    counted = (
        values.select(F.explode(F.array(*[placed(i) for i in spans])).alias("p")).select("p.*").filter("slot IS NOT NULL")
        .groupBy("column", "slot", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_totals(counted, [F.col("column"), F.col("slot"), F.col("v")], {"upto": "n"})
    picks, before = [], 0
    for i, n in sizes.items():
        for r in sorted({r for p in probs for r in _around(p, n)}):
            last = F.col("upto") - before - 1
            hit = (F.col("column") == i) & (last - F.col("n") + 1 <= r) & (last >= r)
            picks.append(F.min(F.when(hit, F.col("v"))).alias(f"c{i}r{r}"))
        before += n
    row = ranked.agg(*picks).first()
    out = {}
    for i, n in sizes.items():
        ends = [(row[f"c{i}r{lo}"], row[f"c{i}r{hi}"], (n - 1) * p - lo) for p in probs for lo, hi in [_around(p, n)]]
        out[i] = [a + (b - a) * part for a, b, part in ends]
    return out


def _around(p: float, n: int) -> tuple[int, int]:
    at = (n - 1) * p
    return math.floor(at), math.ceil(at)


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    merged: list[tuple[float, float]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged
