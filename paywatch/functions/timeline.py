"""Time windows per key that stay balanced when one key holds most of the rows.

A plain ``RANGE`` window puts a whole key into one task and costs the frame length
per row. The helpers here work on *points*: a value enters a running total when its
window opens and leaves it when the window closes. Points are first collapsed to one
row per key and second, then summed inside (key, time block) groups, and the totals of
earlier blocks are carried in. No task ever sees more of a key than one block of
seconds, plus one row per block for the carry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywatch.schemas import DAY

# Money is summed exactly, to ten places, so that entering and leaving cancel.
MONEY = "decimal(28,10)"


def epoch(ts: str | Column = "timestamp") -> Column:
    """Whole-second epoch, fraction truncated."""
    return F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts)


def with_epoch(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumn("ts_epoch", epoch(ts))


def blocked_scan(
    points: DataFrame,
    keys: Sequence[str],
    pos: str,
    totals: Sequence[str] = (),
    latest: str | None = None,
    keep: Sequence[str] = (),
    block: int = DAY,
) -> DataFrame:
    """Running totals up to and including ``pos``, and the last value strictly before it.

    ``totals`` are summed over all points of the key at or before ``pos``; ``latest``
    gives ``previous``, the largest value found before ``pos`` (null when there is none).
    ``keep`` columns pass through.
    """
    group = [*keys, "_block"]
    wanted = dict.fromkeys([*keys, pos, *totals, *keep, *([latest] if latest else [])])
    # The join below must not infer null filters for one of its sides only, or the two
    # readers of ``base`` would no longer be the same plan and share one exchange.
    base = (
        points.select(*wanted)
        .filter(F.col(pos).isNotNull())
        .withColumn("_block", F.coalesce(F.floor(F.col(pos) / block), F.lit(0)))
        .repartition(*group)
    )
    ordered = Window.partitionBy(*group).orderBy(pos)
    upto = ordered.rangeBetween(Window.unboundedPreceding, 0)
    before = ordered.rangeBetween(Window.unboundedPreceding, -1)
    running = [F.sum(c).over(upto).alias(f"_in_{c}") for c in totals]
    if latest:
        running.append(F.max(latest).over(before).alias("_in_latest"))
    inside = base.select("*", *running)

    # One row per key and block. Touching every column lets both readers of ``base``
    # share a single exchange.
    sums = [F.sum(c).alias(f"_all_{c}") for c in totals]
    sums += [F.count(c).alias(f"_n_{c}") for c in keep]
    if latest:
        sums.append(F.max(latest).alias("_all_latest"))
    ends = base.groupBy(*group).agg(F.max(pos).alias("_end"), *sums)
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = [F.sum(f"_all_{c}").over(earlier).alias(f"_before_{c}") for c in totals]
    if latest:
        carried.append(F.max("_all_latest").over(earlier).alias("_before_latest"))
    carry = ends.select(*group, "_end", *[f"_n_{c}" for c in keep], *carried)

    same_block = [inside[k].eqNullSafe(carry[k]) for k in keys] + [inside["_block"] == carry["_block"]]
    sane = [inside[pos] <= carry["_end"]] + [carry[f"_n_{c}"] >= 0 for c in keep]
    out = [inside[c] for c in dict.fromkeys([*keys, pos, *keep])]
    for c in totals:
        zero = F.lit(0).cast(base.schema[c].dataType)
        out.append((F.col(f"_in_{c}") + F.coalesce(F.col(f"_before_{c}"), zero)).alias(c))
    if latest:
        out.append(F.coalesce("_in_latest", "_before_latest").alias("previous"))
    return inside.join(carry, same_block + sane).select(*out)


def previous_second(
    occurrences: DataFrame, keys: Sequence[str], sec: str, block: int = DAY
) -> DataFrame:
    """For distinct (keys, second) rows: the preceding second of the same key."""
    return blocked_scan(occurrences, keys, sec, latest=sec, block=block)


def next_second(
    events: DataFrame, probes: DataFrame, keys: Sequence[str], sec: str, block: int = DAY
) -> DataFrame:
    """For each probe (keys, second): ``following``, the first event second after it."""
    flipped = (-F.col(sec)).cast("bigint")
    none = F.lit(None).cast("bigint")
    rows = events.select(*keys, flipped.alias("pos"), flipped.alias("_event"), none.alias("_probe"))
    rows = rows.unionByName(
        probes.select(*keys, flipped.alias("pos"), none.alias("_event"), flipped.alias("_probe"))
    )
    scanned = blocked_scan(rows, keys, "pos", latest="_event", keep=["_probe"], block=block)
    return scanned.filter(F.col("_probe").isNotNull()).select(
        *keys, (-F.col("_probe")).alias(sec), (-F.col("previous")).alias("following")
    )


def window_points(
    events: DataFrame, keys: Sequence[str], sec: str, windows: dict[str, tuple[str, int, int]]
) -> DataFrame:
    """Points for ``name = sum(column) over seconds [probe + lo, probe + hi]``.

    ``events`` holds one row per (keys, second). An event at second s is inside the
    window of a probe at t exactly when s - hi <= t <= s - lo.
    """
    typed = events.select(*keys, sec, *[F.col(c).alias(n) for n, (c, _, _) in windows.items()])
    shifts: dict[int, dict[str, Column]] = {}
    for name, (_, lo, hi) in windows.items():
        shifts.setdefault(-hi, {})[name] = F.col(name)
        shifts.setdefault(1 - lo, {})[name] = -F.col(name)

    def point(shift: int, entering: dict[str, Column]) -> Column:
        values = [
            entering.get(n, F.lit(0)).cast(typed.schema[n].dataType).alias(n) for n in windows
        ]
        return F.struct((F.col(sec) + shift).cast("bigint").alias("pos"), *values)

    points = F.array(*[point(shift, entering) for shift, entering in shifts.items()])
    return typed.select(*keys, F.explode(points).alias("_p")).select(*keys, "_p.*")


def distinct_points(
    occurrences: DataFrame, keys: Sequence[str], sec: str, name: str, width: int
) -> DataFrame:
    """Points counting distinct values seen in the trailing ``width`` seconds.

    ``occurrences`` carries, per (keys, value, second), the ``previous`` second of that
    value. A value is counted from its second until ``width`` seconds later; where the
    previous occurrence still counts, the overlap is taken out again.
    """
    s, p = F.col(sec), F.col("previous")

    def point(at: Column, delta: int) -> Column:
        return F.struct(at.cast("bigint").alias("pos"), F.lit(delta).cast("bigint").alias("delta"))

    own = [point(s, 1), point(s + width + 1, -1)]
    overlap = [point(s, -1), point(p + width + 1, 1)]
    points = F.when(p >= s - width, F.array(*own, *overlap)).otherwise(F.array(*own))
    exploded = occurrences.select(*keys, F.explode(points).alias("_p"))
    return exploded.groupBy(*keys, F.col("_p.pos").alias("pos")).agg(
        F.sum("_p.delta").alias(name)
    )


def sweep(
    point_sets: Sequence[DataFrame],
    probes: DataFrame,
    keys: Sequence[str],
    sec: str,
    block: int = DAY,
    last: int | None = None,
) -> DataFrame:
    """Evaluate all point sets at the probes: one row per distinct (keys, second).

    ``previous`` is the second of the probe before. Each point set must hold a bounded
    number of points per (keys, position). Points after ``last``, the second of the last
    probe of all, are left out: no total is asked for there.
    """
    types: dict[str, str] = {}
    for points in point_sets:
        for field in points.schema:
            if field.name not in (*keys, "pos"):
                kind = field.dataType
                wide = isinstance(kind, T.DecimalType)
                types[field.name] = f"decimal(38,{kind.scale})" if wide else kind.simpleString()

    def aligned(df: DataFrame) -> DataFrame:
        values = [
            (F.col(c) if c in df.columns else F.lit(0)).cast(t).alias(c) for c, t in types.items()
        ]
        probe = F.col("_probe") if "_probe" in df.columns else F.lit(None)
        return df.select(*keys, "pos", *values, probe.cast("bigint").alias("_probe"))

    asked = probes.select(*keys, F.col(sec).cast("bigint").alias("pos")).distinct()
    rows = aligned(asked.withColumn("_probe", F.col("pos")))
    for points in point_sets:
        rows = rows.unionByName(aligned(points if last is None else points.filter(F.col("pos") <= last)))
    scanned = blocked_scan(rows, keys, "pos", list(types), latest="_probe", keep=["_probe"], block=block)
    return (
        scanned.filter(F.col("_probe").isNotNull()).drop("_probe").withColumnRenamed("pos", sec)
    )


def trailing_max(
    events: DataFrame, keys: Sequence[str], sec: str, value: str, width: int
) -> DataFrame:
    """Largest ``value`` in seconds [t - width, t - 1], for each (keys, second) row.

    With blocks as long as the window, the window is the tail of the block before
    (from t - width) plus the head of the own block (before t).
    """
    base = events.select(*keys, sec, value)
    block = F.floor(F.col(sec) / width)
    head_window = (
        Window.partitionBy(*keys, "_block").orderBy(sec).rowsBetween(Window.unboundedPreceding, -1)
    )
    head = base.withColumn("_block", block).select(
        *keys, sec, F.max(value).over(head_window).alias("_head")
    )
    data = base.select(*keys, F.col(sec).alias("_at"), F.col(value).alias("_value"),
                       F.lit(None).cast("bigint").alias("_probe"))
    asked = base.select(*keys, (F.col(sec) - width).alias("_at"),
                        F.lit(None).cast(base.schema[value].dataType).alias("_value"),
                        F.col(sec).cast("bigint").alias("_probe"))
    tail_window = (
        Window.partitionBy(*keys, "_block").orderBy(F.col("_at").desc())
        .rangeBetween(Window.unboundedPreceding, 0)
    )
    tail = (
        data.unionByName(asked)
        .withColumn("_block", F.floor(F.col("_at") / width))
        .select(*keys, F.col("_probe").alias(sec), F.max("_value").over(tail_window).alias("_tail"))
        .filter(F.col(sec).isNotNull())
    )
    return head.join(tail, [*keys, sec]).select(
        *keys, sec, F.greatest("_head", "_tail").alias(f"trailing_{value}")
    )
