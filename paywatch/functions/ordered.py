"""Global order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paywatch.runtime import settled


def running_totals(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str]
) -> DataFrame:
    """Add, per ``name -> column``, the total of ``column`` over all rows up to this one.

    Rows are range-partitioned and written once with their partition number (sampling
    picks other boundaries on each run, so the split must be kept). The offsets hold one
    row per partition, which bounds both the offset window and the broadcast.
    """
    ranged = settled(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
    )
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *[F.sum(f"_sum_{n}").over(earlier).alias(f"_off_{n}") for n in sums]
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()])
    joined = local.join(F.broadcast(offsets), "_part")
    cumulated = [
        (F.col(f"_in_{n}") + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(n) for n in sums
    ]
    return joined.select(*df.columns, *cumulated)


def with_ordinal(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Dense row number from 0 in the given order.

    Rows are numbered within their range while it is written; only the offsets, one row per
    range, are added afterwards, so there is one shuffle.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = settled(sorted_rows.withColumns({
        "_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    }), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_row")).alias(name))


def write_sorted(df: DataFrame, path: str, order: Sequence[str], tasks: int | None = None) -> None:
    """Write a table in the order of some columns, split into ranges (actions).

    Each range is a folder with its rows in order; ``bounds`` holds one row per range: its
    number of rows, the rows before it, and the least and greatest value of the first column.
    """
    ranged = df.repartitionByRange(*([tasks] if tasks else []), *order).withColumn("_range", F.spark_partition_id())
    # Led by the folder's column, the order is what the writer asks for, and it sorts nothing anew.
    placed = ranged.sortWithinPartitions("_range", *order).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    placed.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows") if not placed.isEmpty() else placed
    ends = rows.groupBy("_range").agg(
        F.count(F.lit(1)).alias("rows"), F.min(order[0]).alias("least"), F.max(order[0]).alias("greatest")
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ends = ends.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    ends.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def read_sorted(spark: SparkSession, path: str, column: str, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Rows of a sorted table with low <= column < high, and their ``position`` in the whole
    order, from 0. Only the ranges that can hold such rows are read (action: reads the bounds).
    """
    bounds = spark.read.parquet(f"{path}/bounds")
    touched = bounds
    if low is not None:
        touched = touched.filter(F.col("greatest") >= low)
    if high is not None:
        touched = touched.filter(F.col("least") < high)
    # Without a bound rows without a value count too; they stand first.
    ranges = [r["_range"] for r in (touched if low is not None or high is not None else bounds).select("_range").collect()]
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("_range").isin(ranges))
    if low is not None:
        rows = rows.filter(F.col(column) >= low)
    if high is not None:
        rows = rows.filter(F.col(column) < high)
    joined = rows.join(F.broadcast(bounds.select("_range", "before")), "_range")
    return joined.withColumn("position", F.col("before") + F.col("_row")).drop("_range", "_row", "before")
