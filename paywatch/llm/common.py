"""Helpers shared by the operators: tables, row sampling, arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> list[str]:
    """Texts of a column as strings; null is the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def map_rows(
    df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
) -> DataFrame:
    """Run a batch function over some columns. ``make`` builds it once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            # A batch can hold many long texts; a slice bounds what is in memory twice.
            for at in range(0, batch.num_rows, SLICE):
                yield step(batch.slice(at, SLICE))

    bounded_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """Rows whose text passes; all columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in batches:
            at = batch.schema.names.index(column)
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield part.filter(pa.array(passes(texts(part.column(at))), pa.bool_()))

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


# Rows handled at once inside a Python task, and rows sent to it at once: long texts make
# either many bytes.
SLICE, BATCH = 500, 2_000


def bounded_batches(spark: SparkSession) -> None:
    """Send fewer rows at once to Python than the default, unless the session asks for less."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from: crc32 of the id's digits divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, target: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids outside the held-out fold, chosen by a hash of the id.

    The bound is what makes the table safe to broadcast. An id with several labels counts
    by its largest one; null labels are left out.
    """
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("_y"))
    return one.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)


CELLS = 1 << 20


def in_cells_of(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """Rows whose key may be among ``keys.name``: a filter that spares them a shuffle.

    Keys are known by the cell they hash to. There are at most CELLS cells, which bounds
    the broadcast whatever the data; when they are all in use, the filter passes every
    row and the exact join that follows does the work.
    """
    cells = keys.select(F.pmod(F.xxhash64(name), F.lit(CELLS)).alias("__cell")).distinct()
    marked = rows.withColumn("__cell", F.pmod(F.xxhash64(key), F.lit(CELLS)))
    return marked.join(F.broadcast(cells), "__cell", "left_semi").drop("__cell")
