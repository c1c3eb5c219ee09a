"""Byte-balanced shards by Karmarkar-Karp differencing.

Documents with equal texts belong together (a group goes to one shard). Groups are hashed
into ``cells`` cells, whose sizes come from one aggregate with partial sums; the cells are
what is balanced, so what reaches the driver is bounded by ``cells`` however large the
input is, and with fewer groups than cells nearly every group is a cell of its own.

Differencing starts with one partition per cell, all its bytes in one of the parts. Again
and again the two partitions with the largest spread (largest part less smallest) are
combined, the larger parts of one with the smaller parts of the other, until one is left.
Its spread is the imbalance.

Slots number the rows of a shard without gaps: rows are numbered inside (input partition,
shard), and the counts of the earlier partitions are added. No task sees more of a shard
than one partition's share, however rows are distributed over keys.

Cases: a null text has no bytes and is grouped with the empty text. Repeated rows each
have their own slot; a null id is a row like any other. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paywatch.runtime import settled

SHARDS, CELLS = 24, 65_536
OVERHEAD = 8


def differenced(sizes: list[int], parts: int) -> list[list[int]]:
    """Members of each part, by position in ``sizes``."""
    # A partition: its sums from large to small, and per part the members as nested pairs.
    heap = [(-size, i, [size] + [0] * (parts - 1), [(i,)] + [None] * (parts - 1)) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a, a_in = heapq.heappop(heap)
        _, _, b, b_in = heapq.heappop(heap)
        both = sorted(
            (
                (x + y, i, m if n is None else n if m is None else (m, n))
                for i, (x, y, m, n) in enumerate(zip(a, reversed(b), a_in, reversed(b_in)))
            ),
            key=lambda part: (-part[0], part[1]),
        )
        sums = [p[0] for p in both]
        heapq.heappush(heap, (sums[-1] - sums[0], serial, sums, [p[2] for p in both]))
        serial += 1
    members: list[list[int]] = [[] for _ in range(parts)]
    for part, nested in enumerate(heap[0][3] if heap else []):
        stack = [nested] if nested is not None else []
        while stack:
            node = stack.pop()
            if len(node) == 1:
                members[part].append(node[0])
            else:
                stack += node
    return members


def cell_shards(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """(cell, shard), at most ``cells`` rows, of a table with columns _cell and size."""
    sums = docs.groupBy("_cell").agg(F.sum("size").alias("size")).orderBy("_cell").collect()
    parts = differenced([r["size"] for r in sums], shards)
    rows = [(sums[i]["_cell"], shard) for shard, members in enumerate(parts) for i in members]
    return docs.sparkSession.createDataFrame(rows, "_cell int, shard int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row its size, the crc32 of its text, shard and slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.sha2(body.cast("binary"), 256)), F.lit(cells)).cast("int").alias("_cell"),
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # Narrow rows, written once, so that partition and row numbers stay what they are.
    rows = settled(rows, "sized")
    placed = rows.join(F.broadcast(cell_shards(rows, shards, cells)), "_cell")  # at most ``cells`` rows
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    number = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_row"))
    return (
        placed.withColumn("_slot", number)
        .join(offsets, ["shard", "_part"])
        .select(
            "doc_id", "size", "text_crc32", "shard", (F.col("_slot") - 1 + F.col("_offset")).cast("long").alias("slot"),
        )
    )
