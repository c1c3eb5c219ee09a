"""Exact duplicates by progressive refinement, in DataFrame operations only.

Texts are equal when they are identical without white space (space, tab, line feed,
vertical tab, form feed, carriage return). Rows are told apart by more and more costly keys:

1. Length. A pass counts the lengths of the normalised texts, with partial aggregates.
2. Prefix hash. Rows whose length occurs twice are counted by (length, hash of the first
   PREFIX characters).
3. Full hash. Rows whose (length, prefix hash) occurs twice get the SHA-256 of their whole
   content, and rows with equal (length, prefix hash, full hash) form the groups.

A stage knows the keys that occur twice by the cells they hash to, at most CELLS of them,
which bounds the broadcast whatever the data. A key that shares such a key's cell costs a
needless hash and nothing else.

Of a group the row with the most characters, then the smallest id, stays. All joins are on
narrow rows; groups of any size are reduced by partial aggregates, never collected.

Cases: a null text is an empty one. A null id comes after all others. Of repeated rows
(equal id and text) the first one stays and the others are dropped like other copies.
Extra columns are not read, or kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paywatch.llm.common import CELLS
from paywatch.runtime import settled

SPACES = " \t\n\x0b\x0c\r"
PREFIX = 64


def normalised(text: str | Column = "text") -> Column:
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, "")


def _cell(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(CELLS)).alias("_cell")


def _cells(known: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """The cells of some keys, at most CELLS rows."""
    return known.select(_cell(keys)).distinct().withColumn(flag, F.lit(True))


def _marked(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, with the cells' flag where the key may be a known one."""
    return rows.select("*", _cell(keys)).join(F.broadcast(cells), "_cell", "left").drop("_cell")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, the id that stays, the size of its group, and whether it stays itself.

    ``carry`` adds columns computed from the row in the last pass.
    """
    body = normalised(text)
    prefix = F.xxhash64(F.substring("_body", 1, PREFIX))
    by_length = docs.select(F.length(body).alias("_length")).groupBy("_length").agg(F.count(F.lit(1)).alias("_n"))
    lengths = _cells(settled(by_length.filter("_n > 1"), "lengths"), ["_length"], "_shared")

    sized = docs.select(F.length(body).alias("_length"), body.alias("_body"))
    by_prefix = (
        _marked(sized, lengths, ["_length"]).filter("_shared").select("_length", prefix.alias("_prefix"))
        .groupBy("_length", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    )
    prefixes = _cells(settled(by_prefix.filter("_n > 1"), "prefixes"), ["_length", "_prefix"], "_hit")

    whole = docs.select(
        F.col(key).alias("doc_id"), F.length(body).alias("_length"), body.alias("_body"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("_chars"),
        *[c.alias(n) for n, c in (carry or {}).items()],
    )
    hashed = _marked(whole, lengths, ["_length"]).withColumn("_prefix", F.when(F.col("_shared"), prefix))
    second = (
        _marked(hashed, prefixes, ["_length", "_prefix"])
        .withColumn("_full", F.when(F.col("_shared") & F.col("_hit"), F.sha2(F.col("_body").cast("binary"), 256)))
        .drop("_body", "_shared", "_hit")
        .withColumn("_row", F.monotonically_increasing_id())
    )
    rows = settled(second, "hashed")
    order = F.struct(-F.col("_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    groups = (
        rows.filter("_full IS NOT NULL")
        .groupBy("_length", "_prefix", "_full")
        .agg(F.count(F.lit(1)).alias("_size"), F.min(order).alias("_first"))
        .filter("_size > 1")
        .select("_length", "_prefix", "_full", "_size", F.col("_first.doc_id").alias("_keep"), F.col("_first._row").alias("_keep_row"))
    )
    # Both sides are read from written tables, so adaptive execution can split a group that
    # fills a partition.
    joined = rows.join(settled(groups, "groups"), ["_length", "_prefix", "_full"], "left")
    alone = F.col("_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_keep_row"))).alias("kept"),
        *(carry or {}),
    )


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns (actions)."""
    found = settled(exact_groups(docs, text, key).select(F.col("doc_id").alias("__id"), "kept"), "copies")
    dropped = settled(found.filter("NOT kept").select("__id").distinct(), "dropped")
    clean = docs.join(dropped, docs[key].eqNullSafe(dropped["__id"]), "left_anti")
    # A repeated id can be dropped in one row and stay in another.
    kept = found.filter("kept").alias("a")
    mixed = settled(kept.join(dropped.alias("b"), F.expr("a.__id <=> b.__id"), "left_semi").select("__id").distinct(), "mixed")
    if mixed.isEmpty():
        return clean
    # One copy of each row that stays comes back; such rows are told apart by their content.
    digest = F.sha2(normalised(text).cast("binary"), 256)
    again = exact_groups(docs, text, key, {"__digest": digest}).filter("kept").select(F.col("doc_id").alias("__id"), "__digest").alias("a")
    again = settled(again.join(mixed.alias("b"), F.expr("a.__id <=> b.__id"), "left_semi"), "repeated")
    own = docs.withColumn("__own", digest)
    order = Window.partitionBy(key, "__own").orderBy(F.desc(F.length(text)))
    back = (
        own.join(again, own[key].eqNullSafe(again["__id"]) & (own["__own"] == again["__digest"]), "left_semi")
        .withColumn("__place", F.row_number().over(order))
        .filter("__place = 1")
        .select(docs.columns)
    )
    return clean.unionByName(back)
