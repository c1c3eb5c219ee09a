"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its distinct word shingles (words are split at ASCII
white space, A-Z in lower case; a text with fewer words is one shingle). Documents whose
sets have a Jaccard similarity of at least ``percent`` are linked; classes are the
connected parts of those links.

1. Sketch (Dahlgaard, Knudsen, Thorup 2017). In round i of the first t rounds, every
   element is placed in a bin by the i-th hash, with the value i plus a fraction. In
   round t + j all elements are placed in bin j. A bin keeps its least value, and rounds
   stop once all bins are filled, which the second half guarantees. Coordinates agree with
   the probability of the similarity, concentrated like independent ones, for about
   n + t ln t placements instead of n t.
2. Classes. Documents with equal sets are one class, by a partial aggregate.
3. Bands. ROWS coordinates form a band, documents with an equal band a crowd. A pair at
   the similarity bound meets in none of BANDS bands with probability 2e-5.
4. Stars. The smallest member of a crowd is compared with each other member on the full
   sets. What is linked is merged.
5. Crossings. Crowds whose other members still lie in several parts are compared across
   these parts, the largest part against the rest and the rest among themselves, in
   blocks of at most BLOCK_ROWS documents. Each pair of parts that meets in a crowd is
   either linked or proven apart pair by pair, so no link is lost and pairs inside a part
   are never formed, let alone written: tasks return links between parts only.

Sets are computed again from the text for documents in crowds, which is cheaper than
writing the sets of all. Nothing is gathered on the driver.

Cases: a null or empty text, or one without words, has an empty set and no link. Rows of
one id are one document: with different texts, the one with the smallest set hash counts.
Rows without an id get no class: component null, kept true. Extra columns are not read, or
kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywatch.llm.common import in_cells_of, map_rows, texts
from paywatch.runtime import settled

BANDS, ROWS = 27, 5
SHINGLE, PERCENT = 5, 80
BLOCK_ROWS, BLOCK_SHINGLES, SHARE_ROWS = 1_000, 1_000_000, 5_000
CACHED_WORDS = 500_000
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, size: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    width = min(size, len(parts))
    n = len(parts) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed(out * A + hashed[k : k + n])
    return np.unique(out)


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Least placement of every bin: round in the upper bits, hash in the lower ones."""
    bins = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    empty, at = bins[0], 0
    step = max(1, int(size * (np.log(size) + 2) / len(elements)) + 1)
    while at < 2 * size and (at == 0 or (bins == empty).any()):
        # Some rounds at once; later rounds never undercut a filled bin.
        step = min(step, max(1, 4_000_000 // len(elements)))
        rounds = np.arange(at, min(at + step, 2 * size), dtype=np.uint64)
        hashes = mixed(elements[:, None] ^ mixed((rounds + np.uint64(1)) * A)[None, :])
        place = np.where(rounds < size, (hashes >> np.uint64(32)) % np.uint64(size), rounds - np.uint64(size))
        value = (rounds << np.uint64(48)) | ((hashes * B) >> np.uint64(16))
        np.minimum.at(bins, place.ravel().astype(np.int64), value.ravel())
        at += step
    return bins


def band_keys(bins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        keys = mixed(keys * A + bins[k::rows][:bands])
    return keys.view(np.int64)


def sketched(docs: DataFrame, size: int, bands: int, rows: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: size of the set, its 128-bit hash and the keys of its bands."""

    def make():
        words = Words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, first, second, keys = [], [], [], []
            for t in texts(batch.column(1)):
                elements = shingles(t, size, words)
                digest = np.frombuffer(xxhash.xxh3_128_digest(elements.tobytes()), np.int64)
                n.append(len(elements))
                first.append(int(digest[0]))
                second.append(int(digest[1]))
                keys.append(band_keys(sketch(elements, bands * rows), bands, rows) if len(elements) else [])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n", "h1", "h2", "bands"],
            )

        return step

    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, n long, h1 long, h2 long, bands array<long>"
    return map_rows(docs, [key, text], schema, make)


def _sets(docs: DataFrame, wanted: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(v, n, items) of the wanted documents (v, h1), computed again from their texts."""

    def make():
        words = Words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep, n, items = [], [], []
            for k, (t, h) in enumerate(zip(texts(batch.column(1)), batch.column(2).to_pylist())):
                elements = shingles(t, size, words)
                if int(np.frombuffer(xxhash.xxh3_128_digest(elements.tobytes()), np.int64)[0]) == h:
                    keep.append(k)
                    n.append(len(elements))
                    items.append(elements.view(np.int64))
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int32())), pa.array(n, pa.int64()), pa.array(items, pa.list_(pa.int64()))],
                names=["v", "n", "items"],
            )

        return step

    rows = docs.select(F.col(key).alias("v"), F.col(text).alias("text"))
    rows = in_cells_of(rows, F.col("v"), wanted, "v").join(wanted, "v")
    return map_rows(rows, ["v", "text", "h1"], f"v {docs.schema[key].dataType.simpleString()}, n long, items array<long>", make)


class Side:
    """The left documents of a unit, as an index from element to documents."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.v = [r[0] for r in rows]
        self.part = np.array([r[1] for r in rows])
        sets = [r[2] for r in rows]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        everything = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(everything, kind="stable")
        self.owner = owner[order]
        self.items, self.first = np.unique(everything[order], return_index=True)
        self.after = np.append(self.first[1:], len(everything))

    def linked(self, elements: np.ndarray, percent: int) -> np.ndarray:
        """Positions of the documents similar enough to this set."""
        at = np.searchsorted(self.items, elements)
        at[at == len(self.items)] = 0
        at = at[self.items[at] == elements]
        counts = self.after[at] - self.first[at]
        if not counts.sum():
            return np.zeros(0, np.int64)
        spots = np.repeat(self.first[at] - np.concatenate([[0], counts.cumsum()[:-1]]), counts) + np.arange(counts.sum())
        common = np.bincount(self.owner[spots], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (self.sizes + len(elements) - common))


def verified(rows: DataFrame, percent: int) -> DataFrame:
    """Links between parts. A unit (g1, g2, g3) compares its left rows (role 0) with its
    right ones (role 1), and with each other if g2 = g3. Left rows are held, right rows
    stream by. One link per pair of parts and unit is returned."""
    kind = rows.schema["v"].dataType.simpleString()
    names = ["part_a", "part_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, left, side, told = None, [], None, set()
        out: list[tuple[int, int]] = []

        def meet(part: int, elements: np.ndarray, before: int | None = None) -> None:
            for k in side.linked(elements, percent):
                other = int(side.part[k])
                if (before is None or k < before) and other != part and (pair := (min(part, other), max(part, other))) not in told:
                    told.add(pair)
                    out.append(pair)

        def finish() -> None:
            nonlocal side
            if len(left) > 1 and unit[1] == unit[2]:
                side = side or Side(left)
                for k, (_, part, elements) in enumerate(left):
                    meet(part, elements, k)

        for batch in batches:
            g1, g2, g3, role, v, part = (batch.column(i).to_pylist() for i in range(6))
            lists = batch.column(6)
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k in range(batch.num_rows):
                if (g1[k], g2[k], g3[k]) != unit:
                    if unit is not None:
                        finish()
                    unit, left, side, told = (g1[k], g2[k], g3[k]), [], None, set()
                elements = values[bounds[k] : bounds[k + 1]]
                if role[k] == 0:
                    left.append((v[k], part[k], elements.copy()))
                elif left:
                    side = side or Side(left)
                    meet(part[k], elements)
            if out:
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*out))})
                out.clear()
        if unit is not None:
            finish()
        if out:
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*out))})

    units = rows.select("g1", "g2", "g3", "role", "v", "part", "items").repartition("g1", "g2", "g3")
    return units.sortWithinPartitions("g1", "g2", "g3", "role").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def components(links: DataFrame) -> DataFrame:
    """(v, component) for every end of a link: the smallest id that can be reached.

    Labels take the least label among neighbours, then the label of their label; rounds end
    when no link joins two labels. Every round's labels are a written table.
    """
    both = settled(links.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).unionAll(links.select("part_b", "part_a")).distinct(), "ends")
    labels = settled(both.groupBy("a").agg(F.min("b").alias("c")).select(F.col("a").alias("v"), F.least("a", "c").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("component").alias("c"))
        joined = labels.join(near.withColumnRenamed("a", "v"), "v")
        lower = settled(joined.select("v", F.least("component", "c").alias("component")), "lower")
        jump = lower.select(F.col("v").alias("component"), F.col("component").alias("c"))
        labels = settled(lower.join(jump, "component").select("v", F.col("c").alias("component")), "labels")
        x, y = (labels.select(F.col("v").alias(n), F.col("component").alias(f"_{n}")) for n in ("a", "b"))
        if both.join(x, "a").join(y, "b").filter("_a <> _b").isEmpty():
            return labels


def similar_size(a: str | Column, b: str | Column, percent: int) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """Per id: size of its set, its class and whether it is the one that stays (actions)."""
    raw = settled(sketched(docs, size, bands, rows, text, key), "sketches")
    known = raw.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct("n", "h1", "h2", "bands"), F.struct("h1", "h2")).alias("s"))
    known = settled(known.select("doc_id", "s.*"), "sets")
    classes = settled(
        known.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("v"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")),
        "classes",
    )

    # Crowds, each with its leader; crowds with the same members are one.
    banded = classes.select("v", "n", F.explode("bands").alias("band"))
    crowded = settled(banded.groupBy("band").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1"), "crowded")
    met = settled(in_cells_of(banded, F.col("band"), crowded, "band").join(crowded, "band"), "met")
    crowds = met.groupBy("band", "crowd").agg(
        F.min(F.struct("v", "n")).alias("lead"), F.bit_xor(F.xxhash64("v")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "v")).alias("s2"),
    )
    crowds = settled(crowds.groupBy("crowd", "lead", "s1", "s2").agg(F.min("band").alias("band")), "crowds")
    members = settled(
        met.join(crowds.select("band", F.col("lead.v").alias("leader"), F.col("lead.n").alias("leader_n")), "band").filter("v <> leader"),
        "members",
    )

    pairs = settled(members.filter(similar_size("n", "leader_n", percent)).select("leader", "v").distinct(), "pairs")
    shares = settled(pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / SHARE_ROWS).cast("int").alias("shares")), "shares")
    several = members.filter("crowd > 2").select("v")
    wanted = pairs.select("v").unionAll(shares.select("leader")).unionAll(several).distinct()
    wanted = settled(classes.select("v", "h1").join(wanted, "v", "left_semi"), "wanted")
    sets = settled(_sets(docs, wanted, size, text, key), "items")

    # Stars: each leader against its followers, which stream by.
    lead = shares.select(F.col("leader").alias("g1"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("g2"), F.lit(0).alias("role"), F.col("leader").alias("v"))
    follow = pairs.join(shares, "leader").select(
        F.col("leader").alias("g1"), F.pmod(F.xxhash64("v"), F.col("shares")).cast("int").alias("g2"), F.lit(1).alias("role"), "v",
    )
    star = lead.unionByName(follow).withColumns({"g3": F.lit(-1), "part": F.col("v")}).join(sets.select("v", "items"), "v")
    links = settled(verified(star, percent), "links")
    parts = components(links)

    # Crossings: what is still apart in a crowd, the leader left out.
    rest = settled(
        members.filter("crowd > 2").select("band", "v", "n").join(parts, "v", "left")
        .select("band", "v", "n", F.coalesce("component", "v").alias("part")),
        "rest",
    )
    per_part = rest.groupBy("band", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    split = per_part.groupBy("band").agg(
        F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "w", "part")).alias("most"), F.sum("c").alias("c"), F.sum("w").alias("w"),
    ).filter("parts > 1")
    others, heavy = F.col("c") - F.col("most.c"), F.col("w") - F.col("most.w")
    split = settled(split.select(
        "band", F.col("most.part").alias("largest"),
        F.greatest(F.ceil(others / BLOCK_ROWS), F.ceil(heavy / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.ceil(F.col("most.c") / SHARE_ROWS).cast("int").alias("shares"),
    ), "split")
    unit = "struct<g2:int,g3:int,role:int>"
    cell = lambda a, b, role: F.struct(a.cast("int").alias("g2"), b.cast("int").alias("g3"), F.lit(role).alias("role")).cast(unit)
    block, share = F.pmod(F.xxhash64("v"), F.col("blocks")), F.pmod(F.xxhash64("v"), F.col("shares"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of_other = F.concat(
        F.transform(upto("blocks"), lambda j: F.when(j >= block, cell(block, j, 0)).otherwise(cell(j, block, 1))),
        F.transform(upto("shares"), lambda k: cell(block, F.col("blocks") + k, 0)),
    )
    of_largest = F.transform(upto("blocks"), lambda i: cell(i, F.col("blocks") + share, 1))
    placed = rest.join(split, "band").select(
        F.col("band").alias("g1"), "v", "part",
        F.explode(F.when(F.col("part") == F.col("largest"), of_largest).otherwise(of_other)).alias("u"),
    )
    crossing = placed.select("g1", "u.*", "v", "part").join(sets.select("v", "items"), "v")
    more = settled(verified(crossing, percent), "more_links")
    joined = components(more).select(F.col("v").alias("component"), F.col("component").alias("_whole"))

    whole = parts.join(joined, "component", "full").select(
        F.coalesce("v", "component").alias("v"), F.coalesce("_whole", "component").alias("component"),
    )
    # A part that only crossings found has no row of its own in ``parts``.
    named = classes.select("h1", "h2", "v").join(settled(whole, "whole"), "v", "left").select("h1", "h2", F.coalesce("component", "v").alias("component"))
    labelled = known.join(settled(named, "named"), ["h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
    )
    unnamed = raw.filter("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return labelled.unionByName(unnamed).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_per_class(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns."""
    dropped = settled(near_duplicates(docs, size, percent, text=text, key=key).filter("NOT kept").select(F.col("doc_id").alias("__id")), "dropped")
    return docs.join(dropped, docs[key] == dropped["__id"], "left_anti")
