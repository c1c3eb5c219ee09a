"""Hard negatives by bounds along spanning trees of the anchors.

Vectors are integers: floor(SCALE * x) of each component. The score of a row for an anchor
is their inner product, exact. An anchor's positives are its best rows of the same label,
its negatives for a positive the best rows of other labels whose score lies between LOW and
HIGH percent of the positive's score.

Anchors are put into blocks of up to BLOCK near ones, and each block is joined by a minimum
spanning tree of the distances between them. All rows are scored for the root. From a parent
with score s (or bounds) to a child at distance d the score of a row c moves by at most
d * |c|, by Cauchy and Schwarz, so the child has bounds without looking at the vectors. Only
rows whose bounds overlap what is still wanted (scores not below the k-th best so far, inside
the window of the positives) are scored again. Where most rows overlap, the whole level is
scored by one matrix product.

The work is a grid of chunks of rows and groups of anchor blocks, each bounded (CHUNK rows,
GROUP blocks), which Spark deals out by key; each cell returns at most k rows an anchor and
positive. Nothing is collected. Work is anchors times rows, less what the bounds spare; no
row is left out.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part.
Of repeated rows of one id the one with the smallest label, then vector, stands for all. A
shorter vector counts as filled up with zeros. Components beyond the range of long are held
at its ends, scores beyond it as well (the order is by exact scores). An anchor without
positives, or a positive without negatives, has no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywatch.functions.topk import top_k
from paywatch.llm.common import bounded_batches
from paywatch.runtime import settled

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
BLOCK, GROUP, CHUNK, SLAB, LEAST_CHUNK = 512, 64, 1 << 16, 1 << 13, 1 << 12
DENSE = 0.25
EXACT = float(1 << 53)

TREE = "block long, seat int, anchor_id long, label long, vector array<long>, parent int, edge double"
FOUND = "anchor_id long, anchor_label long, vec_id long, score decimal(38,0)"
MINED = "anchor_id long, positive_id long, positive_score decimal(38,0), negative_id long, negative_score decimal(38,0)"


def relabelled(rows: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """Every seventh row gets the next label: the mislabelled rows the search is tried on."""
    moved = F.pmod(F.col(key), F.lit(7)) == 0
    return rows.withColumn(label, F.when(moved, (F.col(label) + 1) % 10).otherwise(F.col(label)))


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, one per id."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    some = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(finite)
    one = some.select(F.col(key).cast("long").alias("vec_id"), F.struct(F.col(label).cast("long").alias("label"), whole.alias("vector")).alias("r"))
    return one.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.vector")


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(int(sizes.max(initial=0)), width or 0)), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree: the order in which anchors join, each one's parent in that order, and its edge."""
    points = vectors.astype(np.float64)
    near = np.full(len(points), np.inf)
    parent, order, edge = np.zeros(len(points), np.int32), [], []
    out = np.ones(len(points), bool)
    nearest = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    seat = np.zeros(len(points), np.int32)
    for k in range(len(points)):
        seat[nearest] = k
        out[nearest] = False
        order.append(nearest)
        edge.append(near[nearest])
        far = np.sqrt(((points - points[nearest]) ** 2).sum(1))
        closer = out & (far < near)
        near[closer], parent[closer] = far[closer], nearest
        nearest = int(np.argmin(np.where(out, near, np.inf)))
        if out.any() and not out[nearest]:  # all remaining distances overflow
            nearest = int(np.flatnonzero(out)[0])
    edge[0] = 0.0
    order = np.array(order)
    return order, np.where(np.arange(len(order)) == 0, -1, seat[parent[order]]).astype(np.int32), np.array(edge)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []

    def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal block
        order, parent, edge = spanning_tree(matrix(table.column("vector")))
        rows = table.take(pa.array(order))
        size = len(order)
        yield from pa.table({
            "block": pa.array(np.full(size, block), pa.int64()), "seat": pa.array(np.arange(size), pa.int32()),
            "anchor_id": rows.column("vec_id"), "label": rows.column("label"), "vector": rows.column("vector"),
            "parent": pa.array(parent, pa.int32()), "edge": pa.array(edge, pa.float64()),
        }).combine_chunks().to_batches()
        block += 1

    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= BLOCK:
            table = pa.Table.from_batches(held)
            yield from close(table.slice(0, BLOCK))
            held = table.slice(BLOCK).to_batches()
    if held:
        yield from close(pa.Table.from_batches(held))


class Block:
    """Anchors of one tree, in the order they joined it."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by("seat")
        self.ids = table.column("anchor_id").to_numpy()
        self.labels = table.column("label").to_numpy()
        self.vectors = matrix(table.column("vector"), width)
        self.parent, self.edge = table.column("parent").to_numpy(), table.column("edge").to_numpy()
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))
        depth = np.zeros(len(self.ids), np.int32)
        for k in range(1, len(depth)):
            depth[k] = depth[self.parent[k]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]

    def walk(
        self, rows: np.ndarray, norms: np.ndarray,
        ask: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], take: Callable[[np.ndarray, np.ndarray, np.ndarray], None],
    ) -> None:
        """Bounds of all rows from the root to the leaves; ``ask`` says which to score again.

        ``ask`` and ``take`` get the anchors of a level; ``take`` gets what was asked and scores.
        """
        if self.norms.max() * norms.max(initial=0) >= EXACT / 4:  # beyond exact floats: whole numbers of any size
            exact = self.vectors.astype(object) @ rows.T.astype(object) if rows.shape[1] else np.zeros((len(self.ids), len(rows)), object)
            everything = np.arange(len(self.ids))
            take(everything, np.ones(exact.shape, bool), exact)
            return
        rows, anchors = rows.astype(np.float64), self.vectors.astype(np.float64)
        place = np.zeros(len(self.ids), np.int64)
        # Rounding of the bounds, far above what floats lose on the way.
        slack = 1e-9 * self.norms.max() * norms + 1e-3
        for level in self.levels:
            if level[0] == 0:
                low = high = anchors[level] @ rows.T
                asked = ask(level, low, high)
            else:
                up, reach = place[self.parent[level]], self.edge[level][:, None] * norms + slack
                low, high = low[up] - reach, high[up] + reach
                asked = ask(level, low, high)
                if asked.mean() > DENSE:
                    low = high = anchors[level] @ rows.T
                else:
                    j, i = np.nonzero(asked)
                    for at in range(0, len(j), 1 << 16):
                        a, b = j[at : at + (1 << 16)], i[at : at + (1 << 16)]
                        low[a, b] = high[a, b] = np.einsum("ij,ij->i", anchors[level[a]], rows[b])
            place[level] = np.arange(len(level))
            take(level, asked, low)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first k by score, then id."""
    if len(scores) > 4 * k and scores.dtype != object:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _cells(table: pa.Table, anchors: pa.Table) -> Iterator[tuple[Block, pa.Table]]:
    width = max(matrix(table.column("vector")[:0]).shape[1], _widest(table), _widest(anchors))
    for block in anchors.column("block").unique().to_pylist():
        part = anchors.filter(pa.compute.equal(anchors.column("block"), block))
        yield Block(part, width), part.sort_by("seat")


def _widest(table: pa.Table) -> int:
    return int(pa.compute.max(pa.compute.list_value_length(table.column("vector"))).as_py() or 0)


def _slabs(table: pa.Table, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, table.num_rows, SLAB):
        part = table.slice(at, SLAB)
        rows = matrix(part.column("vector"), width)
        yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), rows, np.sqrt((rows.astype(np.float64) ** 2).sum(1))


def _output(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {n: pa.decimal128(38, 0) if k.startswith("decimal") else pa.int64() for n, k in (c.split() for c in schema.split(", "))}
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table({n: pa.array([_whole(v) for v in c] if kind != pa.int64() else c, kind) for (n, kind), c in zip(kinds.items(), columns)})


def _whole(value: float | int) -> int:
    """Scores of any size fit 38 digits: 2 ** 126 times the dimensions would not, and is held."""
    return max(-(10**38) + 1, min(10**38 - 1, int(value)))


def positives_of(table: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """The best k rows of an anchor's label in a chunk."""
    out: list[tuple] = []
    width = max(_widest(table), _widest(anchors))
    for block, _ in _cells(table, anchors):
        found: list[list[tuple]] = [[] for _ in block.ids]
        least = np.full(len(block.ids), -np.inf)
        for ids, labels, rows, norms in _slabs(table, width):
            same = lambda level: (block.labels[level][:, None] == labels) & (block.ids[level][:, None] != ids)  # noqa: B023, E731

            def ask(level, low, high):
                return same(level) & (high >= least[level][:, None])  # noqa: B023

            def take(level, asked, scores):
                for j, a in enumerate(level):
                    at = np.flatnonzero(asked[j] & (scores[j] >= least[a]) if scores.dtype != object else same(level)[j])  # noqa: B023
                    if len(at):
                        top = at[best(scores[j][at], ids[at], k)]  # noqa: B023
                        found[a] = sorted([*found[a], *((-int(scores[j][i]), int(ids[i])) for i in top)])[:k]  # noqa: B023
                        if len(found[a]) == k:  # noqa: B023
                            least[a] = -found[a][-1][0]  # noqa: B023

            block.walk(rows, norms, ask, take)
        out += [(int(a), int(label), i, -s) for a, label, rows in zip(block.ids, block.labels, found) for s, i in rows]
    return _output(out, FOUND)


def negatives_of(table: pa.Table, anchors: pa.Table, k: int, low_share: int, high_share: int) -> pa.Table:
    """The best k rows of other labels in a chunk inside the window of each positive."""
    out: list[tuple] = []
    width = max(_widest(table), _widest(anchors))
    for block, part in _cells(table, anchors):
        positives = [[(int(p["score"]), p["vec_id"]) for p in ps] for ps in part.column("positives").to_pylist()]
        # 100 n between low * p and high * p, in whole numbers.
        windows = [[(-(-low_share * p // 100), high_share * p // 100) for p, _ in ps] for ps in positives]
        found: list[list[list[tuple]]] = [[[] for _ in ps] for ps in positives]
        upper = np.array([max((float(b) for a, b in ws if a <= b), default=-np.inf) for ws in windows])
        least = np.array([min((float(a) for a, b in ws if a <= b), default=np.inf) for ws in windows])

        for ids, labels, rows, norms in _slabs(table, width):

            def ask(level, low, high):
                other = block.labels[level][:, None] != labels  # noqa: B023
                return other & (high >= least[level][:, None]) & (low <= upper[level][:, None])  # noqa: B023

            def take(level, asked, scores):
                for j, a in enumerate(level):
                    own = scores[j]
                    at = np.flatnonzero(asked[j] & (own >= least[a]) & (own <= upper[a]) & (block.labels[a] != labels))  # noqa: B023
                    if not len(at):
                        continue
                    for (low, high), rest in zip(windows[a], found[a]):  # noqa: B023
                        inside = at[(own[at] >= low) & (own[at] <= high)]
                        if len(inside):
                            top = inside[best(own[inside], ids[inside], k)]  # noqa: B023
                            rest[:] = sorted([*rest, *((-int(own[i]), int(ids[i])) for i in top)])[:k]  # noqa: B023
                    least[a] = min(  # noqa: B023
                        (float(-rest[-1][0] if len(rest) == k else low) for (low, high), rest in zip(windows[a], found[a]) if low <= high),  # noqa: B023
                        default=np.inf,
                    )

            block.walk(rows, norms, ask, take)
        for a, ps, lists in zip(block.ids, positives, found):
            out += [(int(a), p, s, i, -n) for (s, p), rest in zip(ps, lists) for n, i in rest]
    return _output(out, MINED)


def mine(
    rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Hard negatives of each anchor and positive, with ranks and scores (actions)."""
    bounded_batches(rows.sparkSession)
    known = settled(usable(rows, key, vector, label), "vectors")
    total = known.count()
    # Few rows are still dealt over several tasks.
    chunks = max(-(-total // CHUNK), min(-(-total // LEAST_CHUNK), 32), 1)
    anchors = known.filter(F.pmod("vec_id", F.lit(every)) == 0)
    near = F.aggregate(
        F.slice("vector", 1, 16), F.lit(0).cast("long"), lambda code, x: code * 2 + F.when(x < 0, 1).otherwise(0),
    ).alias("near")
    tasks = anchors.count() // (16 * BLOCK) + 1
    ordered = anchors.select("vec_id", "label", "vector", near).repartitionByRange(tasks, "label", "near", "vec_id")
    trees = settled(ordered.sortWithinPartitions("label", "near", "vec_id").select("vec_id", "label", "vector").mapInArrow(_trees, TREE), "trees")
    blocks = trees.select("block").distinct()
    groups = blocks.count() // GROUP + 1

    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk")
    left = known.select("*", chunk, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))

    def dealt(table: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("part")
        return table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), part)

    def cell(work: Callable[[pa.Table, pa.Table], pa.Table], none: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda a, b: work(a, b) if a.num_rows and b.num_rows else _output([], none)

    grid = left.groupBy("chunk", "part").cogroup(dealt(trees).groupBy("chunk", "part"))
    near_rows = grid.applyInArrow(cell(lambda a, b: positives_of(a, b, positives), FOUND), FOUND)
    order = [F.desc("score"), F.col("vec_id")]
    firsts = settled(top_k(near_rows, ["anchor_id"], order, positives, ["vec_id"]), "positives")

    asked = firsts.groupBy("anchor_id").agg(F.collect_list(F.struct("score", "vec_id")).alias("positives"))  # a few each
    none = F.array().cast("array<struct<score:decimal(38,0),vec_id:long>>")
    with_positives = trees.join(asked, "anchor_id", "left").withColumn("positives", F.coalesce("positives", none))
    grid = left.groupBy("chunk", "part").cogroup(dealt(with_positives).groupBy("chunk", "part"))
    mined = grid.applyInArrow(cell(lambda a, b: negatives_of(a, b, negatives, low, high), MINED), MINED)
    ranked = top_k(mined, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.col("negative_id")], negatives, ["negative_id"], rank="rank")
    held = lambda name: F.greatest(F.least(F.col(name), F.lit((1 << 63) - 1)), F.lit(-(1 << 63) + 1)).cast("long").alias(name)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", held("positive_score"), held("negative_score"))
