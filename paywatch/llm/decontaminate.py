"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared in lower case with runs of white space as one space. An item of m
characters that occurs with at most e edits shares at least m + 1 - q - q e of its q-grams
with that place, on diagonals (position in the document less position in the item) that
differ by at most e from the place's own.

1. Index. The items' q-grams are hashed, sorted and put into a bitmap.
2. Count. A document's q-grams are hashed with one vectorised pass. Each hit falls on a
   diagonal; diagonals are cut into bands of twice 2 e + 1 that overlap by half, so some
   band holds every q-gram of an occurrence. Distinct item positions are counted per band.
3. Keep the bands that reach the lemma's bound; bands that touch are one region.
4. Verify each region: the item as it is, else by alignment of the whole item restricted to
   the region's diagonals. Every region that holds the item is reported with its best place.

The edit budget is ``rate`` of the item's length. It stays below 1/q so that the bound is
positive; items shorter than q have to occur as they are, and not inside longer words.

Items are handled in blocks of at most BLOCK_CHARS characters, each of which is what one
pass sends to the tasks. Documents are never shuffled.

Cases: null and empty documents hold nothing; null and empty items match nothing.
Repeated items give a row each, repeated documents too. Rows with a null id are searched
like others. Extra columns are not read, or kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from paywatch.llm.common import filter_rows, map_rows, texts
from paywatch.runtime import settled

Q, RATE = 12, 0.06
BLOCK_CHARS = 2_000_000
PAIRS = 1 << 18  # hits of one item in one document that are listed one by one
BITMAP = 1 << 22
SPACE = re.compile(r"\s+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return SPACE.sub(" ", text.lower()).strip()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of every q-gram, by Horner's rule on all positions at once."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out *= FACTOR
        out += wide[k : k + n]
    return out ^ (out >> np.uint64(29))


def banded_edits(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits that turn the item into some part of the text, on diagonals low to high.

    Returns (edits, start, end) of the best part, or None above ``most``. A diagonal is the
    text position less the item position; the part may start and end anywhere on them.
    """
    width = high - low + 1
    far = np.int64(1 << 30)
    slots = np.arange(width, dtype=np.int64)
    # cost[d] at row i: item[:i] against text ending before position i + low + d.
    at = slots + low
    inside = (at >= 0) & (at <= len(text))
    cost = np.where(inside, 0, far)
    begin = np.where(inside, at, 0)
    for i, c in enumerate(item):
        at = slots + low + i  # text position that a step along the diagonal reads
        readable = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[readable] = text[at[readable]] == c
        along = np.where(readable, cost + ~same, far)
        skip = np.append(cost[1:] + 1, far)  # the item's character has no partner
        skip_begin = np.append(begin[1:], 0)
        take = skip < along
        row, row_begin = np.where(take, skip, along), np.where(take, skip_begin, begin)
        # Characters of the text without a partner: a running minimum along the row.
        inside = (at + 1 >= 0) & (at + 1 <= len(text))
        row = np.where(inside, row, far)
        shifted = row - slots
        least = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == least, slots, 0))
        # A run must not leave the text: positions grow along the row, so only its end can.
        cost = np.where(inside, np.minimum(least + slots, far), far)
        begin = row_begin[source]
        if cost.min() > most:
            return None
    best = int(np.argmin(cost))
    if cost[best] > most:
        return None
    return int(cost[best]), int(begin[best]), int(best + low + len(item))


@dataclass(frozen=True)
class Index:
    """Items of one block and their q-grams."""

    ids: list
    items: list[str]
    codes: list[np.ndarray]
    hashes: list[np.ndarray]
    budgets: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray
    owner: np.ndarray
    bitmap: np.ndarray
    short: list[int]

    def search(self, raw: str, first_only: bool = False) -> list[tuple]:
        """(item id, start, end, edits, characters of the item) of every region that holds an item."""
        text = normal(raw)
        found = [
            (self.ids[k], at, at + len(self.items[k]), 0, len(self.items[k])) for k in self.short for at in word_places(text, self.items[k])
        ]
        codes = code_points(text)
        hashes = gram_hashes(codes, Q)
        if (first_only and found) or not len(hashes) or not len(self.grams):
            return found
        spots = np.flatnonzero(self.bitmap[hashes & np.uint64(BITMAP - 1)])
        spots = spots[np.argsort(hashes[spots], kind="stable")]
        known = Occurrences(hashes[spots], spots)
        # Of each item the grams that stand anywhere in the document, however often.
        distinct = np.unique(known.hashes)
        first, after = (np.searchsorted(self.grams, distinct, side) for side in ("left", "right"))
        totals = np.bincount(self.owner[_ranges(first, after)], minlength=len(self.ids))
        for k in np.flatnonzero((totals >= self.bounds) & (totals > 0)).tolist():
            item, m, e = self.items[k], len(self.items[k]), int(self.budgets[k])
            for low, high in known.regions(self.hashes[k], e, int(self.bounds[k])):
                left = max(0, low)
                right = max(left, high + m)
                at = text.find(item, left, right)
                if at >= 0:
                    hit = (0, at, at + m)
                elif (hit := banded_edits(self.codes[k], codes[left:right], low - left, high - left, e)) is not None:
                    hit = (hit[0], hit[1] + left, hit[2] + left)
                if hit is not None and not (found and found[-1][:3] == (self.ids[k], *hit[1:])):
                    found.append((self.ids[k], hit[1], hit[2], hit[0], m))
                    if first_only:
                        return found
        return found


class Occurrences:
    """Where the q-grams of a document stand, in the order of their hashes."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray):
        self.hashes, self.places = hashes, places

    def regions(self, grams: np.ndarray, edits: int, bound: int) -> list[tuple[int, int]]:
        """Ranges of diagonals with at least ``bound`` distinct positions of an item in some band.

        Bands that touch are one region. Hits are listed one by one up to PAIRS; where an
        item and a document repeat the same grams, each item position is looked up per band
        instead, so neither time nor memory grows with the product of the repeats.
        """
        first, after = (np.searchsorted(self.hashes, grams, side) for side in ("left", "right"))
        step = 2 * edits + 1
        if (after - first).sum() <= PAIRS:
            position = np.repeat(np.arange(len(grams)), after - first)
            band = (self.places[_ranges(first, after)] - position) // step
            # Each hit counts in its own band and in the one that began a step earlier.
            keys = np.unique(np.concatenate([band, band - 1]) * len(grams) + np.tile(position, 2))
            bands, shared = np.unique(keys // len(grams), return_counts=True)
        else:
            there = np.flatnonzero(after > first)
            ends = self.places[first[there]] - there, self.places[after[there] - 1] - there
            bands = np.arange(int(ends[0].min()) // step - 1, int(ends[1].max()) // step + 1)
            shared = np.zeros(len(bands), np.int64)
            for a in np.unique(first[there]).tolist():
                rows = there[first[there] == a]
                own = self.places[a : after[rows[0]]]
                for at in range(0, len(bands), max(1, PAIRS // len(rows))):
                    part = slice(at, at + max(1, PAIRS // len(rows)))
                    from_ = rows[:, None] + bands[part] * step
                    shared[part] += (np.searchsorted(own, from_ + 2 * step) > np.searchsorted(own, from_)).sum(0)
        bands = bands[shared >= bound]
        if not len(bands):
            return []
        cuts = np.flatnonzero(np.diff(bands) > 1) + 1
        return [(int(r[0]) * step - edits, (int(r[-1]) + 2) * step + edits) for r in np.split(bands, cuts)]


def _ranges(first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """All numbers from each first up to its after, one range behind the other."""
    counts = after - first
    return np.repeat(first - (counts.cumsum() - counts), counts) + np.arange(counts.sum())


def word_places(text: str, item: str) -> list[int]:
    """Where a short item stands, not as a part of longer words."""
    inside = r"[^\W_]"
    before = f"(?<!{inside})" if re.match(inside, item) else ""
    behind = f"(?!{inside})" if re.search(f"{inside}$", item) else ""
    return [m.start() for m in re.finditer(before + re.escape(item) + behind, text)]


def build_index(rows: list[tuple], rate: float = RATE) -> Index:
    """Index of (id, text) rows, which must be one bounded block."""
    if not 0 <= rate < 1 / Q:
        raise ValueError(f"the edit rate must lie below 1/{Q}")
    kept = [(i, t) for i, t in ((i, normal(t or "")) for i, t in rows) if t]
    codes = [code_points(t) for _, t in kept]
    sizes = np.array([len(c) for c in codes], np.int64)
    budgets = (sizes * rate).astype(np.int64)
    bounds = sizes + 1 - Q - Q * budgets
    # Rounding can leave a short item without a positive bound: it gets a smaller budget.
    budgets = np.where(bounds < 1, np.maximum(0, (sizes - Q) // Q), budgets)
    bounds = sizes + 1 - Q - Q * budgets
    hashes = [gram_hashes(c, Q) for c in codes]
    grams = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    owner = np.repeat(np.arange(len(kept)), [len(h) for h in hashes]) if hashes else np.zeros(0, np.int64)
    bitmap = np.zeros(BITMAP, bool)
    bitmap[grams & np.uint64(BITMAP - 1)] = True
    return Index(
        [i for i, _ in kept], [t for _, t in kept], codes, hashes, budgets, bounds, grams[order],
        owner[order].astype(np.int64), bitmap, [k for k, n in enumerate(sizes) if n < Q],
    )


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``most`` characters (or one item), one at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(row["text"] or "")
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += n
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, most: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and region of it that holds an item: the best place and its edits.

    Positions are code points of the compared form of the text. With more than one block
    every block's result is written before the next is read.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind}, start int, end int, edits int, item_chars int"

    def found_in(block: list[tuple]) -> DataFrame:
        def make():
            index = build_index(block, rate)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                hits = [(k, *hit) for k, t in enumerate(texts(batch.column(1))) for hit in index.search(t)]
                columns = list(zip(*hits)) or [()] * 6
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int32())), pa.array(columns[1], id_type),
                     *[pa.array(c, pa.int32()) for c in columns[2:]]],
                    names=["doc_id", "item_id", "start", "end", "edits", "item_chars"],
                )

            return step

        return map_rows(docs, ["doc_id", "text"], schema, make)

    held, parts = None, []
    for block in blocks(benchmark, most):
        if held is not None:
            parts.append(settled(found_in(held), "matches"))
        held = block
    if held is None:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts, found_in(held))


def without_passages(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, most: int = BLOCK_CHARS) -> DataFrame:
    """Documents without any item, with all their columns."""

    def clean(rows: DataFrame, block: list[tuple]) -> DataFrame:
        def make():
            index = build_index(block, rate)
            return lambda batch: [not index.search(t, first_only=True) for t in batch]

        return filter_rows(rows, "text", make)

    held = None
    for block in blocks(benchmark, most):
        if held is not None:
            docs = settled(clean(docs, held), "searched")
        held = block
    return docs if held is None else clean(docs, held)
