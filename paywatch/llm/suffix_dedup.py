"""Repeated passages of documents by merging Burrows-Wheeler transforms.

Every byte is removed that lies in a string of LENGTH bytes which also starts earlier: in a
document with a smaller id, or earlier in the same one. Strings overlap and are judged on
the input. Equal strings are found in three steps:

1. Places. Windows of LENGTH bytes are told apart by the least hash among their SEED-byte
   parts. Consecutive windows with the same part form a slice. Equal windows lie in slices
   with the same part, so a slice whose part stands nowhere else is done. Slices are packed
   as arrays by bucket of the part. Slices that are equal as a whole need no closer look:
   all but the first one are repeats.
2. Shards. Different slices around one part are cut from the texts. Each shard of slices is
   suffix-sorted once and leaves as Burrows-Wheeler transforms, one per bucket, which hold
   all that is needed: suffixes are found again by walking the transform backwards.
3. Merge. The transforms of a bucket are interleaved by iterative refinement (Holt and
   McMillan): the rows in the order of their first h symbols, taken one step back, are in
   the order of their first h + g symbols after one stable counting pass. The round in which
   two neighbours come apart gives their common prefix; rows that never come apart within
   LENGTH bytes form a repeated interval. No suffix is sorted again. One round takes g bytes,
   the largest divisor of LENGTH up to 5 with at most 65,536 different contexts.

Sizes. A bucket of step 1 holds slices of about BUCKET bytes of text, one of step 3 about
MERGE bytes. Equal slices of a task are reduced to their first one before the shuffle, so a
text that fills a third of the rows gives one slice a task. Parts with many different slices
(a phrase in many contexts) are recognised on one document in SAMPLE; their windows are
compared as a whole, each under its own key, which only changes the way, not the result.

Cases: a null text is empty; texts under LENGTH bytes lose nothing. A null id comes after all
others. Rows of one id with different texts are ordered by a hash of the text. Rows of equal
id and text are one document and get the same result. Ids are integers. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywatch.llm.common import CELLS, SLICE, bounded_batches, in_cells_of
from paywatch.runtime import settled

LENGTH, SEED = 100, 48
FLUSH, PACK = 1 << 21, 1 << 25
BUCKET, MERGE, SHARD = 1 << 21, 1 << 18, 1 << 20
SAMPLE, HOT, HOT_PARTS = 256, 256, 10_000
TERM = 255  # no byte of UTF-8

_U = np.uint64
_BYTE = (np.random.RandomState(7).randint(0, 2**62, 256).astype(_U) << _U(1)) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_PLACE = _U(0xFFFFFF)


def part_hashes(data: np.ndarray, size: int = SEED) -> np.ndarray:
    """Hash of the ``size`` bytes from every position, by doubling."""
    whole = len(data) - size + 1
    level, width, power = _BYTE[data], 1, _BASE
    total, covered = None, 0
    while True:
        if size & width:
            piece = level[covered : covered + whole]
            total = piece.copy() if total is None else total * _U(power) + piece
            covered += width
        if width * 2 > size:
            break
        level = level[:-width] * _U(power) + level[width:]
        width, power = width * 2, power * power % (1 << 64)
    total ^= total >> _U(32)
    total *= _U(0xD6E8FEB86659FD93)
    total ^= total >> _U(29)
    return total


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` hashes the place of its least one, the leftmost of equals."""
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=_U)
    count, step = len(low) - width + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return (np.minimum(low[:count], low[width - step : width - step + count]) & _PLACE).astype(np.int64)


def slices_of(texts: list[bytes], length: int, seed: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(part, content hash, text number, start, windows) of all slices of some texts."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    array = np.frombuffer(data, np.uint8)
    hashes = part_hashes(array, seed)
    place = least_places(hashes, length - seed + 1)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(place)]
    inside = np.arange(length, length + len(place)) <= ends[text]
    new = np.empty(len(place), bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(place)))
    keep = inside[first]
    first, windows = first[keep], windows[keep]
    part = hashes[place[first]]
    if len(hot) and (wide := np.isin(part, hot)).any():
        single = np.where(wide, windows, 1)
        row = np.repeat(np.arange(len(first)), single)
        within = np.arange(len(row)) - np.repeat(np.cumsum(single) - single, single)
        first, windows, part, wide = first[row] + within, np.where(wide[row], 1, windows[row]), part[row], wide[row]
    else:
        wide = None
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter(
        (digest(data[a:b]) for a, b in zip(first.tolist(), (first + windows + length - 1).tolist())), _U, len(first),
    )
    if wide is not None:  # a window of a hot part is a group of its own
        part = np.where(wide, part * _U(_BASE) ^ content, part)
    number = text[first]
    return part, content, number, first - (ends - sizes)[number], windows


class Slices:
    """Collects the slices of a task and packs them by bucket."""

    def __init__(self, buckets: int, length: int, seed: int, hot: np.ndarray):
        self.buckets, self.length, self.seed, self.hot = buckets, length, seed, hot
        self.texts: list[bytes] = []
        self.owner: list[tuple[int, int, int]] = []
        self.size = self.packed = 0
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, rid: int, tie: int, text: bytes) -> None:
        for base in range(0, max(len(text) - self.length + 1, 0), FLUSH):
            piece = text[base : base + FLUSH + self.length - 1]
            self.texts.append(piece)
            self.owner.append((rid, tie, base))
            self.size += len(piece)
            if self.size >= FLUSH:
                self.flush()

    def flush(self) -> None:
        if self.texts:
            part, content, number, start, windows = slices_of(self.texts, self.length, self.seed, self.hot)
            owner = np.array(self.owner, np.int64)[number]
            self.found.append((part, content, owner[:, 0], owner[:, 1], start + owner[:, 2], windows))
            self.packed += self.size
            self.texts, self.owner, self.size = [], [], 0

    def packs(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        if not self.found:
            return
        part, content, rid, tie, start, windows = (np.concatenate(c) for c in zip(*self.found))
        self.found, self.packed = [], 0
        bucket = (part % _U(self.buckets)).astype(np.int64)
        order = np.lexsort((start, tie, rid, content, part, bucket))
        part, content, rid, tie, start, windows, bucket = (c[order] for c in (part, content, rid, tie, start, windows, bucket))
        first = _heads(part, content)
        leader = np.flatnonzero(first)[np.cumsum(first) - 1]
        again = ~first & ((rid != rid[leader]) | (tie != tie[leader]) | (start != start[leader]))
        local = merged_runs(rid[again], tie[again], start[again], start[again] + windows[again] + self.length - 1)
        part, content, rid, tie, start, windows, bucket = (c[first] for c in (part, content, rid, tie, start, windows, bucket))
        cuts = np.append(np.flatnonzero(_heads(bucket)), len(bucket))
        columns = [part, content, rid, tie.astype(np.int32), start.astype(np.uint32), windows.astype(np.uint8)]
        share = np.linspace(0, len(local[0]), len(cuts)).astype(np.int64)
        rows = []
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            c, d = share[k], share[k + 1]
            rows.append((int(bucket[a]), *(x[a:b].tobytes() for x in columns), *(x[c:d].tobytes() for x in local)))
            if len(rows) == 256:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


PACKED = ["part", "content", "rid", "tie", "start", "windows", "m_rid", "m_tie", "m_start", "m_stop"]
PACK_SCHEMA = "bucket long, " + ", ".join(f"{n} binary" for n in PACKED)
PLACES = "kind int, part long, rid long, tie int, start long, stop long"
MARKS = "rid long, tie int, start long, stop long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *PACKED])


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Rows whose key differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def merged_runs(rid: np.ndarray, tie: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Union of the ranges of each document."""
    order = np.lexsort((start, tie, rid))
    rid, tie, start, stop = (c[order] for c in (rid, tie, start, stop))
    if not len(rid):
        return [rid, tie, start, stop]
    own = _heads(rid, tie)
    group = np.cumsum(own)
    # The furthest stop so far within a document: documents are lifted above each other.
    lift = group * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift) - lift
    new = own.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(rid)) - 1
    return [rid[at], tie[at], start[at], reach[last]]


def _join_bytes(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def places_of(table: pa.Table, length: int) -> pa.Table:
    """Of one bucket: repeats (kind 0), and the different slices around a common part (kind 1)."""
    kinds = [_U, _U, np.int64, np.int32, np.uint32, np.uint8, np.int64, np.int64, np.int64, np.int64]
    part, content, rid, tie, start, windows, *local = (_join_bytes(table.column(n), k) for n, k in zip(PACKED, kinds))
    start, stop = start.astype(np.int64), start.astype(np.int64) + windows + length - 1
    order = np.lexsort((start, tie, rid, content, part))
    part, content, rid, tie, start, stop = (c[order] for c in (part, content, rid, tie, start, stop))
    head, first = _heads(part), _heads(part, content)
    leader = np.flatnonzero(first)[np.cumsum(first) - 1] if len(part) else order
    again = ~first & ((rid != rid[leader]) | (tie != tie[leader]) | (start != start[leader]))
    group = np.cumsum(head) - 1
    several = np.bincount(group, first, minlength=1)[group] > 1 if len(part) else again
    ask = first & several
    marks = merged_runs(*(np.concatenate([x, y[again]]) for x, y in zip(local, (rid, tie, start, stop))))
    kind = np.repeat([0, 1], [len(marks[0]), int(ask.sum())])
    both = [np.concatenate([m, c[ask]]) for m, c in zip(marks, (rid, tie, start, stop))]
    parts = np.concatenate([np.zeros(len(marks[0]), np.int64), part[ask].view(np.int64)])
    return pa.table({
        "kind": pa.array(kind, pa.int32()), "part": pa.array(parts, pa.int64()), "rid": pa.array(both[0], pa.int64()),
        "tie": pa.array(both[1], pa.int32()), "start": pa.array(both[2], pa.int64()), "stop": pa.array(both[3], pa.int64()),
    })


def transform(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of the rotations of terminated strings, group by group.

    Returns the symbols, the string of each terminator row in order, and the group of each
    row. Rotations are ranked by their first 7 bytes, then three ranks at a time.
    """
    data = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    sizes = np.array([len(s) + 1 for s in strings])
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    string = np.repeat(np.arange(len(strings)), sizes)
    within = np.arange(len(data)) - begin
    bits = max(1, int(len(data)).bit_length())
    key = np.zeros(len(data), _U)
    for k in range(7):
        key = (key << _U(8)) | data[begin + (within + k) % size]
    depth, times = 7, 63 // bits
    while True:
        order = np.argsort(key)
        rank = np.empty(len(data), _U)
        rank[order] = np.cumsum(_heads(key[order])).astype(_U) - _U(1)
        if depth >= sizes.max():
            break
        key = rank
        for k in range(1, times):
            key = (key << _U(bits)) | rank[begin + (within + k * depth) % size]
        depth *= times
    order = np.lexsort((np.arange(len(data)), rank, group[string]))
    symbols = data[(begin + (within - 1) % size)[order]]
    return symbols, string[order][data[order] == TERM], group[string[order]]


def repeated_intervals(pieces: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge transforms: per suffix in merged order its string, its place counted from the
    terminator, the bytes it shares with the one before, and its interval.

    Strings are numbered by the terminator rows of the pieces one after the other. Shared
    bytes are exact to one round and end at ``length``; suffixes of one interval share all.
    """
    symbols = np.concatenate(pieces)
    piece = np.repeat(np.arange(len(pieces), dtype=np.uint16 if len(pieces) < 1 << 16 else np.int64), [len(p) for p in pieces])
    order = np.argsort(symbols, kind="stable")
    order = order[np.argsort(piece[order], kind="stable")]
    back = np.empty(len(symbols), np.int32)
    back[order] = np.arange(len(symbols), dtype=np.int32)

    # Where each row's suffix stands: from the terminators backwards, all strings at once.
    row = np.flatnonzero(symbols[order] == TERM).astype(np.int32)
    string, place = np.empty(len(symbols), np.int32), np.empty(len(symbols), np.int32)
    number, step = np.arange(len(row), dtype=np.int32), 0
    while len(row):
        string[row], place[row] = number, step
        more = symbols[row] != TERM
        row, number, step = back[row[more]], number[more], step + 1

    context, at, best = np.zeros(len(symbols), _U), np.arange(len(symbols), dtype=np.int32), None
    for stride in range(1, 6):
        context |= symbols[at].astype(_U) << _U(8 * (stride - 1))
        at = back[at]
        if length % stride == 0:
            ranks, codes = np.unique(context, return_inverse=True)
            if len(ranks) > 1 << 16:
                break
            best = stride, codes.astype(np.uint16), at
    stride, codes, at = best

    rows, block = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    shared = np.full(len(symbols), length, np.int16)
    for depth in range(0, length, stride):
        code = codes[rows]
        order = np.argsort(code, kind="stable")
        rows, code, block = at[rows[order]], code[order], block[order]
        new = _heads(code, block)
        block = np.cumsum(new, dtype=np.int32)
        shared[new & (shared == length)] = depth
    return string[rows], place[rows], shared, block


def merged_repeats(table: pa.Table, length: int) -> pa.Table:
    """Of one bucket of transforms: the ranges that stand earlier too."""
    pieces = [np.frombuffer(b, np.uint8) for b in table.column("symbols").to_pylist()]
    rid, tie, start, size = (
        _join_bytes(table.column(n), k) for n, k in (("rid", np.int64), ("tie", np.int32), ("start", np.int64), ("size", np.int64))
    )
    string, place, _, block = repeated_intervals(pieces, length)
    whole = place >= length  # the window ends before the terminator
    string, place, block = string[whole], place[whole], block[whole]
    several = np.bincount(block)[block] > 1 if len(block) else whole[:0]
    string, place, block = string[several], place[several], block[several]
    at = start[string] + size[string] - place
    rid, tie = rid[string], tie[string]
    order = np.lexsort((at, tie, rid, block))
    rid, tie, at, block = rid[order], tie[order], at[order], block[order]
    first = _heads(block)
    leader = np.flatnonzero(first)[np.cumsum(first) - 1] if len(block) else order
    again = (rid != rid[leader]) | (tie != tie[leader]) | (at != at[leader])
    out = merged_runs(rid[again], tie[again].astype(np.int64), at[again], at[again] + length)
    return pa.table({
        "rid": pa.array(out[0], pa.int64()), "tie": pa.array(out[1].astype(np.int32), pa.int32()),
        "start": pa.array(out[2], pa.int64()), "stop": pa.array(out[3], pa.int64()),
    })


def _hot_parts(keyed: DataFrame, length: int, seed: int, sample: int, hot: int) -> np.ndarray:
    """Parts that stand in many different slices, as far as one document in ``sample`` shows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, _U)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if len(t) >= length]
            if texts:
                for at in range(0, len(texts), 200):
                    for piece in _pieces(texts[at : at + 200], length):
                        part, content, *_ = slices_of(piece, length, seed, none)
                        yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(content.view(np.int64))], ["part", "content"])

    some = keyed.filter(F.pmod(F.xxhash64("rid", "tie"), F.lit(sample)) == 0).select("body")
    found = some.mapInArrow(run, "part long, content long").distinct().groupBy("part").count().filter(F.col("count") >= hot)
    rows = found.orderBy(F.desc("count"), "part").limit(HOT_PARTS).collect()
    return np.array([r.part for r in rows], np.int64).view(_U)


def _pieces(texts: list[bytes], length: int) -> Iterator[list[bytes]]:
    """Texts in lists of bounded size; a longer text in overlapping parts."""
    out, size = [], 0
    for text in texts:
        for base in range(0, len(text) - length + 1, FLUSH):
            out.append(text[base : base + FLUSH + length - 1])
            size += len(out[-1])
            if size >= FLUSH:
                yield out
                out, size = [], 0
    if out:
        yield out


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rid = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))
    return docs.select(F.col(key).alias("doc_id"), rid.alias("rid"), F.hash(body).alias("tie"), body.alias("body"))


def repeats(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, sample: int = SAMPLE, hot: int = HOT,
    bucket: int = BUCKET, merge: int = MERGE, text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """(rid, tie, spans) of the documents that repeat something: maximal ranges of bytes (actions).

    ``rid`` is the id, the largest long for a null one, ``tie`` a hash of the text.
    """
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, text, key).filter(F.length("body") >= length)
    total = keyed.agg(F.sum(F.length("body").cast("long"))).first()[0] or 0
    buckets = int(total // bucket) + 1
    wide = _hot_parts(keyed, length, seed, sample, hot)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = Slices(buckets, length, seed, wide)
        for batch in batches:
            for rid, tie, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                slices.add(rid, tie, body.as_py())
                if slices.packed >= PACK:
                    yield from slices.packs()
        yield from slices.packs()

    packed = keyed.select("rid", "tie", "body").mapInArrow(pack, PACK_SCHEMA)
    places = settled(packed.groupBy("bucket").applyInArrow(lambda t: places_of(t, length), PLACES), "places")
    asked = places.filter("kind = 1")
    groups = int((asked.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0) // merge) + 1

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: list[bytes] = []
        owner: list[tuple[int, int, int, int]] = []
        size = 0
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("rid", "tie", "body", "asked")))
            for rid, tie, body, slices in rows:
                for s in slices:
                    strings.append(body[s["start"] : s["stop"]])
                    owner.append((s["part"] % groups, rid, tie, s["start"]))
                    size += len(strings[-1])
                    if size >= SHARD:
                        yield _transforms(strings, owner)
                        strings, owner, size = [], [], 0
        if strings:
            yield _transforms(strings, owner)

    wanted = settled(
        asked.groupBy("rid", "tie").agg(F.collect_list(F.struct("start", "stop", "part")).alias("asked")), "wanted",
    )
    both = F.struct("rid", "tie")
    texts = in_cells_of(keyed.select("rid", "tie", "body").withColumn("_k", both), F.col("_k"), wanted.select(both.alias("_k")), "_k").drop("_k")
    # Repeated rows of a document are cut once.
    shards = texts.groupBy("rid", "tie").agg(F.first("body").alias("body")).join(wanted, ["rid", "tie"]).mapInArrow(shard, "bucket long, symbols binary, rid binary, tie binary, start binary, size binary")
    more = shards.groupBy("bucket").applyInArrow(lambda t: merged_repeats(t, length), MARKS)
    marks = places.filter("kind = 0").select("rid", "tie", "start", "stop").unionByName(more)
    ranges = marks.groupBy("rid", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    return ranges.mapInArrow(_spans, f"rid long, tie int, spans {SPANS}")


def _transforms(strings: list[bytes], owner: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    meta = np.array(owner, np.int64)
    symbols, ends, group = transform(strings, meta[:, 0])
    sizes = np.array([len(s) for s in strings], np.int64)
    cuts = np.append(np.flatnonzero(_heads(group)), len(group))
    names, per_group = group[cuts[:-1]], np.bincount(np.searchsorted(group[cuts[:-1]], meta[ends, 0]), minlength=len(cuts) - 1)
    stops = np.append(0, np.cumsum(per_group))
    out: dict[str, list] = {n: [] for n in ("bucket", "symbols", "rid", "tie", "start", "size")}
    for k, name in enumerate(names):
        own = ends[stops[k] : stops[k + 1]]
        out["bucket"].append(int(name))
        out["symbols"].append(symbols[cuts[k] : cuts[k + 1]].tobytes())
        out["rid"].append(meta[own, 1].tobytes())
        out["tie"].append(meta[own, 2].astype(np.int32).tobytes())
        out["start"].append(meta[own, 3].tobytes())
        out["size"].append(sizes[own].tobytes())
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64() if n == "bucket" else pa.binary()) for n, c in out.items()})


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of each document joined where they touch or overlap."""
    for batch in batches:
        ranges = batch.column(2)
        sizes = np.diff(ranges.offsets.to_numpy())
        start, stop = (ranges.flatten().field(k).to_numpy() for k in (0, 1))
        row = np.repeat(np.arange(batch.num_rows), sizes)
        own, _, first, last = merged_runs(row, np.zeros(len(row), np.int64), start, stop)
        offsets = np.append(0, np.cumsum(np.bincount(own, minlength=batch.num_rows)))
        joined = pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["start", "stop"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), joined)], ["rid", "tie", "spans"],
        )


SPANS = "array<struct<start:long,stop:long>>"
KEPT = f"doc_id long, n_bytes long, spans {SPANS}, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            kept, sizes = [], []
            for body, spans in zip(part.column("body"), part.column("spans").to_pylist()):
                body, at_byte, left = body.as_py(), 0, []
                for s in spans or ():
                    left.append(body[at_byte : s["start"]])
                    at_byte = s["stop"]
                kept.append(b"".join([*left, body[at_byte:]]))
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), part.column("spans"), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", **sizes: int) -> DataFrame:
    """Per row: id, bytes of the text, the removed spans, and the bytes that are kept (actions).

    What is kept can begin or end inside a character.
    """
    found = settled(repeats(docs, length, text=text, key=key, **sizes), "repeats")
    # Documents whose key shares no cell with a repeating one need no shuffle.
    cell = F.pmod(F.xxhash64("rid", "tie"), F.lit(CELLS)).alias("_cell")
    cells = F.broadcast(found.select(cell).distinct().withColumn("_hit", F.lit(True)))  # at most CELLS rows
    rows = _keyed(docs, text, key).select("*", cell).join(cells, "_cell", "left")
    clean = rows.filter("_hit IS NULL").select(
        "doc_id", F.length("body").cast("long").alias("n_bytes"), F.array().cast(SPANS).alias("spans"), F.col("body").alias("kept"),
    )
    touched = rows.filter("_hit").select("doc_id", "rid", "tie", "body").join(found, ["rid", "tie"], "left")
    cut = touched.select(F.col("doc_id").cast("long").alias("doc_id"), "body", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")).mapInArrow(_cut, KEPT)
    return clean.unionByName(cut)
