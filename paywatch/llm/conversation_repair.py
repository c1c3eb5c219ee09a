"""Cheapest repair of conversations whose rows are damaged, by Four-Russians block tables.

Rows are edited (Keep, Rerole to user or assistant, Delete, Insert an empty user or assistant
row) until the roles' initials read ``(s?(ua)+)?``. The state after some rows is one of four
(nothing, s, u, a), so what the rest of a conversation costs is a vector of four numbers.
Less their minimum, only few such vectors exist, and one row turns one into another. For every
block of BLOCK rows (nine symbols: four kinds of role, cut off or not, and rows that must go)
a table holds where each vector goes and what is added. Conversations are processed from
their end, one lookup a block. The edits are traced from the front: each block is expanded
backward into its rows' vectors, and of the cheapest edits the ASCII-least is taken.

Distribution. Equal rows are counted before they travel. Rows are range-partitioned by
(conversation, turn, role, text), so a conversation with a third of all rows spreads over many
tasks. One that begins and ends inside a partition and a segment is finished there. The
others (at most two a partition, and those longer than SEGMENT rows or SEGMENT_BYTES) leave as
segments: a segment's table maps the vector at its end to the one at its beginning, tables
of a conversation are combined from the last to the first, then states from the first to
the last, and each segment is traced by itself. Rows seen earlier in another segment are found
by an aggregate over hashes. Only the digest of a long conversation's repaired rows is made by
one task, which streams them.

Cases: null roles and texts are one space, and a null conversation or turn is one in the
damage key; null turns come first, and a null id is a conversation of its own. Rows of one
turn are ordered by role, then text. A role that begins with none of s, u, a (an empty one
too) can't be kept. Rows that repeat role and text, repeated rows too, are duplicates. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywatch.llm.common import bounded_batches
from paywatch.runtime import settled

BLOCK, SEGMENT, SEGMENT_BYTES = 4, 1 << 16, 1 << 23
SPACES = " \t\n\x0b\x0c\r"
GONE, SYMBOLS = 8, 9
INSERTED = (2, 2, 3, 2)  # state after an inserted or reroled row
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}  # (state, role): state
NAMES = {2: "user", 3: "assistant"}
END = (0, 4, 2, 0)


# --- cost vectors and block tables


def before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cost from each state on, with one row more in front; inserts before it included."""
    role, cut = divmod(symbol, 2)
    cost = []
    for state in range(4):
        ways = [3 + after[state]]
        if symbol != GONE:
            ways.append(2 + cut + after[INSERTED[state]])
            if (state, role) in KEPT:
                ways.append(cut + after[KEPT[state, role]])
        cost.append(min(ways))
    for _ in range(3):
        cost = [min(c, 2 + cost[INSERTED[state]]) for state, c in enumerate(cost)]
    return tuple(cost)


class Tables(NamedTuple):
    vectors: list[tuple[int, ...]]  # without their minimum; the first is END
    to: np.ndarray  # symbol, vector -> vector
    add: np.ndarray
    block_to: np.ndarray  # block, vector -> vector
    block_add: np.ndarray


@cache
def tables() -> Tables:
    vectors, steps = [END], []
    for vector in vectors:
        row = []
        for symbol in range(SYMBOLS):
            cost = before(symbol, vector)
            least = min(cost)
            cost = tuple(c - least for c in cost)
            if cost not in vectors:
                vectors.append(cost)
            row.append((vectors.index(cost), least))
        steps.append(row)
    to = np.array([[s[0] for s in row] for row in steps]).T
    add = np.array([[s[1] for s in row] for row in steps]).T
    # A block's number has its first row as the highest digit; its last row is applied first.
    block_to = np.tile(np.arange(len(vectors)), (SYMBOLS**BLOCK, 1))
    block_add = np.zeros_like(block_to)
    for k in range(BLOCK):
        digit = (np.arange(SYMBOLS**BLOCK) // SYMBOLS**k % SYMBOLS)[:, None]
        block_add = block_add + add[digit, block_to]
        block_to = to[digit, block_to]
    return Tables(vectors, to, add, block_to, block_add)


def split(symbols: bytes) -> tuple[bytes, np.ndarray]:
    """The first rows that fill no block, and the blocks' numbers."""
    odd = len(symbols) % BLOCK
    digits = np.frombuffer(symbols, np.uint8)[odd:].reshape(-1, BLOCK).astype(np.int64)
    return symbols[:odd], digits @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


def boundaries(symbols: bytes, last: int = 0) -> tuple[list[int], int, int]:
    """Vector at the end of each block, then at the begin of the first; vector and cost at the front."""
    table, (odd, blocks) = tables(), split(symbols)
    ends, vector, cost = [last], last, 0
    for block in blocks[::-1].tolist():
        cost += int(table.block_add[block, vector])
        vector = int(table.block_to[block, vector])
        ends.append(vector)
    for symbol in odd[::-1]:
        cost += int(table.add[symbol, vector])
        vector = int(table.to[symbol, vector])
    return ends[::-1], vector, cost


def segment_map(symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every vector at the end: the vector at the front and what is added."""
    table, (odd, blocks) = tables(), split(symbols)
    vector, cost = np.arange(len(table.vectors)), np.zeros(len(table.vectors), np.int64)
    for block in blocks[::-1].tolist():
        cost, vector = cost + table.block_add[block, vector], table.block_to[block, vector]
    for symbol in odd[::-1]:
        cost, vector = cost + table.add[symbol, vector], table.to[symbol, vector]
    return vector, cost


@lru_cache(1 << 16)
def traced(symbols: bytes, last: int, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits of a few rows from a state on, and the state after them."""
    table, after = tables(), [last]
    for symbol in symbols[::-1]:
        after.append(int(table.to[symbol, after[-1]]))
    after = after[::-1]
    out = []
    for k, symbol in enumerate(symbols):
        role, cut = divmod(symbol, 2)
        here, rest = table.vectors[after[k]], table.vectors[after[k + 1]]
        added = int(table.add[symbol, after[k + 1]])
        while True:
            left = here[state] + added
            if left == 3 + rest[state]:
                out.append("D")
            elif here[state] == 2 + here[INSERTED[state]]:
                out.append("I")
                state = INSERTED[state]
                continue
            elif (state, role) in KEPT and symbol != GONE and left == cut + rest[KEPT[state, role]]:
                out.append("K")
                state = KEPT[state, role]
            else:
                out.append("R")
                state = INSERTED[state]
            break
    return "".join(out), state


def trace(symbols: bytes, last: int, state: int) -> tuple[str, int]:
    """Edits of a segment, block after block."""
    odd = len(symbols) % BLOCK
    ends = boundaries(symbols, last)[0]
    out, state = traced(symbols[:odd], ends[0], state)
    pieces = [out]
    for k, at in enumerate(range(odd, len(symbols), BLOCK)):
        out, state = traced(symbols[at : at + BLOCK], ends[k + 1], state)
        pieces.append(out)
    return "".join(pieces), state


def closing(state: int) -> str:
    """Inserts at the end of a conversation."""
    return "I" * (END[state] // 2)


def repaired(rows: list[tuple[str, str, int]], audit: str, state: int) -> list[tuple[str, str]]:
    """Rows of role and text that the edits leave; ``rows`` have a count."""
    out, source = [], ((role, text) for role, text, n in rows for _ in range(n))
    for edit in audit:
        if edit == "I":
            state = INSERTED[state]
            out.append((NAMES[state], ""))
            continue
        role, text = next(source)
        if edit == "K":
            state = KEPT[state, "sua".index(role[0])]
            out.append((role, text))
        elif edit == "R":
            state = INSERTED[state]
            out.append((NAMES[state], text))
    return out


# --- rows, faults and counts


def diagnosed(rows: list[tuple[str, str, int]], seen: set[int]) -> tuple[bytes, list[int]]:
    """Symbols of all rows, and how many are blank, duplicate and cut off. ``seen``: rows that stood earlier."""
    symbols, faults = bytearray(), [0, 0, 0]
    for k, (role, text, n) in enumerate(rows):
        body = text.rstrip(SPACES)
        cut = bool(body) and body[-1] not in ".!?"
        if not body:
            gone = n
            faults[0] += n
        else:
            gone = n if k in seen else n - 1
            faults[1] += gone
            faults[2] += cut and gone < n
        if gone < n:
            kind = "sua".find(role[:1]) if role else -1
            symbols.append(2 * (kind if kind >= 0 else 3) + cut)
        symbols += bytes([GONE]) * gone
    return bytes(symbols), faults


def local_repeats(rows: list[tuple[str, str, int]]) -> set[int]:
    held, out = set(), set()
    for k, (role, text, _) in enumerate(rows):
        if (role, text) in held:
            out.add(k)
        held.add((role, text))
    return out


def pair_is_legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


class Turns:
    """Counts over the turns and roles of consecutive segments."""

    def __init__(self) -> None:
        self.low = self.high = self.last_turn = self.last_role = None
        self.distinct = self.illegal = 0

    def add(self, low, high, first_turn, last_turn, distinct, illegal, first_role, last_role) -> Turns:
        if low is not None:
            self.low = low if self.low is None else self.low
            self.high = high
            self.distinct += distinct - (first_turn is not None and first_turn == self.last_turn)
        if self.last_role is not None:
            illegal += not pair_is_legal(self.last_role, first_role)
        self.illegal += illegal
        self.last_turn, self.last_role = last_turn, last_role
        return self

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def turn_counts(turns: list[int | None], rows: list[tuple[str, str, int]]) -> tuple:
    """What Turns.add takes, of one segment; turns are sorted, nulls first."""
    known = [t for t in turns if t is not None]
    illegal = sum((n - 1) * (not pair_is_legal(r, r)) for r, _, n in rows)
    illegal += sum(not pair_is_legal(a[0], b[0]) for a, b in zip(rows, rows[1:]))
    low, high = (known[0], known[-1]) if known else (None, None)
    return low, high, turns[0], turns[-1], len(set(known)), illegal, rows[0][0], rows[-1][0]


def digest_rows(rows: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in rows).encode()


# --- the jobs

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULTS = [c.split()[0] for c in RESULT.split(", ")]
ROWS = "rows array<struct<turn:long,role:string,text:string,n:long>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the trial damage, equal ones counted in ``n``; a dropped one is left out."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(key.cast("binary")) % 20
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return conversations.select("conv_id", "turn", "role", "text", code.alias("_code")).filter("_code <> 0").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("_code") == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"), F.when(F.col("_code") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _sorted_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: whole conversations finished, all others as segments."""
    from pyspark import TaskContext

    part, seg, out, key_type = TaskContext.get().partitionId(), 0, [], None
    conv, turns, rows, size, count = None, [], [], 0, 0
    edge = True  # the conversation may have begun in the partition before, or goes on in the next

    def close(open_end: bool) -> None:
        nonlocal seg, turns, rows, size, count
        if not rows:
            return
        if edge or open_end:
            packed = [{"turn": t, "role": r, "text": x, "n": n} for t, (r, x, n) in zip(turns, rows)]
            out.append((conv, part, seg, *[None] * len(RESULTS), packed))
            seg += 1
        else:
            out.append((conv, part, None, *finished(turns, rows), None))
        turns, rows, size, count = [], [], 0, 0

    def flush() -> pa.RecordBatch:
        kinds = [key_type, pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.string()]
        kinds.append(pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64())])))
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "seg", *RESULTS, "rows"])

    for batch in batches:
        key_type = batch.schema.field("conv_id").type
        for c, turn, role, text, n in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "n"))):
            if rows and c != conv:
                close(False)
                edge = False
            conv = c
            while n:
                room = SEGMENT - count
                take = min(n, room)
                turns.append(turn)
                rows.append((role, text, take))
                count, size, n = count + take, size + len(text) * 4, n - take
                if count >= SEGMENT or size >= SEGMENT_BYTES:
                    close(True)
                    edge = True  # what follows of this conversation is a segment too
        if len(out) >= 1000 or sum(o[2] is not None for o in out) > 1:
            yield flush()
    close(True)
    if out:
        yield flush()


def finished(turns: list[int | None], rows: list[tuple[str, str, int]]) -> tuple:
    """Result columns of a whole conversation."""
    symbols, faults = diagnosed(rows, local_repeats(rows))
    _, front, cost = boundaries(symbols)
    audit, state = trace(symbols, 0, 0)
    audit += closing(state)
    counts = Turns().add(*turn_counts(turns, rows))
    sha = hashlib.sha256(digest_rows(repaired(rows, audit, 0))).hexdigest()
    return counts.gaps, *faults, counts.illegal, cost + tables().vectors[front][0], audit, sha


KEY = ["nil", "conv_id"]
MAPS = (
    "symbols binary, faults array<long>, low long, high long, first_turn long, last_turn long, distinct_turns long, illegal long, "
    "first_role string, last_role string, front array<long>, add array<long>"
)


def _diagnose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            held = row.column("rows").to_pylist()[0]
            rows = [(r["role"], r["text"], r["n"]) for r in held]
            symbols, faults = diagnosed(rows, set(row.column("again").to_pylist()[0] or ()))
            front, add = segment_map(symbols)
            values = [symbols, faults, *turn_counts([r["turn"] for r in held], rows), front.tolist(), add.tolist()]
            kinds = [pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 6, pa.string(), pa.string(), *[pa.list_(pa.int64())] * 2]
            names = [c.split()[0] for c in MAPS.split(", ")]
            keys = ["nil", "conv_id", "part", "seg"]
            yield pa.RecordBatch.from_arrays([*(row.column(n) for n in keys), *(pa.array([v], t) for v, t in zip(values, kinds))], [*keys, *names])


def _ends(table: pa.Table) -> pa.Table:
    """Of one conversation's segments: the vector at the end of each, and the counts."""
    table = table.sort_by([("part", "ascending"), ("seg", "ascending")])
    rows = table.to_pylist()
    last, cost, ends = 0, 0, []
    for row in reversed(rows):
        ends.append(last)
        cost, last = cost + row["add"][last], row["front"][last]
    cost += tables().vectors[last][0]
    counts, faults = Turns(), [0, 0, 0]
    for row in rows:
        counts.add(*(row[n] for n in ("low", "high", "first_turn", "last_turn", "distinct_turns", "illegal", "first_role", "last_role")))
        faults = [a + b for a, b in zip(faults, row["faults"])]
    same = lambda v: pa.array([v] * len(rows), pa.int64())
    out = table.select(["nil", "conv_id", "part", "seg"]).append_column("last", pa.array(ends[::-1], pa.int32()))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    for name, value in zip(names, [counts.gaps, *faults, counts.illegal, cost]):
        out = out.append_column(name, same(value))
    return out.append_column("final", pa.array([False] * (len(rows) - 1) + [True]))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each state before a segment the state after it."""
    keys = ["nil", "conv_id", "part", "seg"]
    for batch in batches:
        exits = [
            [trace(symbols, last, state)[1] for state in range(4)]
            for symbols, last in zip(batch.column("symbols").to_pylist(), batch.column("last").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keys), pa.array(exits, pa.list_(pa.int32()))], [*keys, "exits"])


def _entries(table: pa.Table) -> pa.Table:
    table = table.sort_by([("part", "ascending"), ("seg", "ascending")])
    state, entries = 0, []
    for exits in table.column("exits").to_pylist():
        entries.append(state)
        state = exits[state]
    return table.select(["nil", "conv_id", "part", "seg"]).append_column("entry", pa.array(entries, pa.int32()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["nil", "conv_id", "part", "seg"]
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            symbols, last, entry, final = (row.column(n)[0].as_py() for n in ("symbols", "last", "entry", "final"))
            rows = [(r["role"], r["text"], r["n"]) for r in row.column("rows").to_pylist()[0]]
            audit, state = trace(symbols, last, entry)
            audit += closing(state) if final else ""
            messages = repaired(rows, audit, entry)
            yield pa.RecordBatch.from_arrays(
                [*(row.column(n) for n in keys), pa.array([audit]), pa.array([digest_rows(messages) if messages else None], pa.binary())],
                [*keys, "audit", "body"],
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by conversation and place: one audit and digest each, streamed."""
    key, audit, sha, begun = None, [], hashlib.sha256(), False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [key.column(0), key.column(1), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["nil", "conv_id", "audit", "repaired_sha256"],
        )

    for batch in batches:
        for k in range(batch.num_rows):
            own = batch.slice(k, 1)
            if key is None or own.column(0)[0] != key.column(0)[0] or own.column(1)[0] != key.column(1)[0]:
                if key is not None:
                    yield row()
                key, audit, sha, begun = own, [], hashlib.sha256(), False
            audit.append(own.column("audit")[0].as_py())
            body = own.column("body")[0].as_py()
            if body is not None:
                sha.update((b"\n" if begun else b"") + body)
                begun = True
    if key is not None:
        yield row()


def repair(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per conversation: faults, cost, edits and the digest of the repaired rows (actions).

    ``rows``: conv_id, turn, role, text and a count n of equal rows, nulls as documented.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    order = ["conv_id", "turn", "role", "text"]
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = counted.select(*order, "n").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()
    found = settled(ordered.mapInArrow(_sorted_segments, f"conv_id {kind}, part int, seg int, {RESULT}, {ROWS}"), "conversations")
    done = found.filter("seg IS NULL").select("conv_id", *RESULTS)

    zero = F.col("conv_id").isNull().alias("nil")
    open_rows = found.filter("seg IS NOT NULL").select(zero, "conv_id", "part", "seg", "rows")
    segments = open_rows.withColumn("conv_id", _filled("conv_id", kind))
    place, keys = F.struct("part", "seg", "at"), [*KEY, "part", "seg"]
    each = segments.select(*keys, F.posexplode("rows").alias("at", "r")).select(*keys, "at", F.md5(F.concat("r.role", F.lit("\0"), "r.text").cast("binary")).alias("h"))
    first = settled(each.groupBy(*KEY, "h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "repeated_rows")
    again = each.join(first, [*KEY, "h"]).filter(place != F.col("first")).groupBy(*keys).agg(F.collect_list("at").alias("again"))

    key_schema = f"nil boolean, conv_id {kind}, part int, seg int"
    maps = segments.join(again, keys, "left").mapInArrow(_diagnose, f"{key_schema}, {MAPS}")
    maps = settled(maps, "segment_maps")
    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    ends = settled(maps.drop("symbols").groupBy(*KEY).applyInArrow(_ends, f"{key_schema}, last int, {counts}, final boolean"), "segment_ends")
    exits = maps.select(*keys, "symbols").join(ends.select(*keys, "last"), keys).mapInArrow(_exits, f"{key_schema}, exits array<int>")
    entries = exits.groupBy(*KEY).applyInArrow(_entries, f"{key_schema}, entry int")
    known = maps.select(*keys, "symbols").join(ends.select(*keys, "last", "final"), keys).join(entries, keys).join(segments, keys)
    pieces = known.mapInArrow(_pieces, f"{key_schema}, audit string, body binary")
    streams = pieces.repartition(*KEY).sortWithinPartitions(*keys).mapInArrow(_digests, f"nil boolean, conv_id {kind}, audit string, repaired_sha256 string")
    counted = ends.filter("final").select(*KEY, *[c.split()[0] for c in counts.split(", ")])
    closed = counted.join(streams, KEY).withColumn("conv_id", F.when(~F.col("nil"), F.col("conv_id"))).select("conv_id", *RESULTS)
    return done.unionByName(closed)


def _filled(name: str, kind: str) -> Column:
    """A null id as any value of its type; the column nil tells them apart."""
    return F.coalesce(F.col(name), F.lit("0").cast(kind))


def audited(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, with its rows damaged and repaired."""
    result = repair(damaged(conversations)).withColumnRenamed("conv_id", "_id")
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(result, ids["conv_id"].eqNullSafe(result["_id"]), "left")
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in RESULTS[:6]]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
