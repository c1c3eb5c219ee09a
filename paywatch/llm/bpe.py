"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Encoding works on the distinct words (matches of the pattern) of a slice of rows. Their
bytes become (word, position, token) rows in the partition's own DuckDB. A recursive query
joins neighbouring rows with the merge table and contracts, in every word at once, the
leftmost pair of minimum rank, until no pair is left. Decoding joins token rows with the
vocabulary and aggregates the pieces in order.

The merge table lists every pair of tokens whose bytes together are a token, which is the
rule of rank files: the rank of a pair is the id of its union.

A word of n bytes takes up to n rounds over n rows, so words over LONG_WORD bytes (runs
without any break) are contracted by the same rule with a heap instead; see README.

A Python worker keeps its codec, and with it the words it has met, for all its tasks. Words
that were not met again for a while go (two generations), not the frequent ones. What a
query or a slice needed beside that is given back: two such workers share an executor with
a JVM whose heap the stages before have filled.

Cases: a null or empty text has no tokens. Repeated rows give repeated rows, other columns
are not read. Texts are processed whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import tempfile
import types

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from paywatch.llm.common import map_rows, texts

LONG_WORD = 1024  # the positions that CONTRACT packs beside a rank
# Words that a worker remembers, at about 130 bytes each.
CACHED_WORDS = 400_000
# Rows that one recursive query makes, about: a word of n bytes makes n (n + 1) / 2 at most.
STEP_ROWS = 500_000
# Token rows that one decoding query orders.
DECODED_ROWS = 250_000

CONTRACT = """
WITH RECURSIVE step(round, word, pos, tok) AS (
    SELECT 0, word, pos, tok FROM start
    UNION ALL
    SELECT s.round + 1, s.word, s.pos - (s.pos > b.pos)::INT, CASE WHEN s.pos = b.pos THEN b.merged ELSE s.tok END
    FROM step s JOIN (
        SELECT l.word, min(m.merged * 1024 + l.pos) AS best, (best // 1024)::INT AS merged, (best % 1024)::INT AS pos
        FROM step l JOIN step r ON r.word = l.word AND r.pos = l.pos + 1
        JOIN merges m ON m.a = l.tok AND m.b = r.tok
        GROUP BY l.word
    ) b ON b.word = s.word
    WHERE s.pos <> b.pos + 1
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round)
GROUP BY word
"""

# One ordered aggregate for many texts; an id that is no token stands for nothing.
DECODE = "SELECT list(piece ORDER BY pos) AS pieces FROM tokens LEFT JOIN vocabulary USING (tok)"


class Codec:
    """A rank file in a DuckDB of its own, for one partition."""

    def __init__(self, path: str, pattern: str, long_word: int = LONG_WORD):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.long_word = long_word
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.words: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        # The working folder of a worker is its own; nothing in it is read by another one.
        self.folder = tempfile.TemporaryDirectory()
        # Freed memory goes back to the system at once, not from 128 MB on.
        self.db = duckdb.connect(config={
            "threads": 1, "memory_limit": "200MB", "temp_directory": self.folder.name,
            "allocator_flush_threshold": "1MB", "allocator_bulk_deallocation_flush_threshold": "1MB",
        })
        ids = pa.array(self.ranks.values(), pa.int32())
        self._load("vocabulary", pa.table({"tok": ids, "piece": pa.array(self.ranks, pa.binary())}))
        splits = [
            (self.ranks[t[:i]], self.ranks[t[i:]], n)
            for t, n in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        table = np.array(splits, np.int32).reshape(-1, 3)
        self._load("merges", pa.table({"a": table[:, 0], "b": table[:, 1], "merged": table[:, 2].astype(np.int64)}))

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word, as little-endian 32-bit integers."""
        data = [w.encode("utf-8", "replace") for w in words]
        out = {w: self._long(d) for w, d in zip(words, data) if len(d) > self.long_word}
        short = [i for i, d in enumerate(data) if len(d) <= self.long_word]
        if short:
            sizes = np.array([len(data[i]) for i in short])
            ends = sizes.cumsum()
            start = pa.table({
                "word": np.repeat(np.array(short, np.int32), sizes),
                "pos": (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32),
                "tok": self.byte[np.frombuffer(b"".join(data[i] for i in short), np.uint8)],
            })
            self.db.register("start", start)
            found = self.db.sql(CONTRACT).to_arrow_table().combine_chunks()
            self.db.unregister("start")
            lists = found.column("ids").combine_chunks()
            bounds = lists.offsets.to_numpy() * 4
            flat = np.asarray(lists.values).astype("<u4").tobytes()
            for k, i in enumerate(found.column("word").to_pylist()):
                out[words[i]] = flat[bounds[k] : bounds[k + 1]]
        return out

    def _parts(self, words: list[str]) -> list[list[str]]:
        """Words cut into lists for one query each, so that long words do not add up in memory."""
        size = np.array([len(w.encode("utf-8", "replace")) for w in words], np.int64)
        made = np.where(size > self.long_word, 0, size * (size + 1) // 2).cumsum() // STEP_ROWS
        cuts = [0, *(np.flatnonzero(np.diff(made)) + 1).tolist(), len(words)]
        return [words[a:b] for a, b in zip(cuts, cuts[1:])]

    def _long(self, data: bytes) -> bytes:
        """The same contraction with a heap of pairs, ordered by rank, then position."""
        parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        after, before = list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if both in self.ranks:
                    heapq.heappush(heap, (self.ranks[both], i, both))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([self.ranks[p] for p in parts if p is not None], "<u4").tobytes()

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        pa.default_memory_pool().release_unused()
        met: dict[str, str] = {}
        same = met.setdefault  # a word that comes again is held once
        split = [list(map(same, words, words)) for words in map(self.pattern.findall, rows)]
        if len(self.words) > CACHED_WORDS // 2:
            self.earlier, self.words = self.words, {}
        new = set(met).difference(self.words)
        again = new.intersection(self.earlier)
        self.words.update((w, self.earlier[w]) for w in again)
        for part in self._parts(list(new - again)):
            self.words.update(self.encode_words(part))
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """Bytes that the ids stand for."""
        pa.default_memory_pool().release_unused()
        out, at = [b""] * len(rows), 0
        while at < len(rows):
            stop, n = at, 0
            while stop < len(rows) and (n == 0 or n + len(rows[stop]) // 4 <= DECODED_ROWS):
                n += len(rows[stop]) // 4
                stop += 1
            if n:
                sizes = [len(r) // 4 for r in rows[at:stop]]
                self.db.register("tokens", pa.table({
                    "pos": np.arange(n, dtype=np.int32), "tok": np.frombuffer(b"".join(rows[at:stop]), "<u4").astype(np.int32),
                }))
                found = self.db.sql(DECODE).to_arrow_table().combine_chunks()
                self.db.unregister("tokens")
                # The pieces lie side by side, so a text is one slice of their bytes.
                data = found.column("pieces").combine_chunks().values
                ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset :]
                joined, bounds = memoryview(data.buffers()[2]), ends[np.append(0, np.cumsum(sizes))]
                out[at:stop] = [bytes(joined[a:b]) for a, b in zip(bounds, bounds[1:])]
            at = stop
        return out


def kept_codec(path: str, pattern: str) -> Codec:
    """The codec of this Python worker, which outlives its tasks.

    Functions reach a worker by value, with a module of their own each time, so the codecs
    are kept under a name among the interpreter's modules.
    """
    kept = sys.modules.setdefault("_paywatch_codecs", types.ModuleType("_paywatch_codecs")).__dict__
    if (path, pattern) not in kept:
        kept[path, pattern] = Codec(path, pattern)
    return kept[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row the ids, in order."""

    def make():
        codec = kept_codec(vocabulary, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.frombuffer(r, "<u4").astype(np.int32) for r in codec.encode(texts(batch.column(1)))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

        return step

    return map_rows(docs, [key, text], f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>", make)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Per row of ids the text; bytes that are no UTF-8 become the replacement character."""

    def make():
        codec = kept_codec(vocabulary, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [np.array(r or [], "<u4").tobytes() for r in batch.column(1).to_pylist()]
            text = [b.decode("utf-8", "replace") for b in codec.decode(rows)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=[key, "text"])

        return step

    return map_rows(encoded, [key, "ids"], f"{key} {encoded.schema[key].dataType.simpleString()}, text string", make)


def round_trip(
    docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id", keep_ids: bool = False,
) -> DataFrame:
    """Per row: tokens, hash of the ids, hash of what they decode to, whether that is the
    text, and the ids themselves if asked for."""

    def make():
        codec = kept_codec(vocabulary, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = texts(batch.column(1))
            ids = codec.encode(rows)
            back = codec.decode(ids)
            sha = lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())
            same = pa.array([b == t.encode("utf-8", "replace") for b, t in zip(back, rows)], pa.bool_())
            columns = [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), sha(ids), sha(back), same]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "same_text"]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        return step

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean"
    return map_rows(docs, [key, text], schema + ", ids array<int>" * keep_ids, make)
