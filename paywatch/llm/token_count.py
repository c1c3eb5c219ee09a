"""Token counts by prefix dynamic programming.

The tokens of a text are the tokens of its pieces (the pattern's matches), so the work is
per piece. Within a piece, byte-pair encoding has a property that makes a linear pass
enough: for every prefix there is exactly one token t that can end it, the one that the
merges leave beside the last token of the prefix without t. With ``last[i]`` and
``count[i]`` for each prefix, ``count[i] = count[i - len(t)] + 1``. That stores the exact
count at every prefix; budgets and cuts read it and encode nothing again.

Special strings of the vocabulary count as one token each and split the text first.

Cases: a null or empty text has no tokens and no bytes. Repeated rows give repeated rows.
Other columns are not read, so their names cannot clash. Texts are processed whole, in
memory that is linear in the longest single text.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from paywatch.llm.common import map_rows, texts

# Byte to character map of byte-level vocabularies: printable bytes stand for themselves,
# the others for the code points from 256 on, in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
# Code points below this one fall into the same classes in both regex libraries (tested).
SHARED_CLASSES = "՘"
CACHED_PIECES, CACHED_ARRAYS = 400_000, 20_000
SHORT_PIECE = 64
LATE, WHOLE = 1 << 60, (-1, -1, -1)


def byte_of_character() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounts:
    """Token counts of all prefixes, for a byte-level vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = byte_of_character()
        # Tokens as strings of bytes (latin-1), which is what the automaton reads.
        raw = lambda token: "".join(chr(back[c]) for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.width = max(self.ids.values()) + 1
        self.rank: dict[int, int] = {}
        self.made: list[tuple[int, int, int]] = [WHOLE] * self.width
        self._merged: list[int] = []
        for i, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            a, b, both = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank.setdefault(a * self.width + b, i)
            self._merged.append(both)
            if self.made[both] is WHOLE:
                self.made[both] = (i, a, b)
        self.endings = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.endings.add_word(token, (len(token), i))
        self.endings.make_automaton()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pattern = regex.compile(pattern)
        self.beyond = regex.compile(f"[{SHARED_CLASSES}-\U0010ffff]")
        self.path = path
        self._splitter = None
        self._adjacent: dict[int, bool] = {}
        self._first: set[int] = set()
        self._counts: dict[str, list[int]] = {}
        self._whole: dict[str, int] = {}

    # --- one piece

    def reached(self, token: str) -> bool:
        """Whether the merges make this token out of its own bytes."""
        parts = [self.ids[c] for c in token]
        while len(parts) > 1:
            ranks = [self.rank.get(a * self.width + b, LATE) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == LATE:
                return False
            i = ranks.index(best)
            parts[i : i + 2] = [self._merged[best]]
        return parts[0] == self.ids[token]

    def stays(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        Undo the later of the two tokens' last merges, again and again: at no point may the
        pair across the border have come before the merge just undone. Equal ranks go to
        the leftmost pair, so the border wins against the right token only.
        """
        rank, made, width, limit = self.rank, self.made, self.width, LATE
        while True:
            if rank.get(left * width + right, LATE) < limit:
                return False
            a, b = made[left], made[right]
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            elif b[0] >= 0:
                limit, right = b[0] + 1, b[1]
            else:
                return True

    def prefix_counts(self, piece: str) -> list[int]:
        """Tokens of each prefix of the piece's bytes, from the empty one to the whole."""
        known = self._counts.get(piece)
        if known is None:
            if len(self._counts) > CACHED_ARRAYS:
                self._counts.clear()
            known = self._pass(piece)
            if len(known) <= 1024:
                self._counts[piece] = known
        return known

    def _pass(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last, count = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        adjacent, width = self._adjacent, self.width
        for at, (length, token) in self.endings.iter(data):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                pair = last[start] * width + token
                fits = adjacent.get(pair)
                if fits is None:
                    if len(adjacent) > CACHED_PIECES:
                        adjacent.clear()
                    fits = adjacent[pair] = self.stays(last[start], token) and self.reached(data[start:end])
                if not fits:
                    continue
            elif token not in self._first and not self.reached(data[:end]):
                continue
            else:
                self._first.add(token)
            last[end], count[end] = token, count[start] + 1
        return count

    def size(self, piece: str) -> int:
        known = self._whole.get(piece)
        if known is None:
            if len(self._whole) > CACHED_PIECES:
                self._whole.clear()
            known = self._whole[piece] = self._pass(piece)[-1]
        return known

    # --- a text

    def pieces(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.pattern.findall(text)
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def sections(self, text: str) -> list[tuple[list[str], bool]]:
        """Pieces between special strings; the flag tells a special string."""
        if self.cut is None or not (hits := list(self.cut.finditer(text))):
            return [(self.pieces(text), False)]
        out, at = [], 0
        for hit in hits:
            out += [(self.pieces(text[at : hit.start()]), False), ([hit.group()], True)]
            at = hit.end()
        return [*out, (self.pieces(text[at:]), False)]

    def sizes(self, text: str) -> list[tuple[list[str], list[int]]]:
        """Pieces and their tokens, section by section."""
        out = []
        for pieces, special in self.sections(text):
            if special:
                out.append((pieces, [1]))
                continue
            sizes = list(map(self._whole.get, pieces))
            out.append((pieces, sizes if None not in sizes else list(map(self.size, pieces))))
        return out

    def count(self, text: str) -> int:
        return sum(sum(sizes) for _, sizes in self.sizes(text))

    def boundaries(
        self, text: str, sizes: list[tuple[list[str], list[int]]] | None = None, first: int | None = None
    ) -> tuple[list[int], list[int]]:
        """End of every piece in code points, and the tokens up to there; of the first pieces only if asked."""
        known = self.sizes(text) if sizes is None else sizes
        ends = accumulate(len(p) for pieces, _ in known for p in pieces)
        return list(islice(ends, first)), list(islice(accumulate(n for _, size in known for n in size), first))

    def count_at(self, text: str, at: int, known: tuple[list[int], list[int]]) -> int:
        """Tokens of the first ``at`` code points, from the stored counts."""
        ends, counts = known
        k = bisect_right(ends, at)
        start = ends[k - 1] if k else 0
        # Cutting can join white space into one piece: go back to where its run begins.
        while k and text[start - 1].isspace():
            k -= 1
            start = ends[k - 1] if k else 0
        base = counts[k - 1] if k else 0
        return base + sum(map(self.size, self.pieces(text[start:at])))

    def longest_prefix(self, text: str, budget: int, known: tuple[list[int], list[int]]) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        ends, counts = known
        if not counts or counts[-1] <= budget:
            return len(text)
        k = bisect_right(counts, budget)
        start, end = ends[k - 1] if k else 0, ends[k]  # every piece has a token: budget + 1 pieces are enough
        stop = end
        while stop < len(text) and text[end - 1].isspace() and text[stop].isspace():
            stop += 1
        for at in range(stop, start if end - start <= SHORT_PIECE else end, -1):
            if self.count_at(text, at, known) <= budget:
                return at
        if end - start <= SHORT_PIECE:
            return start
        # A prefix of a long piece is one piece, whose counts a single pass gives.
        left = budget - (counts[k - 1] if k else 0)
        within, size, best = self._pass(text[start:end]), 0, start
        for at in range(start, end):
            size += len(text[at].encode("utf-8", "surrogatepass"))
            if within[size] <= left:
                best = at + 1
        return best


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, budget: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: bytes, tokens, whether they pass the budget, and the bytes of the longest
    prefix within it."""

    def make():
        counter = PrefixCounts(vocabulary, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            size, tokens, within = [], [], []
            for t in texts(batch.column(1)):
                n = len(t.encode("utf-8", "surrogatepass"))
                known = counter.sizes(t)
                count = sum(sum(sizes) for _, sizes in known)
                size.append(n)
                tokens.append(count)
                if count <= budget:
                    within.append(n)
                else:
                    cut = counter.longest_prefix(t, budget, counter.boundaries(t, known, budget + 1))
                    within.append(len(t[:cut].encode("utf-8", "surrogatepass")))
            over = [c > budget for c in tokens]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array(over, pa.bool_()), pa.array(within, pa.int64())],
                names=[key, "n_bytes", "n_tokens", "over_limit", "bytes_within_limit"],
            )

        return step

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean, bytes_within_limit long"
    return map_rows(docs, [key, text], schema, make)


def prefix_table(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row the stored counts: piece ends in code points and the tokens up to each."""

    def make():
        counter = PrefixCounts(vocabulary, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            known = [counter.boundaries(t) for t in texts(batch.column(1))]
            lists = [pa.array([k[i] for k in known], pa.list_(pa.int32())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[key, "ends", "counts"])

        return step

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], f"{key} {kind}, ends array<int>, counts array<int>", make)


def truncation_points(ends: Sequence[int], counts: Sequence[int], budget: int) -> int:
    """Last piece end within the budget, from a row of ``prefix_table`` alone."""
    k = bisect_right(counts, budget)
    return ends[k - 1] if k else 0
