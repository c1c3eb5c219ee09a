"""Secrets: fixed patterns, and strings that look random to character Markov models.

Patterns, leftmost and non-overlapping per kind: ``assign`` (a credential name, a sign and
a value of at least six characters), ``access`` (key ids) and ``hex`` (24 or more digits).

The method adds ``random`` spans. Two first-order character models are trained on strings
taken from the corpus and labelled by where they stand: values that the patterns prove to
be keys are samples of random strings, words that occur more than once in all rows are
samples of ordinary identifiers. Runs of key characters outside the patterns' spans are judged from
LEAST_RUN characters on. The log-likelihood ratio of the two models is summed along a run;
stretches where the sum climbs by more than ``evidence`` plus the log of the run's length
(the number of places a stretch may start at) are secrets, so a key is found inside a path
or behind a name. A stretch is told together with the letters and digits it cuts through.

Everything is DataFrame operations, linear in the text. Positions are code points, the end
is exclusive.

Cases: a null or empty text has no spans. Without any proven key there is no model and no
``random`` span. Repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywatch.runtime import settled

# Fixed patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ["assign", "access", "hex", "random"]

# Characters of the models; any other one ends a run. Runs of LEAST_RUN are judged; words are
# samples of ordinary identifiers.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RUN, LEAST_PROOF = 12, 20
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}+"
PROOF = rf"[A-Za-z0-9+/_=-]{{{LEAST_PROOF},}}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,19}(?![A-Za-z0-9+/_=-])"
SPAN = "struct<start:int,end:int,kind:string,value:string>"
BLOCK, UNSEEN = 256, 0.1

# What spans of the patterns are overwritten with, and what is left of a span of one kind
# where another kind's span was overwritten.
GONE = "\x00"
MASKS = [ASSIGN, rf"{ACCESS}|AKIA[A-Z0-9]*(?=\x00)", rf"{HEX}|(?<=\x00)[0-9a-f]+|[0-9a-f]+(?=\x00)"]


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(sizes: Column) -> Column:
    """Running sums of an array. Blocks are summed first, so that appending stays cheap."""
    none = F.array().cast("array<int>")

    def sums(values: Column) -> Column:
        return F.aggregate(
            values, F.struct(F.lit(0).alias("at"), none.alias("sums")),
            lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"] + x)).alias("sums")),
        )

    def joined(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("parts"))
        return F.flatten(F.aggregate(
            blocks, start,
            lambda s, b: F.struct(
                (s["at"] + b["at"]).alias("at"),
                F.concat(s["parts"], F.array(F.transform(b["sums"], lambda x: x + s["at"]))).alias("parts"),
            ),
            lambda s: s["parts"],
        ))

    def whole(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))
        return joined(F.transform(starts, lambda i: sums(F.slice(values, i, BLOCK))))

    return _with(sizes, lambda values: F.when(F.size(values) > 0, whole(values)).otherwise(none))


def _pieces(text: Column, pattern: str) -> Column:
    """Array of (gap, value): each match and what stands before it; the last value is null.

    ``split`` returns what lies between the matches that ``regexp_extract_all`` returns.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.split(text, pattern, -1), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("value")))


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, value) of all matches; positions are running sums of lengths."""
    steps = F.transform(
        F.filter(_pieces(text, pattern), lambda s: s["value"].isNotNull()),
        lambda s: F.struct((F.length(s["gap"]) + F.length(s["value"])).alias("size"), s["value"].alias("value")),
    )
    spans = _with(steps, lambda all_: F.zip_with(
        all_, _running(F.transform(all_, lambda s: s["size"])),
        lambda s, end: F.struct(
            (end - F.length(s["value"])).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")
        ),
    ))
    return F.when(text.rlike(pattern), spans).otherwise(F.array()).cast(f"array<{SPAN}>")


def _masked(text: Column) -> Column:
    """The text with every match of the patterns overwritten, all other characters where they were."""

    def once(pattern: str) -> Callable[[Column], Column]:
        def mask(whole: Column) -> Column:
            parts = F.transform(
                _pieces(whole, pattern),
                lambda s: F.concat(s["gap"], F.coalesce(F.repeat(F.lit(GONE), F.length(s["value"])), F.lit(""))),
            )
            return F.when(whole.rlike(pattern), F.array_join(parts, "")).otherwise(whole)

        return mask

    for pattern in MASKS:
        text = _with(text, once(pattern))
    return text


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns."""
    assign = F.filter(
        _spans(text, ASSIGN, "assign"),
        lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_VALUE,
    )
    return F.concat(assign, _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))


def _cells(value: Column) -> Column:
    """Cell of each pair of neighbouring characters in the models' table, from 1."""
    codes = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    return _with(codes, lambda all_: F.zip_with(
        F.slice(all_, 1, F.size(all_) - 1), F.slice(all_, 2, F.size(all_) - 1), lambda a, b: a * len(ALPHABET) + b + 1
    ))


def _transitions(samples: DataFrame, least: int = 1) -> list[list[int]]:
    """Counts of neighbouring characters in distinct strings that occur ``least`` times: at most ALPHABET squared rows."""
    known = samples.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    cells = known.select(F.explode(_cells(F.col("value"))).alias("cell"))
    n = len(ALPHABET)
    table = [[0] * n for _ in range(n)]
    for row in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        table[(row["cell"] - 1) // n][(row["cell"] - 1) % n] = row["n"]
    return table


def log_ratios(random: list[list[int]], ordinary: list[list[int]]) -> list[float]:
    """log P(b|a) under the first model less that under the second, one number per pair (a, b).

    Each model leans on the overall frequency of b as strongly as a is followed by many
    different characters, so a few hundred keys are enough for the random one.
    """
    n = len(ALPHABET)

    def logs(table: list[list[int]]) -> list[float]:
        total = sum(map(sum, table))
        overall = [(sum(row[b] for row in table) + UNSEEN) / (total + UNSEEN * n) for b in range(n)]
        out = []
        for row in table:
            lean = sum(c > 0 for c in row) + 1
            out += [log((c + lean * p) / (sum(row) + lean)) for c, p in zip(row, overall)]
        return out

    return [a - b for a, b in zip(logs(random), logs(ordinary))]


def train(docs: DataFrame, found: DataFrame, text: str = "text") -> list[float] | None:
    """The models' table (actions), from the proven keys and the words that all rows hold more than once."""
    spans = found.select(F.explode("base").alias("s")).select("s.*")
    value = F.when(F.col("kind") == "assign", F.regexp_extract("value", ASSIGN, 2)).otherwise(F.col("value"))
    keys = spans.select(F.regexp_extract(value, PROOF, 0).alias("value")).filter("value <> ''")
    random = _transitions(keys)
    if not any(map(any, random)):
        return None
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(IDENTIFIER), F.lit(0))).alias("value"))
    return log_ratios(random, _transitions(words, 2))


def stretches(value: Column, table: list[float], evidence: float) -> Column:
    """Array of (start, end) of the stretches of a run that look random, in characters of the run.

    One pass: the sum of ratios starts anew where it is not positive, and a stretch ends
    where the sum has fallen from its peak by as much as a stretch needs.
    """
    numbers = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    found = "array<struct<start:int,end:int>>"
    need = F.log(F.length(value).cast("double")) + evidence
    # The last step closes what is open.
    ratios = F.concat(F.transform(_cells(value), lambda cell: F.element_at(numbers, cell.cast("int"))), F.array(F.lit(-1e9)))
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"),
        need.alias("need"), F.array().cast(found).alias("found"),
    )

    def step(s: Column, x: Column) -> Column:
        at, total = s["at"] + 1, s["sum"] + x
        hit = F.array(F.struct(s["first"].alias("start"), s["last"].alias("end")))
        closed = F.struct(
            at.alias("at"), at.alias("first"), at.alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), s["need"].alias("need"),
            F.when(s["peak"] > s["need"], F.concat(s["found"], hit)).otherwise(s["found"]).cast(found).alias("found"),
        )
        opened = F.struct(
            at.alias("at"), s["first"].alias("first"), F.when(total > s["peak"], at + 1).otherwise(s["last"]).alias("last"),
            total.alias("sum"), F.greatest(total, s["peak"]).alias("peak"), s["need"].alias("need"), s["found"].alias("found"),
        )
        return F.when((total <= 0) | (total < s["peak"] - s["need"]), closed).otherwise(opened)

    return F.aggregate(ratios, start, step, lambda s: s["found"])


def _widened(run: Column, hit: Column) -> Column:
    """A stretch with the letters and digits it cuts through, as a span of the text."""
    value = run["value"]
    body = F.substring(value, hit["start"] + 1, hit["end"] - hit["start"])
    # A sign that ties a key to a path is not part of it; at the border of the run it may be.
    lead = F.when(hit["start"] > 0, F.length(F.regexp_extract(body, r"^[+/_=-]++", 0))).otherwise(0)
    trail = F.when(hit["end"] < F.length(value), F.length(F.regexp_extract(body, r"(?<![+/_=-])[+/_=-]++$", 0))).otherwise(0)
    start, end = hit["start"] + lead, hit["end"] - trail
    before = F.regexp_extract(F.substring(value, F.lit(1), start), r"(?<![A-Za-z0-9])[A-Za-z0-9]++$", 0)
    behind = F.regexp_extract(F.substring(value, end + 1, F.length(value)), r"^[A-Za-z0-9]++", 0)
    first, last = start - F.length(before), end + F.length(behind)
    return F.struct(
        (run["start"] + first).alias("start"), (run["start"] + last).alias("end"), F.lit("random").alias("kind"),
        F.substring(value, first + 1, last - first).alias("value"),
    )


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", evidence: float = 6.0) -> DataFrame:
    """Per row the spans of the patterns (``base``) and those that the models add (``added``)."""
    body = F.coalesce(F.col(text), F.lit(""))
    based = docs.select(F.col(key).alias("doc_id"), base_spans(body).alias("base"), body.alias("_body"))
    left = F.when(F.size("base") > 0, _masked(F.col("_body"))).otherwise(F.col("_body"))
    runs = _with(left, lambda whole: _spans(whole, RUN, "random"))
    found = settled(based.select("doc_id", "base", runs.alias("runs")), "spans")
    table = train(docs, found, text)
    if table is None:
        return found.select("doc_id", "base", F.lit(None).cast(f"array<{SPAN}>").alias("added"))
    spans = F.flatten(F.transform("runs", lambda run: F.transform(
        stretches(run["value"], table, evidence), lambda hit: _widened(run, hit)
    )))
    # Two stretches of one word are one span after widening.
    added = F.array_distinct(F.filter(spans, lambda s: s["end"] - s["start"] >= LEAST_RUN))
    return found.select("doc_id", "base", added.cast(f"array<{SPAN}>").alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind as listed."""
    order = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.lit(KINDS), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
    ))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def all_spans() -> Column:
    """Spans of a row of ``scan``, those of the patterns and those added."""
    return F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
