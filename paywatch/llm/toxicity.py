"""Toxic passages by maximum-scoring segments.

1. Tokens. Of every token the documents that hold it are counted: toxic ones and clean
   ones among the labelled rows, and all documents, which give the Dirichlet prior. Its
   log-odds between the labels, with that prior added to both counts, are kept when they
   are significant; at most ``most_tokens`` tokens, by significance, make the lexicon.
2. Segments. A token's score is its log-odds, other tokens have a negative score. One
   linear scan (Ruzzo and Tompa 1999) finds all maximal segments of a text.
3. Extreme values. For scores whose mean is negative, the largest segment score of clean
   text follows a Gumbel law: the number of segments scoring S or more by chance in n
   tokens is E = K n exp(-lambda S). lambda solves sum p(w) exp(lambda s(w)) = 1 over the
   clean tokens, K is fitted to the clean labelled rows. Segments with E <= ``chance`` are
   reported; a document's evidence is the sum of lambda S - ln(K n) over them.
4. Score. A logistic curve through the evidence of the labelled rows (at most
   ``most_labels``) turns it into a chance.

Counts cover all documents; labels of the held-out fold are never read.

Cases: a null text is an empty one; it has no segment. Without toxic or without clean
labels nothing is known and every score is 0. Repeated rows give repeated rows; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywatch.llm.common import held_out, map_rows, texts, training_labels
from paywatch.runtime import settled

MOST_LABELS, MOST_TOKENS = 20_000, 50_000
WORD = r"\p{L}+"


@dataclass(frozen=True)
class Lexicon:
    """Scores of the significant tokens, the score of all others, and the Gumbel law."""

    scores: dict[str, float]
    other: float
    decay: float
    log_k: float
    chance: float

    def segments(self, text: str) -> tuple[list[tuple[float, int, int]], int]:
        """Significant segments (normalised score, first and last token) and the number of tokens."""
        words = TOKEN.findall(text.lower())
        if not words:
            return [], 0
        scores = self.scores
        if scores.keys().isdisjoint(words):
            return [], len(words)  # no positive score, no segment
        found = maximal_segments([scores.get(w, self.other) for w in words])
        base = self.log_k + log(len(words))
        rated = [(self.decay * s - base, i, j) for s, i, j in found]
        return [r for r in rated if r[0] >= -log(self.chance)], len(words)


TOKEN = regex.compile(WORD)


def maximal_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last), in one pass.

    Each candidate keeps the running total before and after it. A new one is merged with
    the nearest earlier candidate that began lower, unless that one also ended higher.
    """
    starts: list[int] = []
    ends: list[int] = []
    left: list[float] = []
    right: list[float] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        a, b, first = total, total + s, i
        total = b
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= a:
                # Nothing that comes later can be merged with what lies above this one.
                j -= 1
            if j < 0 or right[j] >= b:
                break
            a, first = left[j], starts[j]
            del left[j:], right[j:], starts[j:], ends[j:]
        left.append(a)
        right.append(b)
        starts.append(first)
        ends.append(i)
    return [(r - a, i, j) for a, r, i, j in zip(left, right, starts, ends)]


def token_counts(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """Per token: all documents that hold it, and the labelled toxic and clean ones among them."""
    sample = F.broadcast(training_labels(labels, target, most))  # bounded by ``most``
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    tokens = docs.select("doc_id", "text").join(sample, "doc_id", "left").select("_y", F.explode(words).alias("token"))
    return tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count(F.when(F.col("_y") == 1, 1)).alias("toxic"),
        F.count(F.when(F.col("_y") == 0, 1)).alias("clean"),
    )


def significant_tokens(counts: DataFrame, most: int, prior: float, least_z: float, least_rows: int) -> tuple[dict[str, tuple[float, float]], tuple]:
    """(log-odds, share among clean tokens) of the significant tokens, at most ``most`` of them.

    The log-odds are their lower bound, ``least_z`` standard errors below the estimate.
    """
    total = counts.agg(F.sum("documents"), F.sum("toxic"), F.sum("clean")).first()
    if not total[0] or not total[1] or not total[2]:
        return {}, total
    share = F.col("documents") / F.lit(total[0])
    a, b = F.col("toxic") + prior * share, F.col("clean") + prior * share
    odds = F.log(a / (total[1] + prior - a)) - F.log(b / (total[2] + prior - b))
    ranked = (
        counts.filter(F.col("toxic") >= least_rows)
        .select("token", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"), (b / (total[2] + prior)).alias("share"))
        .filter(F.col("z") > least_z)
        .withColumn("odds", F.col("odds") * (1 - least_z / F.col("z")))
        .orderBy(F.desc("z"), "token")
        .limit(most)
    )
    return {r["token"]: (r["odds"], r["share"]) for r in ranked.collect()}, total


def solve_decay(scores: list[float], shares: list[float], other: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1."""
    s, p = np.array([*scores, other]), np.array([*shares, max(1e-9, 1 - sum(shares))])
    if (s * p).sum() >= 0:
        raise ValueError("the mean score of clean text must be negative")
    low, high = 0.0, 1.0
    while (p * np.exp(high * s)).sum() < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    return high


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    bias: float
    slope: float

    def score(self, evidence: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.bias) + F.lit(self.slope) * F.log1p(evidence))))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton steps with a small penalty."""
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (p - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(
    docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = MOST_LABELS, most_tokens: int = MOST_TOKENS,
    prior: float = 10_000.0, least_z: float = 2.0, least_rows: int = 2, other: float = -0.2, chance: float = 0.05,
) -> Model | None:
    """Lexicon, Gumbel law and logistic curve (four jobs; bounded rows to the driver)."""
    counts = settled(token_counts(docs, labels, target, most), "token_counts")  # read twice
    tokens, _ = significant_tokens(counts, most_tokens, prior, least_z, least_rows)
    if not tokens:
        return None
    mean = sum(o * p for o, p in tokens.values())
    # Frequent tokens must not lift the mean score above zero.
    other = min(other, -2 * mean / max(1e-9, 1 - sum(p for _, p in tokens.values())))
    decay = solve_decay([o for o, _ in tokens.values()], [p for _, p in tokens.values()], other)
    raw = Lexicon({t: o for t, (o, _) in tokens.items()}, other, decay, 0.0, float("inf"))
    sample = F.broadcast(training_labels(labels, target, most))  # bounded by ``most``

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[r for r, _, _ in raw.segments(t)[0]] for t in texts(batch.column(0))]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "_y"])

        return step

    known = docs.select("doc_id", "text").join(sample, "doc_id")
    rows = map_rows(known, ["text", "_y"], "x array<double>, _y int", make).toArrow()
    found, y = rows.column("x").to_pylist(), rows.column("_y").to_numpy()
    clean = [max(f, default=-np.inf) for f, label in zip(found, y) if label == 0]
    reached = (sum(c > 0 for c in clean) + 0.5) / (len(clean) + 1)
    log_k = log(-log(1 - reached))
    evidence = np.array([sum(r - log_k for r in f if r - log_k >= -log(chance)) for f in found])
    order = np.lexsort((y, evidence))  # the same fit whatever the order of tasks
    bias, slope = logistic(np.log1p(evidence[order]), y[order].astype(float))
    return Model(Lexicon(raw.scores, other, decay, log_k, chance), bias, slope)


def passages(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every significant passage: first and last token, -ln of the expected number by chance, the words."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for k, t in enumerate(texts(batch.column(1))):
                words = None
                for rating, i, j in model.lexicon.segments(t)[0]:
                    words = words or TOKEN.findall(t.lower())
                    out.append((k, i, j, rating, " ".join(words[i : j + 1])))
            rows = list(zip(*out)) or [[], [], [], [], []]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[0], pa.int32())), pa.array(rows[1], pa.int32()),
                 pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.float64()), pa.array(rows[4], pa.string())],
                names=[key, "first", "last", "rating", "passage"],
            )

        return step

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], f"{key} {kind}, first int, last int, rating double, passage string", make)


def score(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row the number of significant passages, the best rating and the score."""
    if model is None:
        return docs.select(key, F.lit(0).alias("passages"), F.lit(0.0).alias("top_rating"), F.lit(0.0).alias("score"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[r for r, _, _ in model.lexicon.segments(t)[0]] for t in texts(batch.column(1))]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int32()),
                 pa.array([max(f, default=0.0) for f in found], pa.float64()),
                 pa.array([sum(f) for f in found], pa.float64())],
                names=[key, "passages", "top_rating", "evidence"],
            )

        return step

    kind = docs.schema[key].dataType.simpleString()
    rows = map_rows(docs, [key, text], f"{key} {kind}, passages int, top_rating double, evidence double", make)
    return rows.select(key, "passages", "top_rating", model.score(F.col("evidence")).alias("score"))
