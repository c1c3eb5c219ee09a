"""Quality classifier by pairwise ranking (Bradley-Terry).

A document's score is w.x over features of its text; the chance that document a is
preferred to b is logistic(score a - score b). The weights are learned from preference
pairs (a labelled good, b labelled bad) by logistic loss on feature differences. A
document is accepted above a quantile of the training scores, the one with the fewest
wrong decisions. Scores are reported on a 0 to 1 scale on which that quantile is CUT.

The fit uses at most ``most`` labelled rows (by a hash of the id) and ``pairs`` pairs.
Labels, language, source and id are no features.

Cases: a null text is an empty one, and an empty one has a score like any other. Labels
that are null, or of only one kind, give no model: every document then scores 1 and is
kept. Repeated rows give repeated rows. Other columns are not read, or kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywatch.llm.common import filter_rows, map_rows, texts, training_labels

CUT = 0.3
MOST_LABELS, MOST_PAIRS = 20_000, 200_000
FEATURES = [
    "bytes", "words", "word_length", "upper", "digits", "marks", "bars", "shouts", "symbols", "stops", "commas",
    "capitals", "single", "distinct", "repeated", "lines", "line_words", "copied_lines", "marked_words",
]


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    for i, chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "|", "!?", "*#$%&@~^_+=<>{}[]\\/`", ".", ",;:"], 1):
        kind[[ord(c) for c in chars]] = i
    return kind


CLASSES = _classes()


def features(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES; linear in its length."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(data))
    _, upper, digits, bars, shouts, symbols, stops, commas = np.bincount(CLASSES[data], minlength=8) / n
    words = text.split()
    k = max(1, len(words))
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        np.log1p(len(data)), np.log1p(len(words)), min(40.0, len(data) / k), upper, digits,
        bars + shouts + symbols, min(0.1, bars), min(0.1, shouts), min(0.1, symbols), min(0.1, stops), min(0.1, commas),
        sum(w[0].isupper() for w in words) / k, sum(len(w) == 1 for w in words) / k,
        len(set(words)) / k, sum(map(eq, words, words[1:])) / k, np.log1p(len(lines)),
        np.log1p(k / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        sum(not w[-1].isalnum() for w in words) / k,
    ]


@dataclass(frozen=True)
class Ranking:
    """Weights on standardised features, the accepted quantile's score and the scale."""

    mean: list[float]
    spread: list[float]
    weights: list[float]
    threshold: float
    slope: float

    def scores(self, rows: list[str]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        x = (np.array([features(t) for t in rows]) - self.mean) / self.spread
        z = self.slope * (x @ np.array(self.weights) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = MOST_PAIRS, penalty: float = 1e-3) -> Ranking | None:
    """Learn from the features and labels of a bounded sample; None without both labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = (x - mean) / spread
    rng = np.random.default_rng(7)
    n = min(pairs, len(good) * len(bad))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / n + penalty * w
        curvature = (d * (p * (1 - p))[:, None]).T @ d / n + penalty * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    s = z @ w
    cuts = np.unique(np.quantile(s, np.linspace(0, 1, 401)))
    wrong = [int((s[y == 1] < c).sum() + (s[y == 0] >= c).sum()) for c in cuts]
    # Of equally good quantiles the lowest, which rejects least.
    threshold = float(cuts[int(np.argmin(wrong))])
    return Ranking(mean.tolist(), spread.tolist(), w.tolist(), threshold, float(1 / max(1e-9, s.std())) * 2)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MOST_LABELS, pairs: int = MOST_PAIRS) -> Ranking | None:
    """Fit on the labelled rows outside the held-out fold (one job; at most ``most`` rows to the driver)."""
    sample = F.broadcast(training_labels(labels, target, most))  # bounded by ``most``

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [features(t) for t in texts(batch.column(0))]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "_y"])

        return step

    known = docs.select("doc_id", "text").join(sample, "doc_id")
    rows = map_rows(known, ["text", "_y"], "x array<double>, _y int", make).toArrow()
    if not rows.num_rows:
        return None
    x = np.array(rows.column("x").to_pylist(), float)
    y = rows.column("_y").to_numpy()
    order = np.lexsort((*x.T, y))  # the same fit whatever the order of tasks
    return fit(x[order], y[order], pairs)


def score(docs: DataFrame, model: Ranking | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Score of every row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = texts(batch.column(1))
            s = model.scores(rows) if model else np.ones(len(rows))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=[key, "score"])

        return step

    return map_rows(docs, [key, text], f"{key} {docs.schema[key].dataType.simpleString()}, score double", make)


def accepted(docs: DataFrame, model: Ranking | None, text: str = "text") -> DataFrame:
    """Documents at or above the threshold, with all their columns."""

    def make():
        return lambda rows: (model.scores(rows) >= CUT).tolist() if model else [True] * len(rows)

    return filter_rows(docs, text, make)
