"""Suffix dedup, conversation repair and hard negatives against plain versions."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from paywatch.llm import conversation_repair, hard_negatives, queries, suffix_dedup
from paywatch.llm.common import table

# --- 11 suffix dedup


def repeated_texts(rng, count, letters="ab ", most=90):
    base = ["".join(rng.choice(letters) for _ in range(most)) for _ in range(4)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(0, 3)):
            text, at = rng.choice(base), rng.randint(0, 40)
            parts.append(text[at : at + rng.randint(5, 50)] + rng.choice(["", "é", "x"]))
        texts.append("".join(parts))
    return texts


def windows_that_repeat(strings, length):
    seen, out = set(), set()
    for i, s in enumerate(strings):
        for p in range(len(s) - length + 1):
            if s[p : p + length] in seen:
                out.add((i, p))
            seen.add(s[p : p + length])
    return out


@pytest.mark.parametrize("length", [10, 12, 25])
def test_merged_transforms(length):
    rng = random.Random(length)
    for shards in (1, 2, 3) * 10:
        strings = [t.encode() for t in repeated_texts(rng, rng.randint(1, 14)) if len(t) >= length] or [b"a" * 40]
        pieces, meta = [], []
        for k in range(shards):
            own = list(range(k, len(strings), shards))
            if own:
                symbols, ends, _ = suffix_dedup.transform([strings[i] for i in own], np.zeros(len(own), np.int64))
                pieces.append(symbols)
                meta += [own[e] for e in ends]
        string, place, shared, block = suffix_dedup.repeated_intervals(pieces, length)
        rows = [(b, meta[s], len(strings[meta[s]]) - p) for s, p, b in zip(string, place, block)]
        first, got = {}, set()
        for b, i, p in sorted(r for r, whole in zip(rows, place >= length) if whole):
            got |= {(i, p)} if b in first else set()
            first.setdefault(b, i)
        assert got == windows_that_repeat(strings, length)
        # Merged order is the order of the rotations, and neighbours share what is said.
        turned = [((strings[i][p:] + b"\xff" + strings[i][:p]) * 3)[:length] for _, i, p in rows]
        assert turned == sorted(turned)
        assert all(a[:same] == b[:same] for a, b, same in zip(turned, turned[1:], shared[1:]))


def removed(df):
    rows = df.select("doc_id", "n_bytes", "spans", "kept").collect()
    return sorted(((r.doc_id, (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept))) for r in rows), key=str)


def test_repeats_equal_windows(spark):
    rng = random.Random(11)
    texts = repeated_texts(rng, 150) + ["a" * 700, "ab" * 300, None, "", "a" * 15]
    rows = [(i * 3, t) for i, t in enumerate(rng.sample(texts, len(texts)))] + [(None, texts[0] + "ab" * 20)]
    want = sorted(brute.without_repeats(rows, 16).items(), key=str)
    docs = brute.clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert removed(suffix_dedup.without_repeats(docs, length=16, seed=7)) == want
    # Many buckets and hot parts everywhere change nothing.
    assert removed(suffix_dedup.without_repeats(docs, length=16, seed=8, bucket=300, merge=200)) == want
    assert removed(suffix_dedup.without_repeats(docs, length=16, seed=8, sample=1, hot=1)) == want
    assert removed(suffix_dedup.without_repeats(docs, length=16, seed=8, sample=1, hot=3, merge=500)) == want


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FLUSH", 300)
    monkeypatch.setattr(suffix_dedup, "PACK", 1000)
    monkeypatch.setattr(suffix_dedup, "SHARD", 200)
    rng = random.Random(12)
    rows = [(i, "".join(repeated_texts(rng, 40))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(suffix_dedup.without_repeats(docs, length=16, seed=8)) == sorted(brute.without_repeats(rows, 16).items(), key=str)


def test_suffix_dedup_odd_rows(spark):
    docs = brute.clashing(brute.odd_documents(spark))
    got = removed(suffix_dedup.without_repeats(docs))
    assert len(got) == len(brute.ODD)
    # Repeated rows are one document; every other case by the plain version.
    unique = {r[0]: r[1] for r in brute.ODD if r[0] is not None}
    want = brute.without_repeats(list(unique.items()), 100)
    assert {i: v for i, v in got if i is not None} == want
    assert sorted(v[1] for i, v in got if i is None) == [0, 0]
    assert removed(suffix_dedup.without_repeats(spark.createDataFrame([], brute.SCHEMA))) == []


def test_op11_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = {i: (n, gone, runs, hashlib.sha256(kept).hexdigest()) for i, (n, gone, runs, kept) in brute.without_repeats(rows, 100).items()}
    got = queries.op11_suffix_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(rows)


# --- 12 conversations

TURNS = "conv_id long, turn long, role string, text string"


def talk(rng, conv, count):
    roles = ["user", "assistant"] * 3 + ["system", "tool", "", None, "unknown"]
    texts = ["Is it?", "no", "Yes.", "é!", " ", "", None, "so . \n", "a" * 40 + "."]
    return [(conv, rng.choice([t, t, t, None, t - 1, t * 2]), rng.choice(roles), rng.choice(texts) and f"{rng.choice(texts)}") for t in range(count)]


def audits(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(21)
    rows = [row for conv in range(60) for row in talk(rng, conv if conv else None, rng.randint(1, 12))]
    rows += talk(rng, 1000, 300) + [(1001, t // 2, "user", "Same.") for t in range(80)] + [(1002, 1, "user", "All the same.")] * 50
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment, tasks", [(1 << 16, 1), (1 << 16, 7), (7, 3), (1, 2)])
def test_audits_equal_search(spark, talks, monkeypatch, segment, tasks):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        df = brute.clashing(spark.createDataFrame(talks, TURNS)).withColumn("_code", F.lit("x"))
        assert audits(conversation_repair.audited(df)) == brute.repaired_conversations(talks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_conversations(spark):
    assert conversation_repair.audited(spark.createDataFrame([], TURNS)).collect() == []


def test_blocks_equal_single_rows():
    rng = random.Random(22)
    for _ in range(200):
        symbols = bytes(rng.randrange(conversation_repair.SYMBOLS) for _ in range(rng.randint(0, 30)))
        cost = conversation_repair.END
        for symbol in symbols[::-1]:
            cost = conversation_repair.before(symbol, cost)
        _, front, added = conversation_repair.boundaries(symbols)
        assert tuple(c + added for c in conversation_repair.tables().vectors[front]) == cost
        to, add = conversation_repair.segment_map(symbols)
        assert (to[0], add[0]) == (front, added)


def test_op12_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert audits(queries.op12_conversations(spark, sf_dir)) == brute.repaired_conversations(rows)


# --- 13 hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("spread", [0.02, 0.3, 1.0])
def test_negatives_equal_all_scores(spark, spread, monkeypatch):
    for name, value in (("BLOCK", 8), ("GROUP", 2), ("CHUNK", 150), ("SLAB", 40)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(31)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in rng.sample(range(-50, 1500), 400):
        centre = rng.choice(centres)
        rows.append((i, [float(np.float32(c + rng.gauss(0, spread))) for c in centre], rng.randint(0, 3)))
    got = mined(hard_negatives.mine(brute.clashing(spark.createDataFrame(rows, VECTORS)), every=10))
    assert got == brute.hard_negatives(rows, 10) and got


def test_negatives_odd_rows(spark):
    rng = random.Random(32)
    inf, nan = float("inf"), float("nan")
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(rng.randint(0, 4))], rng.randint(0, 1)) for i in range(60)]
    odd = [(100, None, 1), (150, [1.0, None], 1), (200, [nan, 1.0], 1), (250, [1.0, inf], 0), (300, [1.0, 2.0], None), (None, [1.0], 1), (350, [], 1)]
    df = spark.createDataFrame(rows + rows[:20] + odd, VECTORS)
    assert mined(hard_negatives.mine(df)) == brute.hard_negatives(rows + odd)
    assert mined(hard_negatives.mine(df.limit(0))) == []


def test_negatives_of_huge_components(spark):
    rng = random.Random(33)
    rows = [(i * 10, [float(np.float32(rng.choice([1e9, -1e9, 3e8, 1.0]))) for _ in range(3)], rng.randint(0, 1)) for i in range(40)]
    got = mined(hard_negatives.mine(spark.createDataFrame(rows, VECTORS)))
    held = [(*r[:4], *(max(-(2**63) + 1, min(2**63 - 1, v)) for v in r[4:])) for r in brute.hard_negatives(rows)]
    assert got == held


def test_op13_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf_dir, "embeddings").collect()]
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 and label is not None else label) for i, v, label in rows]
    assert mined(queries.op13_hard_negatives(spark, sf_dir)) == brute.hard_negatives(moved)
