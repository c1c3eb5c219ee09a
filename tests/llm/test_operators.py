"""Each operator against a plain version, on random input and on every odd case."""

import base64
import hashlib
import itertools
import random
import time
import tracemalloc
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paywatch.llm import bpe, decontaminate, exact_dedup, minhash, quality, secrets, sharding, token_count, toxicity, warc
from paywatch.llm.common import held_out

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
BITS = ["a", "the", " ", "  ", "\n", "'s", "'re", "!!", "é", "12", "ing", "<|endoftext|>", "<|", "x", "中文", "\t", " q", "aaaa"]


def mumble(rng, most=14):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, most)))


@pytest.fixture(scope="module")
def docs(spark):
    return brute.clashing(brute.odd_documents(spark)).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def count_of(text):
    return sum(t is not None for t in text)


# --- 1 token counts


@pytest.fixture(scope="module")
def counter():
    return token_count.PrefixCounts(JSON, PATTERN)


def test_counts_of_all_prefixes(counter):
    library, rng = Tokenizer.from_file(JSON), random.Random(1)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for _ in range(150):
        text = mumble(rng)
        known = counter.boundaries(text)
        want = [size(text[:i]) for i in range(len(text) + 1)]
        assert [counter.count_at(text, i, known) for i in range(len(text) + 1)] == want
        assert counter.count(text) == want[-1]
        for budget in (0, 1, 4):
            assert counter.longest_prefix(text, budget, known) == max(i for i, n in enumerate(want) if n <= budget)


def test_both_splitters_agree_on_shared_classes(counter):
    splitter = Tokenizer.from_file(JSON).pre_tokenizer
    for code in range(ord(token_count.SHARED_CLASSES)):
        text = f"a{chr(code)}1{chr(code)}{chr(code)}! {chr(code)}'s"
        assert counter.pieces(text) == [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)]


def test_token_counts(docs, none):
    library = Tokenizer.from_file(JSON)
    rows = token_count.count_tokens(docs, JSON, PATTERN, 512).collect()
    assert len(rows) == len(brute.ODD)
    want = sorted(
        (i is None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in brute.ODD
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) and (r.bytes_within_limit == r.n_bytes) != r.over_limit for r in rows)
    assert token_count.count_tokens(none, JSON, PATTERN, 512).count() == 0


def test_prefix_table_answers_budgets(spark):
    rows = token_count.prefix_table(brute.odd_documents(spark).filter("doc_id = 1"), JSON, PATTERN).collect()
    assert token_count.truncation_points(rows[0].ends, rows[0].counts, 3) == len("the quick brown")
    assert token_count.truncation_points([], [], 3) == 0


# --- 2 decontamination


def test_decontamination_finds_what_alignment_finds():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abc de") for _ in range(rng.randint(0, n)))
    for _ in range(120):
        item = decontaminate.normal(some(50) + "abcdeabcabcd")
        index = decontaminate.build_index([(1, item)])
        inner = list(item)
        for _ in range(rng.randint(0, int(index.budgets[0]) + 1)):
            k = rng.randrange(len(inner))
            inner[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        text = decontaminate.normal(some(60) + "".join(inner) + some(60))
        best, found = brute.best_edits(item, text), index.search(text)
        assert bool(found) == (best <= index.budgets[0])
        if found:
            _, start, end, edits, _ = found[0]
            assert edits == best == brute.best_edits(item, text[start:end])


def test_decontamination_of_repetitive_texts(monkeypatch):
    """Runs of one character and repeated phrases, with hits listed and looked up."""
    rng = random.Random(6)
    for pairs in (decontaminate.PAIRS, 0):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs or 1)
        for _ in range(40):
            item = decontaminate.normal("ab " * rng.randint(4, 20) + "-" * rng.randint(0, 40) + rng.choice(["end", "ba ba"]))
            text = decontaminate.normal("ab " * rng.randint(0, 40) + "-" * rng.randint(0, 60) + rng.choice(["end", "", "ba ba"]) + "ab " * 9)
            index = decontaminate.build_index([(1, item)])
            assert bool(index.search(text)) == (brute.best_edits(item, text) <= index.budgets[0])
    monkeypatch.undo()
    rule = decontaminate.build_index([(1, "a table " + "-" * 80 + " with text below its rule that the document lacks altogether, as it is a rule")])
    phrase = decontaminate.build_index([(2, "ha " * 400)])
    start = time.perf_counter()
    assert rule.search("-" * 20_000) == []
    assert phrase.search("ha " * 8_000)[0][:4] == (2, 0, 1199, 0)
    assert phrase.search(("ha " * 30 + "hbc ") * 60) != []
    assert time.perf_counter() - start < 10


def test_decontamination_reports_every_region():
    item = "which of these rivers is the longest one in the country?"
    index = decontaminate.build_index([(1, item), (2, "cat in hat")])
    text = f"{item} {'other words ' * 30}{item.replace('rivers', 'rivars')} concat in hatred, cat in hat"
    at = text.index("which", 10)
    assert sorted(index.search(text)) == [(1, 0, len(item), 0, len(item)), (1, at, at + len(item), 1, len(item)), (2, len(text) - 10, len(text), 0, 10)]
    assert len(index.search(text, first_only=True)) == 1


def test_decontamination_of_odd_rows(spark, docs, none):
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "no id at"), (4, "no id at")], "item_id long, text string")
    found = decontaminate.matches(docs, items)
    want = [(1, 1), (2, 1), (6, 1), (None, 4), (None, 4)]
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == sorted(want, key=str)
    blocks = decontaminate.matches(docs, items, most=1)
    assert sorted(((r.doc_id, r.item_id) for r in blocks.collect()), key=str) == sorted(want, key=str)
    kept = decontaminate.without_passages(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert decontaminate.without_passages(docs, items, most=1).count() == docs.count() - 4
    assert decontaminate.matches(none, items).count() == 0
    assert decontaminate.matches(docs, items.limit(0)).count() == 0
    assert decontaminate.without_passages(docs, items.limit(0)).count() == docs.count()


# --- 3 byte-level BPE


def test_words_equal_library_for_all_code_points():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    pattern = bpe.kept_codec(RANKS, PATTERN).pattern
    for code in (c for c in range(0x110000) if not 0xD800 <= c < 0xE000):
        text = f"a{chr(code)}1{chr(code)} {chr(code)}!"
        assert [t for w in pattern.findall(text) for t in library._core_bpe.encode_single_piece(w.encode())] == library.encode_ordinary(text)


def test_forgotten_words_are_made_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 6)
    codec, rows = bpe.Codec(RANKS, PATTERN), [f"again {i} more{i % 7}" for i in range(40)]
    want = [bpe.Codec(RANKS, PATTERN).encode([r])[0] for r in rows[:8]] * 5
    got = [codec.encode([r])[0] for r in rows[:8] * 5]
    assert got == want and len(codec.words) + len(codec.earlier) < 20


def traced(run):
    """MB of Python objects: what stays after the call, and the most during it."""
    tracemalloc.start()
    try:
        run()
        return [n / 1e6 for n in tracemalloc.get_traced_memory()]
    finally:
        tracemalloc.stop()


def test_bpe_words_that_come_again_are_held_once():
    codec, text = bpe.Codec(RANKS, PATTERN), "".join(f" {w}" for w in BITS if w.isalpha()) * 300
    want = codec.encode([text])
    out = []
    assert traced(lambda: out.extend(codec.encode([text] * 200)))[1] < 15  # 26 MB as strings of their own
    assert out == want * 200


def test_bpe_worker_remembers_few_mb_of_words(monkeypatch):
    codec = bpe.Codec(RANKS, PATTERN)
    monkeypatch.setattr(codec, "encode_words", lambda words: {w: w.encode()[:12] for w in words})
    letters = [chr(97 + i) for i in range(26)]
    firsts = ["".join(p) for p in itertools.product(letters, repeat=3)][:700]

    def fill():
        for w in firsts:  # over 1,100 words never met before in each text
            codec.encode(["".join(f" {w}{a}{b}{c}" for a in letters for b in letters for c in "xy")[:8000]])

    assert traced(fill)[1] < 80
    assert codec.words and codec.earlier


@pytest.mark.parametrize("long_word", [bpe.LONG_WORD, 8])
def test_bpe_equals_library(long_word):
    codec, rng = bpe.Codec(RANKS, PATTERN, long_word), random.Random(2)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [mumble(rng, 40) for _ in range(400)] + ["a" * 3000, "ab" * 1500, "中文" * 900, " " * 900, ""]
    ids = codec.encode(rows)
    assert ids == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in rows]
    assert codec.decode(ids) == [t.encode() for t in rows]


def test_bpe_cuts_queries_by_their_rows(monkeypatch):
    monkeypatch.setattr(bpe, "STEP_ROWS", 50)
    codec, words = bpe.Codec(RANKS, PATTERN), ["a" * n for n in range(1, 30)] + ["", "b" * 300]
    parts = codec._parts(words)
    assert [w for p in parts for w in p] == words and len(parts) > 20
    assert codec._parts([]) == [[]]
    text = " ".join(words)
    assert codec.encode([text]) == bpe.Codec(RANKS, PATTERN).encode([text])


def test_bpe_round_trip_of_odd_rows(docs, none):
    rows = bpe.round_trip(docs, RANKS, PATTERN, keep_ids=True).collect()
    assert len(rows) == len(brute.ODD) and all(r.same_text and r.n_tokens == len(r.ids) for r in rows)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(r.decoded_sha256 for r in rows) == sorted(digest((t or "").encode()) for _, t, *_ in brute.ODD)
    assert all(r.ids_sha256 == digest(np.array(r.ids, "<u4").tobytes()) for r in rows)
    back = bpe.decode_documents(bpe.encode_documents(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in brute.ODD)
    assert bpe.round_trip(none, RANKS, PATTERN).count() == 0


# --- 4 sharding


def test_differencing_keeps_all_and_balances():
    rng = random.Random(3)
    for parts in (2, 5, 24):
        sizes = [rng.randint(8, 5000) for _ in range(300)]
        members = sharding.differenced(sizes, parts)
        assert sorted(i for m in members for i in m) == list(range(300)) and len(members) == parts
        sums = [sum(sizes[i] for i in m) for m in members]
        assert max(sums) - min(sums) <= max(sizes) / 10
    assert sharding.differenced([], 3) == [[], [], []]
    # The classical example: 8 7 6 5 4 differs by 2, greedy by 4.
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in m) for m in sharding.differenced([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_shards(docs, none):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(brute.ODD)
    slots, of_text = {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert of_text.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in brute.ODD)
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    assert sharding.shard_documents(none).count() == 0


# --- 5 exact duplicates


def test_exact_groups(docs, none):
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).filter("doc_id IS NOT NULL").collect()}
    assert {(1, 6, 3, False), (2, 6, 3, False), (6, 6, 3, True), (5, 5, 4, True), (3, 5, 4, False), (7, 7, 1, True)} <= rows
    assert {(10, 10, 2, True), (10, 10, 2, False)} <= rows
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([5, 6, 7, 8, 9, 10, 11, None], key=str)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.deduplicated(none).count() == 0


def test_stages_of_refinement(spark):
    # Alone in length, alone in prefix, alone in content, equal.
    same, tail = "x" * 100, "x" * 99
    rows = [(1, "abc"), (2, "q" * 100), (3, tail + "y"), (4, same), (5, same[:50] + " \n" + same[50:]), (6, None), (7, " "), (8, "abcd"), (8, "abcd")]
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 5, 2), (5, 5, 2), (6, 7, 2), (7, 7, 2), (8, 8, 2)}


# --- 6 toxicity


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(400):
        scores = [rng.choice([-3.1, -2.3, -1.7, -0.7, 0.53, 1.1, 2.9, 4.3]) for _ in range(rng.randint(0, 10))]
        assert [(i, j) for _, i, j in toxicity.maximal_segments(scores)] == brute.segments(scores)


def test_decay_solves_its_equation():
    decay = toxicity.solve_decay([5.0, 2.0], [0.01, 0.02], -0.5)
    assert abs(0.01 * np.exp(5 * decay) + 0.02 * np.exp(2 * decay) + 0.97 * np.exp(-0.5 * decay) - 1) < 1e-6


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(["river", "stone", "cloud", "tree", "field", "road"]) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(40)
            text[at : at + 8] = [rng.choice(["vile", "rotten", "foul", "stone"]) for _ in range(8)]
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scored = toxicity.score(docs, model).withColumn("h", held_out(F.col("doc_id"))).filter("h").collect()
    assert len(scored) > 200 and all((r.score >= 0.5) == (r.doc_id % 6 == 0) for r in scored)
    found = toxicity.passages(docs, model).collect()
    assert {r.doc_id for r in found} == set(range(0, 1500, 6)) and all("vile" in r.passage or "rotten" in r.passage or "foul" in r.passage for r in found)
    odd = toxicity.score(brute.clashing(brute.odd_documents(spark)), model).collect()
    assert len(odd) == len(brute.ODD) and all(0 <= r.score < 0.5 for r in odd)


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, none) is None
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0.0] * len(brute.ODD)


# --- 7 near duplicates


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(8)
    errors = []
    for similarity in (0.2, 0.5, 0.8):
        for n in (3, 40, 900):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            both = round(2 * n * similarity / (1 + similarity))
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            x, y = minhash.sketch(a, 256), minhash.sketch(b, 256)
            assert (x != np.iinfo(np.uint64).max).all()
            errors.append(abs((x == y).mean() - both / (2 * n - both)))
    assert max(errors) < 0.15
    assert (minhash.sketch(pool[:1], 64) == minhash.sketch(pool[:1], 64)).all()


def mutated(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(9)
    rows, i = {}, 100
    for family in range(12):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([1, 3, 25])):
            rows[i] = " ".join(mutated(rng, base, rng.choice([0, 0, 1, 2, 4, 7])))
            i += 1
    rows |= {k: t for k, t, *_ in brute.ODD if k is not None}
    docs = brute.clashing(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows.items()], brute.SCHEMA))
    want = brute.classes(rows, 4)
    for limits in ({}, {"BLOCK_ROWS": 2, "SHARE_ROWS": 2}):
        for name, value in limits.items():
            monkeypatch.setattr(minhash, name, value)
        got = minhash.near_duplicates(docs, size=4).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(brute.shingle_set(rows[r.doc_id], 4)) for r in got)


def test_near_duplicates_of_odd_rows(docs, none):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len({i for i, *_ in brute.ODD if i is not None}) + count_of([1 for i, *_ in brute.ODD if i is None])
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (1, 2, 6, 3, 4)} == {1: 1, 2: 1, 6: 1, 3: 3, 4: 4}
    kept = minhash.one_per_class(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert minhash.near_duplicates(none).count() == 0


# --- 8 secrets


def test_secret_patterns(spark, none):
    rng = random.Random(10)
    parts = ["token", "API_KEY", "passwd", "=", ": ", '"', "secret=token: abcdef", "AKIA", "ABCD1234EFGH5678", "deadbeef", "cafe01", " ", "é", "hello", "\n", "xY9+/z"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(i, t) for i, t, *_ in brute.ODD if i is not None]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.b) for r in found.select("doc_id", secrets.listed(F.col("base")).alias("b")).collect())
    assert got == sorted((i, brute.secret_spans(t)) for i, t in rows)
    assert secrets.scan(none).count() == 0


def test_markov_models_add_random_strings(spark):
    rng = random.Random(11)
    letters = secrets.ALPHABET[:64]
    key = lambda n=40: "".join(rng.choice(letters) for _ in range(n))
    common = ["maximum", "throughput", "configuration", "reader", "partition", "window", "handler", "service"]
    rows = [(i, f"see token = {key()} and " + " ".join("_".join(rng.sample(common, 2)) for _ in range(30))) for i in range(200)]
    rows += [(1000, f"plain {key()} text"), (1001, "plain configuration_reader_partition_window_handler text"), (1002, None)]
    docs = brute.clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.s for r in secrets.scan(docs).select("doc_id", secrets.listed(secrets.all_spans()).alias("s")).collect()}
    assert got[1000] == "random:6:46" and got[1001] == "" and got[1002] == ""
    assert all(got[i].startswith("assign:4:") and "random" not in got[i] for i in range(200))


def spans_of(table):
    return {r.doc_id: r.s for r in secrets.scan(table).select("doc_id", secrets.listed(secrets.all_spans()).alias("s")).collect()}


def test_keys_inside_paths_and_short_keys(spark):
    rng = random.Random(21)
    letters = secrets.ALPHABET[:62]
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    common = ["maximum", "throughput", "configuration", "reader", "partition", "window", "handler", "service"]
    rows = [(i, f"see token = {key(40)} and " + " ".join(["/".join(rng.sample(common, 2)) for _ in range(30)] + common)) for i in range(200)]
    paths, short = range(1000, 1100), range(2000, 2100)
    rows += [(i, f"in reader/window/{key(24)}/handler now") for i in paths]
    rows += [(i, f"the {key(14)} service") for i in short]
    rows += [(3000, "window/handler/configuration/service reader_partition_window_handler")]
    got = spans_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(got[i] == "random:17:41" for i in paths) >= 90
    assert sum(got[i] == "random:4:18" for i in short) >= 90
    assert got[3000] == ""


def test_two_keys_in_one_run_and_keys_beside_patterns(spark):
    rng = random.Random(22)
    key = lambda n: "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(n))
    path = "/".join(["reader", "window", "handler"] * 3)
    rows = [(i, f"token = {key(40)} reader/window handler/reader window/handler") for i in range(200)]
    rows += [(1000, f"{key(32)}/{path}/{key(32)}"), (1001, f"{key(32)}/token={key(32)}"), (1002, f"AKIA{'Q7' * 10}{'0123456789abcdef' * 2} x")]
    got = spans_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[1000] == f"random:0:32,random:{34 + len(path)}:{66 + len(path)}"
    assert got[1001] == "random:0:32,assign:33:71"
    # Digits of the key id begin a run of hexadecimal ones: both patterns stay, nothing is added in them.
    assert "random" not in got[1002] and got[1002].startswith("access:0:") and "hex:" in got[1002]


def test_added_spans_keep_clear_of_patterns(spark):
    rng = random.Random(23)
    parts = ["token", "secret", "=", ":", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef01234567", "deadbeef", "a", "/", "_", " ", "é", "xY9+zQ4LmT0w"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for r in secrets.scan(table, evidence=0.0).collect():
        text = rows[r.doc_id][1]
        for s in r.added:
            assert text[s.start : s.end] == s.value
            assert all(s.end <= b.start or b.end <= s.start for b in r.base)


def test_many_spans_in_one_text(spark):
    def run(n):
        table = spark.createDataFrame([(1, 'password="abc123-45" \n' * n)], "doc_id long, text string")
        start = time.time()
        r = secrets.scan(table).select(F.size("base").alias("n"), F.element_at("base", -1)["end"].alias("end")).first()
        assert (r.n, r.end) == (n, 22 * n - 3)
        return time.time() - start

    assert run(10) >= 0 and run(32_000) < 12


# --- 9 quality


def test_quality_on_held_out_rows(spark, docs):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(1200):
        text = [rng.choice(["River", "stone", "cloud", "tree,", "field.", "road"]) for _ in range(rng.randint(5, 90))]
        if i % 5 == 0:
            text = [w.upper() + "!!" for w in text] if i % 2 else [w + " |" for w in text]
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, int(i % 5 != 0), 0))
    table = spark.createDataFrame(rows, brute.SCHEMA)
    model = quality.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scored = quality.score(table, model).withColumn("h", held_out(F.col("doc_id"))).filter("h").collect()
    right = [(r.score >= quality.CUT) == (r.doc_id % 5 != 0) for r in scored]
    assert len(right) > 150 and sum(right) / len(right) > 0.97
    kept = quality.accepted(brute.clashing(table), model)
    assert kept.columns[:5] == table.columns and abs(kept.count() - 960) < 30
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())


def test_quality_without_labels(spark, docs, none):
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None
    assert quality.accepted(docs, None).count() == len(brute.ODD)
    assert {r.score for r in quality.score(docs, None).collect()} == {1.0}
    assert quality.score(none, None).count() == 0


# --- 10 WARC


def test_warc_round_trip(spark):
    big = "<p>é" * 400
    rows = [(1, "http://a/x y", big), (2, None, big), (3, "http://a", None), (4, "u\r\nWARC-Type: x", "short"), (5, "u", "short"),
            (6, "u", ""), (None, "u", big), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 100), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages).collect()), key=str)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = html == big and i != 2
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_members_can_be_read_alone(spark, tmp_path):
    import json

    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string")
    raw = warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}", most=4000)
    members = warc.normalise(raw).collect()
    assert len(members) > 1
    seen = []
    for m in members:
        data = open(m.archive.removeprefix("file://"), "rb").read()
        entries = [json.loads(line) for line in open(m["index"].removeprefix("file://"))]
        for e in entries:
            seen.append(warc.parsed(zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], warc.GZIP))[0])
        assert sum(e["length"] for e in entries) == len(data)
    assert sorted(seen) == list(range(20))
