import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paywatch.functions import keys, quantiles
from paywatch.functions.ordered import read_sorted, running_totals, with_ordinal, write_sorted
from paywatch.functions.sampling import hash_sample
from paywatch.functions.topk import top_k, top_n


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, monkeypatch, how):
    rng = random.Random(4)
    facts = spark.createDataFrame(
        [(i, rng.choice(["hot", "hot", "warm", None, "x", "y"]), rng.randrange(3)) for i in range(300)],
        "id bigint, key string, part int",
    )
    lookup = spark.createDataFrame([("hot", 1), ("x", 2), ("z", 3)], "key string, value int")
    plain = rows_of(facts.join(lookup, ["key"], how).select(
        *facts.columns, *([] if how in ("left_semi", "left_anti") else ["value"])
    ))
    monkeypatch.setattr(keys, "SHARE_ROWS", 20)
    assert rows_of(keys.spread_join(facts, lookup, ["key"], ["id"], how)) == plain


def test_spread_join_deals_out_the_hot_key(spark, monkeypatch):
    monkeypatch.setattr(keys, "SHARE_ROWS", 10)
    facts = spark.range(100).select("id", F.lit("hot").alias("key"))
    lookup = spark.createDataFrame([("hot", 1)], "key string, value int")
    dealt = keys._dealt(facts, lookup, ["key"], ["id"], "left", facts)
    assert dealt.select("_share").distinct().count() == 10
    assert dealt.count() == 100


@pytest.mark.parametrize("n", [1, 2, 37, 5000])
def test_bracketed_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(3, 2, n), 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    probs = [0.0, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0]
    want = np.quantile(values, probs)
    assert quantiles.exact_quantiles(df, "v", probs) == pytest.approx(want)
    assert quantiles.exact_quantiles(df, "v", probs, small=0) == pytest.approx(want)


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) is None


def test_quantiles_with_a_dominant_value(spark):
    df = spark.createDataFrame([(5.0,)] * 900 + [(float(i),) for i in range(100)], "v double")
    want = np.quantile([5.0] * 900 + list(range(100)), [0.03, 0.5, 0.97])
    assert quantiles.exact_quantiles(df, "v", [0.03, 0.5, 0.97], small=0) == pytest.approx(want)


def test_running_totals_and_ordinals(spark):
    rng = random.Random(8)
    data = [(i, rng.randrange(50), 1 + i % 3) for i in range(500)]
    df = spark.createDataFrame(data, "id bigint, t bigint, w bigint")
    order = sorted(data, key=lambda r: (r[1], r[0]))
    got = {r.id: r.no for r in with_ordinal(df, [F.col("t"), F.col("id")], "no").collect()}
    assert got == {r[0]: i for i, r in enumerate(order)}
    totals = {r.id: r.upto for r in running_totals(df, [F.col("t"), F.col("id")], {"upto": "w"}).collect()}
    assert [totals[r[0]] for r in order] == list(np.cumsum([r[2] for r in order]))


def test_top_k_and_top_n(spark):
    rng = random.Random(9)
    data = [(i, rng.choice("ab"), rng.randrange(20)) for i in range(400)]
    df = spark.createDataFrame(data, "id bigint, g string, v bigint")
    order = [F.col("v").desc(), F.col("id")]
    ranked = sorted(data, key=lambda r: (-r[2], r[0]))
    want = sorted(r for g in "ab" for r in [x for x in ranked if x[1] == g][:7])
    assert sorted(tuple(r) for r in top_k(df, ["g"], order, 7, ["id"]).collect()) == want
    assert [tuple(r) for r in top_n(df, order, 9, ["id"]).collect()] == ranked[:9]


def test_hash_sample_is_exact_and_repeatable(spark):
    df = spark.range(20_000)
    plain = df.orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")).cast("binary")), "id").limit(50)
    assert rows_of(hash_sample(df, 50, "id")) == rows_of(plain)
    assert hash_sample(df.limit(10), 50, "id").count() == 10


def test_hash_sample_of_repeated_keys_is_full(spark):
    df = spark.range(5_000).select((F.col("id") % 3).alias("id"))
    assert all(hash_sample(df, 50, "id", seed).count() == 50 for seed in range(4))


def test_unique_by(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert rows_of(keys.unique_by(df, ["k"], [F.col("o")])) == [("a", 1, "y"), ("b", 5, "z")]


@pytest.mark.parametrize("small", [0, 10**6])
def test_quantiles_of_many_columns_take_few_jobs(spark, small):
    rng = random.Random(9)
    rows = [
        (float(rng.randrange(50)), rng.gauss(0, 1), None if rng.random() < 0.3 else rng.random(), float("nan"), rng.randrange(10**6))
        for _ in range(30_000)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e bigint").repartition(4).cache()
    df.count()
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]

    def jobs_for(columns):
        group = f"quantiles-{small}-{len(columns)}"
        spark.sparkContext.setJobGroup(group, "")
        found = quantiles.column_quantiles(df, columns, probs, small)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    found, jobs = jobs_for(df.columns)
    assert jobs == jobs_for(["a"])[1]
    for i, name in enumerate("abcde"):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        if not values:
            assert found[name] is None
            continue
        assert found[name][:3] == (len(values), min(values), max(values))
        assert found[name].at == pytest.approx(np.quantile(values, probs).tolist())


def test_report_reads_its_table_twice(spark, sf_dir):
    from paywatch.operators import quality
    from paywatch.sources import testdata

    plan = quality.report(testdata.transactions(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("FileScan") <= 2
    empty = testdata.transactions(spark, sf_dir).limit(0)
    told = {(r.section, r.key): r.value for r in quality.report(empty).collect()}
    assert told["record_counts", "transactions"] == told["record_counts", "unique_accounts"] == "0"
    assert told["uniqueness", "txn_id_unique"] == "true"


def test_sorted_table_keeps_order_and_prunes(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(40)])) for i in rng.sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "id bigint, at int").repartition(5)
    write_sorted(df, str(tmp_path / "t"), ["at", "id"], 8)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    found = read_sorted(spark, str(tmp_path / "t"), "at")
    assert [(r.id, r.at) for r in found.orderBy("position").collect()] == order
    assert sorted(r.position for r in found.collect()) == list(range(3000))
    some = read_sorted(spark, str(tmp_path / "t"), "at", F.lit(10), F.lit(13))
    assert [(r.id, r.at) for r in some.orderBy("position").collect()] == [r for r in order if r[1] in (10, 11, 12)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    pruned = re.search(r"PartitionFilters: \[.*?_range#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert pruned and len((pruned[1] or pruned[2]).split(",")) < 8
    # Rows stand in order in their files.
    for path in found.inputFiles():
        if "/rows/" in path:
            ats = [(r.at is not None, r.at or 0, r.id) for r in spark.read.parquet(path).collect()]
            assert ats == sorted(ats)
    write_sorted(df.limit(0), str(tmp_path / "none"), ["at", "id"])
