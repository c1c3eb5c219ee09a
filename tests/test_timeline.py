import random

import pytest
from pyspark.sql import functions as F

from paywatch.functions import timeline
from paywatch.operators import detect, features

BASE = 1704067200
DAY = 86400


def random_rows(seed, n=400, span=60 * DAY, grain=1):
    rng = random.Random(seed)
    pick = lambda kind, k: rng.choice([None, *[f"{kind}{i}" for i in range(k)]])
    return [
        {"txn_id": i, "account_id": rng.choice(["A", "B", "C"]), "merchant_id": pick("M", 5),
         "beneficiary_id": pick("P", 6), "device_id": pick("D", 4), "amount": rng.randrange(1, 10**6) / 100,
         "at": rng.randrange(span) // grain * grain}
        for i in range(n)
    ]


def brute(rows):
    """Feature definitions row by row."""
    out = {}
    for r in rows:
        own = [x for x in rows if x["account_id"] == r["account_id"]]
        t = r["at"]
        within = lambda w: [x for x in own if t - w <= x["at"] <= t]
        past = [x for x in own if t - 30 * DAY <= x["at"] <= t - 1]
        before = [x["at"] for x in own if (x["at"], x["txn_id"]) < (t, r["txn_id"])]
        distinct = lambda c, w: len({x[c] for x in within(w)} - {None})
        total = sum(x["amount"] for x in past)
        out[r["txn_id"]] = (
            len(within(3600)), len(within(DAY)), len(within(7 * DAY)),
            round(sum(x["amount"] for x in within(3600)), 2), round(sum(x["amount"] for x in within(DAY)), 2),
            distinct("merchant_id", 7 * DAY), distinct("beneficiary_id", 7 * DAY), distinct("device_id", 30 * DAY),
            round(r["amount"] / (total / len(past)), 6) if past else 1.0,
            round(r["amount"] / max(x["amount"] for x in past), 6) if past else 1.0,
            round((t - max(before)) / DAY, 6) if before else 0.0,
            None if r["device_id"] is None else r["device_id"] not in {x["device_id"] for x in past},
            False if r["beneficiary_id"] is None
            else r["beneficiary_id"] not in {x["beneficiary_id"] for x in past},
        )
    return out


def collected(df):
    columns = [*features.VELOCITY_COLUMNS, *features.BEHAVIOR_COLUMNS]
    places = {c: 2 for c in ("amount_sum_1h", "amount_sum_24h")}
    return {
        r["txn_id"]: tuple(
            round(r[c], places.get(c, 6)) if isinstance(r[c], float) else r[c] for c in columns
        )
        for r in df.collect()
    }


@pytest.mark.parametrize("method", ["window", "sweep"])
@pytest.mark.parametrize("grain", [1, 6 * 3600])
def test_rolling_features_match_definition(make_txn, method, grain):
    rows = random_rows(grain, grain=grain)
    assert collected(features.rolling_features(make_txn(rows), method)) == brute(rows)


def test_auto_mixes_both_forms(make_txn):
    rows = random_rows(3)
    for r in rows:
        if r["txn_id"] % 3:
            r["account_id"] = "HOT"
    df = features.rolling_features(make_txn(rows), "auto", hot_rows=200)
    assert collected(df) == brute(rows)


def test_forms_agree_on_odd_rows(make_txn):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        rows.append({
            "at": rng.randrange(40) * 43_200, "account_id": rng.choice(["A", "B", None, None]),
            "amount": rng.choice([None, 1e-11, 0.1, 0.2, 0.3, 2e14, 1e19, -1e30, 12.5, 0.0, float("nan"), float("inf")]), "device_id": rng.choice(["D1", "D2", None]),
        })
    df = make_txn(rows)
    df = df.withColumn("timestamp", F.when(F.col("txn_id") % 9 != 0, F.col("timestamp")))

    def exact(method, **more):
        columns = [*features.VELOCITY_COLUMNS, *features.BEHAVIOR_COLUMNS]
        found = features.rolling_features(df, method, **more).collect()
        return {r["txn_id"]: tuple(repr(r[c]) if isinstance(r[c], float) else r[c] for c in columns) for r in found}

    want = exact("window")
    assert len(want) == len(rows)
    assert exact("sweep") == want and exact("auto", hot_rows=2) == want and exact("auto", hot_rows=30) == want
    alone = [want[r["txn_id"]] for r in df.filter("account_id is null or timestamp is null").collect()]
    assert {a[0] for a in alone} == {1} and {a[-3] for a in alone} == {"0.0"}


def test_window_bounds_are_inclusive(make_txn):
    rows = [{"at": 0}, {"at": 3600}, {"at": 7201}, {"at": 7201}]
    got = {r.txn_id: r.txn_count_1h for r in features.rolling_features(make_txn(rows)).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 2}


def test_same_second_peers(make_txn):
    rows = [{"at": 50, "amount": 10.0}, {"at": 50, "amount": 30.0}]
    got = features.rolling_features(make_txn(rows), "sweep").orderBy("txn_id").collect()
    assert [r.amount_sum_1h for r in got] == [40.0, 40.0]
    assert [r.amount_vs_30d_avg for r in got] == [1.0, 1.0]
    assert [r.is_new_device for r in got] == [True, True]


def test_profiles_of_single_transaction(make_txn):
    profile = features.account_profiles(features.velocity(make_txn([{}]))).first()
    assert (profile.std_amount, profile.total_txn_count, profile.has_fraud) == (0.0, 1, False)


@pytest.mark.parametrize("seed", [1, 2])
def test_trailing_max(spark, seed):
    rng = random.Random(seed)
    rows = [("k", BASE + s, float(rng.randrange(1000))) for s in sorted(rng.sample(range(5000), 300))]
    df = spark.createDataFrame(rows, "key string, sec bigint, v double")
    got = {r.sec: r.trailing_v for r in timeline.trailing_max(df, ["key"], "sec", "v", 100).collect()}
    for _, s, _ in rows:
        past = [v for _, x, v in rows if s - 100 <= x <= s - 1]
        assert got[s] == (max(past) if past else None)


def test_block_size_does_not_matter(spark):
    rng = random.Random(5)
    rows = sorted({("k", rng.randrange(100_000)) for _ in range(300)})
    df = spark.createDataFrame(rows, "key string, sec bigint")
    results = [
        sorted(tuple(r) for r in timeline.previous_second(df, ["key"], "sec", block).collect())
        for block in (10, 1000, 10**9)
    ]
    assert results[0] == results[1] == results[2]


def test_structuring_run_across_a_bucket_border(make_txn):
    border = 3 * DAY - (BASE % (3 * DAY))
    rows = [{"at": border + d * 3600, "amount": 9500.0, "beneficiary_id": "P"} for d in (-2, -1, 1)]
    txn = make_txn(rows)
    from paywatch.operators import graph

    assert graph.structuring_buckets(txn).count() == 0
    assert [r.near_threshold_txns for r in detect.structuring(txn).collect()] == [3]


def test_takeover_needs_dormancy(make_txn):
    rows = [{"at": 0, "device_id": "D0"}, {"at": 40 * DAY, "device_id": "D9", "beneficiary_id": "P", "amount": 9e3}]
    found = detect.takeover_burst(features.rolling_features(make_txn(rows))).collect()
    assert [r.txn_id for r in found] == [1]


def test_chains_do_not_count_self_transfers(make_txn):
    rows = [
        {"account_id": "A", "beneficiary_id": "B", "at": 0},
        {"account_id": "B", "beneficiary_id": "B", "at": 10},
        {"account_id": "B", "beneficiary_id": "C", "at": 20},
        {"account_id": "C", "beneficiary_id": "D", "at": 30},
        {"account_id": "D", "beneficiary_id": "E", "at": 30 + DAY + 1},
    ]
    got = {r.txn_id: (r.chains_2, r.chains_3, r.chains_4, r.hops) for r in detect.money_chains(make_txn(rows)).collect()}
    assert got == {0: (1, 1, 0, 3), 2: (1, 0, 0, 2)}


def test_next_second(spark):
    events = spark.createDataFrame([("a", 5), ("a", 9)], "key string, sec bigint")
    probes = spark.createDataFrame([("a", 5), ("a", 1), ("a", 9), ("b", 1)], "key string, sec bigint")
    got = {(r.key, r.sec): r.following for r in timeline.next_second(events, probes, ["key"], "sec").collect()}
    assert got == {("a", 5): 9, ("a", 1): 5, ("a", 9): None, ("b", 1): None}


def test_month_blocks_cover_long_gaps(make_txn):
    rows = [{"at": 0, "amount": 50.0}, {"at": 30 * DAY, "amount": 10.0}, {"at": 60 * DAY + 1, "amount": 10.0}]
    got = features.rolling_features(make_txn(rows), "sweep").orderBy("txn_id").collect()
    assert [r.amount_vs_30d_max for r in got] == [1.0, 0.2, 1.0]


def test_sweep_without_points_after_the_last_probe(spark):
    events = spark.createDataFrame(
        [("a", 10, 1), ("a", 20, 2), ("b", 15, 4), ("b", 500, 8)], "k string, s bigint, n bigint"
    )
    points = timeline.window_points(events, ["k"], "s", {"short": ("n", -5, 0), "long": ("n", -1000, -1)})
    whole = timeline.sweep([points], events, ["k"], "s")
    short = timeline.sweep([points], events, ["k"], "s", last=500)
    assert sorted(short.collect()) == sorted(whole.collect()) and short.count() == 4


def test_window_tasks_grow_with_the_rows(spark, make_txn, monkeypatch):
    from paywatch.operators import features

    txn = make_txn([{"account_id": f"A{i % 50}", "at": i * 60} for i in range(200)])
    plain = sorted(features.rolling_features(txn, "window").select("txn_id", "txn_count_24h", "amount_sum_1h").collect())
    monkeypatch.setattr(features, "WINDOW_ROWS", 5, raising=False)
    found = features.rolling_features(txn)
    assert found.rdd.getNumPartitions() >= 40
    assert sorted(found.select("txn_id", "txn_count_24h", "amount_sum_1h").collect()) == plain
