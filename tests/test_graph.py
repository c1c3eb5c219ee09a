import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paywatch.functions import keys
from paywatch.operators import community, graph, investigate


def device_edges(spark, uses):
    return spark.createDataFrame(
        [("account_device", a, d, 1, 1.0) for a, d in uses],
        "edge_type string, src string, dst string, txn_count bigint, total_amount double",
    )


def brute_components(uses):
    groups = {}
    for a, d in uses:
        groups.setdefault(d, set()).add(a)
    parent = {a: a for a, _ in uses}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for members in groups.values():
        first, *rest = sorted(members)
        for other in rest:
            a, b = root(first), root(other)
            parent[max(a, b)] = min(a, b)
    shared = {a for m in groups.values() if len(m) > 1 for a in m}
    sets = {}
    for a in shared:
        sets.setdefault(root(a), set()).add(a)
    return {a: min(s) for s in sets.values() for a in s}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    uses = sorted({(f"u{rng.randrange(60)}", f"d{rng.randrange(45)}") for _ in range(90)})
    found = community.components(community.incidence(device_edges(spark, uses))).collect()
    assert {r.account_id: r.component_id for r in found} == brute_components(uses)
    assert len(found) == len({r.account_id for r in found})


def test_components_of_a_long_chain_with_spread_keys(spark, monkeypatch):
    monkeypatch.setattr(keys, "SHARE_ROWS", 5)
    uses = [(f"u{i:03d}", f"d{j:03d}") for i in range(40) for j in (i, i + 1)]
    uses += [(f"u{i:03d}", "hub") for i in range(100, 140)] + [("u005", "hub")]
    found = community.components(community.incidence(device_edges(spark, uses))).collect()
    assert {r.component_id for r in found} == {"u000"}
    assert len(found) == 80


def modularity(uses, labels):
    groups = {}
    for a, d in uses:
        groups.setdefault(d, set()).add(a)
    weight = {}
    for members in groups.values():
        for a, b in itertools.permutations(sorted(members), 2):
            weight[a, b] = weight.get((a, b), 0) + 1
    total = sum(weight.values())
    degree = {}
    for (a, _), w in weight.items():
        degree[a] = degree.get(a, 0) + w
    return sum(
        weight.get((a, b), 0) / total - degree[a] * degree[b] / total**2
        for a in degree for b in degree if labels[a] == labels[b]
    )


def found_communities(spark, uses):
    edges = device_edges(spark, uses)
    accounts = edges.select(F.col("src").alias("account_id"))
    return {r.account_id: r.community_id for r in community.communities(accounts, community.incidence(edges)).collect()}


def test_two_cliques_joined_by_one_edge(spark):
    uses = []
    for group in ("a", "b"):
        for i, j in itertools.combinations(range(4), 2):
            uses += [(f"{group}{i}", f"{group}{i}{j}"), (f"{group}{j}", f"{group}{i}{j}")]
    uses += [("a3", "bridge"), ("b0", "bridge"), ("lonely", "own")]
    labels = found_communities(spark, uses)
    assert {a: c for a, c in labels.items()} == {
        **{f"a{i}": "a0" for i in range(4)}, **{f"b{i}": "b0" for i in range(4)}, "lonely": "lonely"
    }


def test_communities_beat_single_accounts_and_stay_in_components(spark):
    rng = random.Random(11)
    uses = sorted({
        (f"u{g}{rng.randrange(8)}", f"d{g}{rng.randrange(6)}") for g in range(4) for _ in range(30)
    } | {("u00", "x1"), ("u10", "x1"), ("u20", "x2"), ("u30", "x2")})
    labels = found_communities(spark, uses)
    alone = {a: a for a in labels}
    assert modularity(uses, labels) > modularity(uses, alone) + 0.3
    parts = brute_components(uses)
    for a, c in labels.items():
        assert parts.get(a, a) == parts.get(c, c)


def test_large_clubs_settle_in_few_rounds(spark, monkeypatch):
    calls, wishes = [], community._Graph.wishes
    monkeypatch.setattr(community._Graph, "wishes", lambda *a, **k: (calls.append(1), wishes(*a, **k))[1])
    uses = [(f"{g}{i:02}", g) for g in "abc" for i in range(30)]
    uses += [(f"{g}00", f"bridge {h}") for g, h in ("ab", "ba", "bc", "cb", "ca", "ac")]
    uses += [(f"{h}00", f"bridge {h}") for h in "abc"]
    labels = found_communities(spark, sorted(set(uses)))
    assert all(c == f"{a[0]}00" for a, c in labels.items()) and len(labels) == 90
    # One member at a time would take many more rounds for thirty of them.
    assert len(calls) <= 12


def test_twins_only_where_their_links_outweigh_chance(spark):
    member = spark.createDataFrame([(n, d, 1) for n, d in ("a1", "b1", "c1", "c2", "d2")], "node string, device_id string, m bigint")
    degrees = spark.createDataFrame([("a", 2), ("b", 2), ("c", 3), ("d", 1)], "node string, k bigint")
    named = lambda weight: {r.node: r.c for r in community.twins(member, degrees, weight).collect()}
    assert named(8.0) == {"a": "a", "b": "a", "c": "c", "d": "d"}
    assert named(4.0) == {"a": "a", "b": "b", "c": "c", "d": "d"}


def test_no_shared_device_gives_one_community(spark, make_txn):
    txn = make_txn([{"account_id": "A", "device_id": "D1", "is_fraud": True}, {"account_id": "B", "device_id": "D2"}])
    edges = graph.edges(txn)
    found = community.communities(graph.node_features(edges), community.incidence(edges))
    rated = community.community_features(found, txn).collect()
    assert {(r.community_size, r.community_fraud_rate) for r in rated} == {(2, 0.0)}


def test_account_that_is_also_a_beneficiary(make_txn):
    txn = make_txn([
        {"account_id": "A", "beneficiary_id": "B", "device_id": "D1", "ip_id": "I"},
        {"account_id": "B", "beneficiary_id": "A", "device_id": "D1", "ip_id": "I"},
    ])
    got = {r.account_id: r.asDict() for r in graph.node_features(graph.edges(txn)).collect()}
    for account in "AB":
        assert got[account] == {
            "account_id": account, "account_degree": 2, "device_shared_account_count": 1,
            "beneficiary_in_degree": 1, "num_devices": 1, "num_beneficiaries": 1,
        }


def test_flags_with_spread_keys_equal_plain(spark, sf_dir, monkeypatch):
    from paywatch.sources import testdata

    txn = testdata.transactions(spark, sf_dir)
    plain = sorted(graph.topology_flags(txn, lo=500, min_count=2).collect())
    monkeypatch.setattr(keys, "SHARE_ROWS", 10)
    assert sorted(graph.topology_flags(txn, lo=500, min_count=2).collect()) == plain


def test_pair_weights(spark):
    uses = [("a", "1"), ("b", "1"), ("a", "2"), ("b", "2"), ("c", "2"), ("d", "3"), ("a", "3")]
    shared = community.incidence(device_edges(spark, uses))
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "account_a string, account_b string")
    got = {(r.account_a, r.account_b): r.weight for r in community.pair_weights(pairs, shared).collect()}
    assert got == {("a", "b"): 2, ("b", "c"): 1}


def test_label_cutoff(make_txn):
    txn = make_txn([{"is_fraud": False}, {"is_fraud": True, "at": 10 * 86400}])
    assert graph.account_label_rate(txn).first().account_fraud_rate == 0.5
    assert graph.account_label_rate(txn, "2024-01-05").first().account_fraud_rate == 0.0


def test_neighborhood_caps(make_txn):
    rows = [{"account_id": f"A{i:02d}", "device_id": "HUB", "beneficiary_id": f"P{i:02d}"} for i in range(40)]
    rows += [{"account_id": "A00", "device_id": f"D{i:02d}", "merchant_id": f"M{i:02d}"} for i in range(30)]
    txn = make_txn(rows)
    got = {r.account_id: r for r in investigate.neighborhood(txn, txn, caps=investigate.REPORT_CAPS).collect()}
    assert len(got["A00"].connected_devices) == 20 and len(got["A00"].connected_merchants) == 10
    assert got["A05"].shared_device_accounts == [f"A{i:02d}" for i in range(11) if i != 5][:10]
    users = investigate.device_users(txn, txn, cap=20).filter("device_id = 'HUB'").first()
    assert users.account_count == 40 and len(users.accounts_using_device) == 20 and users.is_shared
    assert got["A00"].total_neighbors == 31 + 1


def test_watchlist_first_hit(spark):
    watch = spark.createDataFrame(
        [("W2", "T", "Ivan ACME-7", "r2", "s"), ("W1", "T", "acme-7 ltd", "r1", "s"), ("7", "T", "zzz", "r7", "s")],
        "entity_id string, entity_type string, name string, reason string, source string",
    )
    asked = spark.createDataFrame([("Acme-7",), ("7",), ("nobody",), ("W2",)], "entity_id string")
    got = {r.entity_id: r.matched_watchlist_id for r in investigate.watchlist_screen(asked, watch).collect()}
    assert got == {"Acme-7": "W1", "7": "7", "nobody": None, "W2": "W2"}


def test_watchlist_carries_numbers_in_many_tasks(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abAB") for _ in range(rng.randrange(1, 6)))
    rows = [(rng.choice([word(), None]), "T", rng.choice([word(), word(), None]), "r", rng.choice(["s", None])) for _ in range(60)]
    watch = spark.createDataFrame([*rows, *rows[:5]], "entity_id string, entity_type string, name string, reason string, source string")
    ids = {word() for _ in range(40)} | {None}
    asked = spark.createDataFrame([(i,) for i in ids], "entity_id string")
    monkeypatch.setattr(investigate, "GRAM_ROWS", 20, raising=False)
    found = investigate.watchlist_screen(asked, watch)
    first = lambda hits: min(hits, key=lambda r: [(x is not None, x or "") for x in (r[0], r[2], r[3], r[4])], default=None)
    for r in found.collect():
        hit = first([w for w in rows if r.entity_id is not None and (w[0] == r.entity_id or r.entity_id.lower() in (w[2] or "").lower())])
        assert r.hit == (hit is not None)
        assert hit is None or (r.matched_watchlist_id, r.matched_name, r.source) == (hit[0], hit[2], hit[4])
    # Least structs are found by sorting all substrings with their entries; least numbers are not.
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def cosine(a, b):
    length = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / length if length else 0.0


@pytest.mark.parametrize("k", [1, 3])
def test_similar_cases_equal_all_pairs(spark, k):
    rng = random.Random(k)
    codes = [*investigate.REASON_CODES[:4], "UNKNOWN"]
    some = lambda: rng.sample(codes, rng.choice([0, 1, 1, 2, 3]))
    score = lambda: rng.choice([0.0, 0.5, 1.0, None, round(rng.random(), 3), round(rng.random(), 3)])
    cases = [(f"C{i:03d}", score(), some(), "BLOCK", f"case {i}") for i in rng.sample(range(200), 120)]
    asked = [(i, score(), some()) for i in range(50)]
    vector = lambda s, cs: [0.5 if s is None else s, *[float(c in cs) for c in investigate.REASON_CODES]]
    want = set()
    for q, s, cs in asked:
        rated = sorted((-round(cosine(vector(s, cs), vector(*c[1:3])), 12), c[0]) for c in cases)[:k]
        want |= {(q, r + 1, c) for r, (_, c) in enumerate(rated)}
    library = spark.createDataFrame(cases, "case_id string, confidence double, reason_codes array<string>, recommended_action string, summary string")
    found = investigate.similar_cases(
        spark.createDataFrame(asked, "query_id bigint, txn_risk_score double, reason_codes array<string>"), library, k
    )
    rows = found.collect()
    # Vectors at the same angle differ in the last digit, where ids may change places.
    of = {c[0]: c for c in cases}
    assert len(rows) == len(want) and len({(r.query_id, r.rank) for r in rows}) == len(rows)
    by_place = {(q, r): c for q, r, c in want}
    for r in rows:
        q, s, cs = asked[r.query_id]
        angle = lambda c: cosine(vector(s, cs), vector(*of[c][1:3]))  # noqa: B023, E731
        assert abs(angle(r.case_id) - angle(by_place[r.query_id, r.rank])) < 1e-9
        assert (r.confidence, r.reason_codes, r.recommended_action, r.summary) == of[r.case_id][1:]
    assert investigate.similar_cases(found.select("query_id", F.lit(0.1).alias("txn_risk_score"), "reason_codes"), library.limit(0)).collect() == []


def test_neighbors_are_all_listed_and_counted(make_txn):
    rows = [{"account_id": f"A{i:02d}", "device_id": "HUB", "beneficiary_id": f"P{i:02d}"} for i in range(40)]
    rows += [{"account_id": "A00", "device_id": f"D{i:02d}", "merchant_id": f"M{i:02d}"} for i in range(30)]
    rows += [{"account_id": "Z", "device_id": "D29"}]
    txn = make_txn(rows)
    found = investigate.neighbors(txn, txn).collect()
    mine = {}
    for r in found:
        mine.setdefault((r.owner_type, r.owner_id, r.kind), set()).add(r.id)
    assert all(r.kind_count == len(mine[r.owner_type, r.owner_id, r.kind]) for r in found) and len(found) == sum(map(len, mine.values()))
    assert mine["account", "A00", "device"] == {"HUB", *(f"D{i:02d}" for i in range(30))}
    assert len(mine["account", "A00", "merchant"]) == 30
    assert mine["device", "HUB", "account"] == {f"A{i:02d}" for i in range(40)} and mine["device", "D29", "account"] == {"A00", "Z"}
    asked = txn.filter("account_id in ('A00', 'Z')")
    met = {(r.account_id, r.id) for r in investigate.co_users(asked, txn).collect()}
    assert met == {("Z", "A00"), ("A00", "Z"), *(("A00", f"A{i:02d}") for i in range(1, 40))}
    whole = {r.account_id: r for r in investigate.neighborhood(asked, txn).collect()}
    assert whole["A00"].connected_devices == [*(f"D{i:02d}" for i in range(30)), "HUB"] and whole["A00"].device_count == 31
    assert whole["A00"].shared_device_accounts == [*(f"A{i:02d}" for i in range(1, 40)), "Z"]
    report = {r.account_id: r for r in investigate.neighborhood(asked, txn, caps=investigate.REPORT_CAPS).collect()}
    assert len(report["A00"].connected_devices) == 20 and report["A00"].device_count == 31 and report["A00"].merchant_count == 30


def test_similar_cases_tell_third_places_apart(spark):
    cases = spark.createDataFrame(
        [("C1", 0.301, ["WATCHLIST_HIT"]), ("C2", 0.302, ["WATCHLIST_HIT"]), ("C3", 0.304, ["WATCHLIST_HIT"])],
        "case_id string, confidence double, reason_codes array<string>",
    )
    asked = spark.createDataFrame(
        [(1, 0.304, ["WATCHLIST_HIT"])], "query_id bigint, txn_risk_score double, reason_codes array<string>"
    )
    rows = investigate.similar_cases(asked, cases).orderBy("rank").collect()
    assert [r.case_id for r in rows] == ["C3", "C2", "C1"]


# The friendships of a karate club (Zachary 1977), the usual yardstick for communities.
CLUB = """1-2 1-3 2-3 1-4 2-4 3-4 1-5 1-6 1-7 5-7 6-7 1-8 2-8 3-8 4-8 1-9 3-9 3-10 1-11 5-11 6-11 1-12 1-13 4-13 1-14
2-14 3-14 4-14 6-17 7-17 1-18 2-18 1-20 2-20 1-22 2-22 24-26 25-26 3-28 24-28 25-28 3-29 24-30 27-30 2-31 9-31 1-32
25-32 26-32 29-32 3-33 9-33 15-33 16-33 19-33 21-33 23-33 24-33 30-33 31-33 32-33 9-34 10-34 14-34 15-34 16-34 19-34
20-34 21-34 23-34 24-34 27-34 28-34 29-34 30-34 31-34 32-34 33-34"""


def test_communities_of_the_club(spark):
    links = [tuple(pair.split("-")) for pair in CLUB.split()]
    rows = [(a, f"d{i}", 2) for i, link in enumerate(links) for a in link]
    shared = spark.createDataFrame(rows, "account_id string, device_id string, accounts long")
    of = {r.account_id: r.community_id for r in community.communities(shared.select("account_id"), shared, compared=5).collect()}
    degree = Counter(a for link in links for a in link)
    total = Counter()
    for account, k in degree.items():
        total[of[account]] += k
    twice = 2 * len(links)
    inside = sum(2 for a, b in links if of[a] == of[b])
    assert inside / twice - sum((t / twice) ** 2 for t in total.values()) >= 0.41
    # Every community hangs together.
    for name in set(of.values()):
        members = {a for a in of if of[a] == name}
        reached, todo = set(), [name]
        while todo:
            a = todo.pop()
            reached.add(a)
            todo += [y for x, y in [*links, *((b, a) for a, b in links)] if x == a and y in members - reached]
        assert reached == members
