"""Investigation lookups for whole tables of transactions, accounts, merchants or cases."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywatch.functions.keys import only, spread_join, unique_by
from paywatch.functions.numbers import settle
from paywatch.functions.ordered import running_totals
from paywatch.functions.topk import top_k
from paywatch.operators.features import risk_tier
from paywatch.operators.graph import EDGE_TYPES
from paywatch.runtime import settled
from paywatch.schemas import ACTIONS, REASON_CODES



@dataclass(frozen=True)
class Caps:
    """How many neighbours a report shows, in id order; None shows all of them."""

    device: int | None = None
    beneficiary: int | None = None
    ip: int | None = None
    merchant: int | None = None
    followed: int | None = None  # devices whose users are listed
    offered: int | None = None  # users of one device
    sharers: int | None = None  # users of all devices together


# --- fixed values: caps of the report, confidences of the lookups ---
REPORT_CAPS = Caps(device=20, beneficiary=20, ip=20, merchant=10, followed=5, offered=10, sharers=20)
PATTERN_CONFIDENCE = {
    "FAN_OUT": ("is_fan_out_source", 0.8),
    "FAN_IN": ("is_fan_in_target", 0.7),
    "SHARED_DEVICE_RING": ("is_shared_device", 0.6),
    "STRUCTURING": ("structuring_flag", 0.85),
    "MULE_CHAIN": ("is_mule_chain_member", 0.75),
}
# --- end of fixed values ---

LINKS = {"device": "device_id", "beneficiary": "beneficiary_id", "ip": "ip_id", "merchant": "merchant_id"}


def transaction_detail(ids: DataFrame, alerts: DataFrame, features: DataFrame) -> DataFrame:
    """Alert and feature values of the transactions asked for."""
    extra = [
        "device_id", "ip_id", "merchant_id", "beneficiary_id", "channel", "txn_type",
        "amount_vs_30d_avg", "is_new_device", "is_new_beneficiary",
    ]
    asked = only(alerts, ids, "txn_id", ["txn_id"]).select(
        "txn_id", "account_id", "amount", "timestamp", "txn_risk_score", "behavior_anomaly_score",
        "final_risk_score", "action", "risk_band", "reason_codes", "is_fraud", "fraud_scenario",
    )
    return asked.join(features.select("txn_id", *extra), "txn_id", "left")


def account_history(ids: DataFrame, alerts: DataFrame, window_days: int = 30) -> DataFrame:
    """Summary over each account's own last ``window_days`` days."""
    own = only(alerts, ids, "account_id", ["txn_id"]).select(
        "txn_id", "account_id", "timestamp", "amount", "is_fraud", "final_risk_score", "action"
    )
    ends = own.groupBy("account_id").agg(F.max("timestamp").alias("_latest"))
    start = F.col("_latest") - F.expr(f"INTERVAL {int(window_days)} DAYS")
    recent = spread_join(own, ends, ["account_id"], ["txn_id"], "inner", alerts).filter(F.col("timestamp") >= start)
    counts = F.create_map(*[
        part for a in sorted(ACTIONS) for part in (F.lit(a), F.count_if(F.col("action") == a))
    ])
    day = "yyyy-MM-dd"
    return recent.groupBy("account_id").agg(
        F.lit(window_days).alias("window_days"),
        F.count(F.lit(1)).alias("total_transactions"),
        settle(F.sum("amount"), 2).alias("total_amount"),
        settle(F.avg("amount"), 2).alias("avg_amount"),
        settle(F.max("amount"), 2).alias("max_amount"),
        settle(F.min("amount"), 2).alias("min_amount"),
        F.count_if("is_fraud").alias("fraud_count"),
        settle(F.avg("final_risk_score"), 4).alias("avg_risk_score"),
        settle(F.max("final_risk_score"), 4).alias("max_risk_score"),
        F.map_filter(counts, lambda _, n: n > 0).alias("actions"),
        F.concat_ws(
            " to ", F.date_format(F.max(start), day), F.date_format(F.max("_latest"), day)
        ).alias("date_range"),
    )


def _latest_row(df: DataFrame, columns: list[str]) -> Column:
    return F.max_by(F.struct(*columns), F.struct("timestamp", "txn_id"))


def velocity_snapshot(ids: DataFrame, features: DataFrame) -> DataFrame:
    """Velocity columns of each account's last transaction, by a mergeable aggregate."""
    wanted = [
        "txn_count_1h", "txn_count_24h", "txn_count_7d", "amount_sum_1h", "amount_sum_24h",
        "unique_merchants_7d", "unique_beneficiaries_7d", "unique_devices_30d",
    ]
    own = only(features, ids, "account_id", ["txn_id"])
    last = own.groupBy("account_id").agg(_latest_row(own, ["txn_id", *wanted]).alias("_l"))
    return last.select(
        "account_id",
        F.col("_l.txn_id").alias("as_of_txn"),
        *[
            (settle(f"_l.{c}", 2) if c.startswith("amount") else F.col(f"_l.{c}")).alias(c)
            for c in wanted
        ],
    )


def baseline(ids: DataFrame, profiles: DataFrame) -> DataFrame:
    money = ["avg_amount", "max_amount", "std_amount", "avg_txn_count_7d", "avg_amount_sum_24h"]
    counts = ["total_txn_count", "unique_merchants", "unique_beneficiaries", "unique_devices"]
    own = profiles.join(ids.select("account_id").distinct(), "account_id", "left_semi")
    return own.select(
        "account_id", *counts, *[settle(c, 2).alias(c) for c in money],
        F.col("has_fraud").alias("has_prior_fraud"),
    )


def merchant_risk(ids: DataFrame, merchants: DataFrame) -> DataFrame:
    asked = merchants.join(ids.select("merchant_id").distinct(), "merchant_id", "left_semi")
    return asked.select(
        "merchant_id", "name", "category_code", "country",
        settle("fraud_rate_hist", 4).alias("fraud_rate_hist"),
        risk_tier("fraud_rate_hist").alias("risk_tier"),
    )


def anomaly_summary(ids: DataFrame, alerts: DataFrame) -> DataFrame:
    own = only(alerts, ids, "account_id", ["txn_id"])
    summary = own.groupBy("account_id").agg(
        _latest_row(own, ["behavior_anomaly_score"]).alias("_l"),
        F.avg("behavior_anomaly_score").alias("_avg"),
        F.count(F.lit(1)).alias("total_transactions_scored"),
    )
    label = F.when(F.col("_avg") > 0.6, "HIGHLY_ANOMALOUS").when(
        F.col("_avg") > 0.3, "MODERATELY_ANOMALOUS"
    ).otherwise("NORMAL")
    return summary.select(
        "account_id",
        settle("_l.behavior_anomaly_score", 4).alias("latest_anomaly_score"),
        settle("_avg", 4).alias("avg_anomaly_score"),
        "total_transactions_scored",
        label.alias("interpretation"),
    )


def _account_links(txn: DataFrame) -> DataFrame:
    """Distinct (account, kind, neighbour) from one scan."""
    links = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id")) for kind, c in LINKS.items()
    ])
    return (
        txn.select(F.col("account_id").cast("string").alias("account_id"), F.explode(links).alias("_l"))
        .select("account_id", "_l.kind", "_l.id")
        .filter(F.col("id").isNotNull())
        .distinct()
    )


def neighbors(ids: DataFrame, txn: DataFrame) -> DataFrame:
    """Everything around the accounts as links: (owner_type, owner_id, kind, id, kind_count).

    Accounts own their devices, payees, IPs and merchants; the devices of these accounts own
    their users. That is one row per link, however many accounts meet on a device; who meets
    whom through them, for accounts asked for, is ``co_users``. ``kind_count`` is the number of
    rows of the owner and kind.
    """
    asked = ids.select(F.col("account_id").cast("string").alias("account_id")).distinct()
    everyone = _account_links(txn)
    links = settled(only(everyone, asked, "account_id", ["id"]), "links")
    devices = links.filter("kind = 'device'").select(F.col("id").alias("device_id"))
    users = everyone.filter("kind = 'device'").select(F.col("id").alias("device_id"), "account_id")
    users = only(users, devices, "device_id", ["account_id"])
    rows = links.select(F.lit("account").alias("owner_type"), F.col("account_id").alias("owner_id"), "kind", "id").unionByName(
        users.select(F.lit("device").alias("owner_type"), F.col("device_id").alias("owner_id"), F.lit("account").alias("kind"), F.col("account_id").alias("id"))
    )
    owner = ["owner_type", "owner_id", "kind"]
    counts = rows.groupBy(*owner).agg(F.count(F.lit(1)).alias("kind_count"))
    return spread_join(rows, counts, owner, ["id"], "inner")


def co_users(ids: DataFrame, txn: DataFrame) -> DataFrame:
    """(account_id, id) of accounts on a common device, for the accounts asked for.

    The result holds every user of every device of theirs: ask for single accounts, not for
    all of them.
    """
    asked = ids.select(F.col("account_id").cast("string").alias("account_id")).distinct()
    uses = settled(_account_links(txn).filter("kind = 'device'").select("account_id", F.col("id").alias("device")), "uses")
    followed = settled(only(uses, asked, "account_id", ["device"]), "followed")
    # Both sides are read from written tables, so a device that fills a partition can be split.
    met = followed.join(uses.select("device", F.col("account_id").alias("id")), "device")
    return met.filter(F.col("id") != F.col("account_id")).select("account_id", "id").distinct()


def neighborhood(ids: DataFrame, txn: DataFrame, hops: int = 2, caps: Caps = Caps()) -> DataFrame:
    """Devices, payees, IPs, merchants and co-users of devices as sorted lists with their counts.

    Without ``caps`` every list is whole. A report caps them (REPORT_CAPS): the first ids are
    kept, and capped devices offer at most one account more than shown, so a device that
    everyone uses does not multiply rows. Counts are of all neighbours, listed or not, those of
    co-users only without caps on them; ``total_neighbors`` counts devices, payees and IPs.
    """
    asked = ids.select(F.col("account_id").cast("string").alias("account_id")).distinct()
    everyone = _account_links(txn)
    links = only(everyone, asked, "account_id", ["id"])
    kept = links
    if None not in (caps.device, caps.beneficiary, caps.ip, caps.merchant, caps.followed):
        most = max(caps.device, caps.beneficiary, caps.ip, caps.merchant, caps.followed)
        kept = top_k(links, ["account_id", "kind"], [F.col("id")], most, ["id"])

    def first(column: Column, cap: int | None) -> Column:
        return F.array_sort(column) if cap is None else F.slice(F.array_sort(column), 1, cap)

    def listed(kind: str) -> Column:
        return first(F.collect_list(F.when(F.col("kind") == kind, F.col("id"))), getattr(caps, kind))

    names = {"device": "connected_devices", "beneficiary": "connected_beneficiaries", "ip": "connected_ips", "merchant": "connected_merchants"}
    lists = kept.groupBy("account_id").agg(*[listed(kind).alias(name) for kind, name in names.items()])
    counted = {f"{kind}_count": F.count_if(F.col("kind") == kind) for kind in names}
    counts = links.groupBy("account_id").agg(
        *[c.alias(n) for n, c in counted.items()], F.count_if(F.col("kind") != "merchant").cast("int").alias("total_neighbors"),
    )
    lists = lists.join(counts, "account_id")
    none = F.array().cast("array<string>")
    if hops < 2:
        return lists.withColumn("shared_device_accounts", none)
    devices = kept.filter("kind = 'device'").select("account_id", F.col("id").alias("device"))
    if caps.followed is not None:
        devices = top_k(devices, ["account_id"], [F.col("device")], caps.followed, ["device"])
    if caps.offered is None:
        met = co_users(asked, txn) if caps.followed is None else _met(devices, everyone)
    else:
        users = everyone.filter("kind = 'device'").select(F.col("id").alias("device"), F.col("account_id").alias("other"))
        offered = top_k(users, ["device"], [F.col("other")], caps.offered + 1, ["other"]).groupBy("device").agg(F.collect_list("other").alias("others"))
        met = spread_join(devices, offered, ["device"], ["account_id"], "inner").select(
            "account_id", F.explode(F.slice(F.array_sort(F.array_remove("others", F.col("account_id"))), 1, caps.offered)).alias("id"),
        ).distinct()
    sharers = met.groupBy("account_id").agg(first(F.collect_list("id"), caps.sharers).alias("shared_device_accounts"))
    return lists.join(sharers, "account_id", "left").withColumn("shared_device_accounts", F.coalesce("shared_device_accounts", none))


def _met(devices: DataFrame, everyone: DataFrame) -> DataFrame:
    users = everyone.filter("kind = 'device'").select(F.col("id").alias("device"), F.col("account_id").alias("id"))
    met = settled(devices, "followed").join(settled(users, "users"), "device")
    return met.filter(F.col("id") != F.col("account_id")).select("account_id", "id").distinct()


def device_users(ids: DataFrame, txn: DataFrame, cap: int | None = None) -> DataFrame:
    """Accounts on the devices asked for: their number, and all or the first ``cap`` in id order."""
    asked = ids.select(F.col("device_id").cast("string").alias("device_id")).distinct()
    uses = _account_links(txn).filter("kind = 'device'").select(F.col("id").alias("device_id"), "account_id")
    mine = only(uses, asked, "device_id", ["account_id"])
    first = mine if cap is None else top_k(mine, ["device_id"], [F.col("account_id")], cap, ["account_id"])
    listed = first.groupBy("device_id").agg(F.array_sort(F.collect_list("account_id")).alias("accounts_using_device"))
    counted = mine.groupBy("device_id").agg(F.count(F.lit(1)).alias("account_count"))
    return listed.join(counted, "device_id").withColumn("is_shared", F.col("account_count") > 1)


def reachable(starts: DataFrame, edge_table: DataFrame, hops: int = 2, cap: int | None = None) -> DataFrame:
    """Vertices within ``hops`` of each start (vertex_type, vertex_id), any vertex type.

    With a ``cap`` each vertex passes on its first neighbours in (type, id) order only, so
    that the result holds at most cap + cap^2 rows per start.
    """
    if hops not in (1, 2):
        raise ValueError("hops must be 1 or 2")
    ends = F.create_map(*[
        part for kind, (_, _, a, b) in EDGE_TYPES.items()
        for part in (F.lit(kind), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))
    ])
    typed = edge_table.select(ends[F.col("edge_type")].alias("_t"), "src", "dst")
    both = typed.select(
        F.explode(F.array(
            F.struct(F.col("_t.a").alias("vertex_type"), F.col("src").alias("vertex_id"),
                     F.col("_t.b").alias("near_type"), F.col("dst").alias("near_id")),
            F.struct(F.col("_t.b").alias("vertex_type"), F.col("dst").alias("vertex_id"),
                     F.col("_t.a").alias("near_type"), F.col("src").alias("near_id")),
        )).alias("_e")
    ).select("_e.*")
    vertex = ["vertex_type", "vertex_id"]
    near = both if cap is None else top_k(
        both, vertex, [F.col("near_type"), F.col("near_id")], cap, ["near_type", "near_id"]
    )
    frontier = starts.select(
        F.col("vertex_type").alias("start_type"), F.col("vertex_id").cast("string").alias("start_id"),
        "vertex_type", F.col("vertex_id").cast("string").alias("vertex_id"),
    ).distinct()
    found = None
    for hop in range(1, hops + 1):
        step = frontier.join(near, vertex).select(
            "start_type", "start_id", F.col("near_type").alias("vertex_type"),
            F.col("near_id").alias("vertex_id"), F.lit(hop).alias("hop"),
        ).distinct()
        found = step if found is None else found.unionByName(step)
        frontier = step.drop("hop").distinct()
    itself = (F.col("vertex_type") == F.col("start_type")) & (F.col("vertex_id") == F.col("start_id"))
    return found.filter(~itself).groupBy("start_type", "start_id", *vertex).agg(F.min("hop").alias("hop"))


def graph_patterns(
    ids: DataFrame, txn: DataFrame, flags: DataFrame, graph: DataFrame | None = None
) -> DataFrame:
    """Patterns shown by each account's transactions, with confidence and flagged counts."""
    own = only(txn, ids, "account_id", ["txn_id"]).select("txn_id", "account_id")
    counted = own.join(flags, "txn_id").groupBy("account_id").agg(
        *[F.count_if(flag).alias(f"{name.lower()}_txns") for name, (flag, _) in PATTERN_CONFIDENCE.items()],
        F.count(F.lit(1)).alias("total_transactions_checked"),
    )
    shown = {name: F.col(f"{name.lower()}_txns") > 0 for name in PATTERN_CONFIDENCE}
    out = counted.withColumns({
        "patterns_detected": F.array_compact(
            F.array(*[F.when(hit, F.lit(name)) for name, hit in shown.items()])
        ),
        "confidence": F.greatest(
            F.lit(0.0),
            *[F.when(hit, F.lit(PATTERN_CONFIDENCE[name][1])).otherwise(0.0) for name, hit in shown.items()],
        ),
    })
    if graph is None:
        return out
    account = F.col("account_id").cast("string")
    extra = graph.select(
        account.alias("_account"),
        F.when(F.col("device_shared_account_count") > 3, F.col("device_shared_account_count")).alias("shared_with"),
        F.when(F.col("community_fraud_rate") > 0.05, F.col("community_fraud_rate")).alias("community_rate"),
    )
    return out.join(extra, account == F.col("_account"), "left").drop("_account")


# Substrings of listed names that one task makes, about.
GRAM_ROWS = 1_000_000


def watchlist_screen(entities: DataFrame, watchlist: DataFrame) -> DataFrame:
    """First watchlist entry whose id equals the entity id or whose name contains it, with
    its listing time where the list has one.

    Names are cut into substrings of the lengths that occur among the ids, so the search
    is an equality join; each substring keeps only its first entry. Case is ignored in
    names. Entries are sorted and numbered once, so substrings carry a number instead of the
    entry and are added up in hash tables, and they are made in tasks of about ``GRAM_ROWS``
    of them. Actions collect the distinct id lengths, write the entries and add up their names.
    """
    asked = entities.select(F.col("entity_id").cast("string").alias("entity_id")).distinct()
    sizes = sorted(
        r[0] for r in asked.select(F.length(F.lower("entity_id")).alias("n")).filter("n > 0").distinct().collect()
    )
    listed = watchlist.select(
        F.col("entity_id").alias("matched_watchlist_id"), F.col("name").alias("matched_name"), "reason", "source",
        *[c for c in ["listed_at"] if c in watchlist.columns],
    ).distinct()
    # Numbers grow along the sorted table, so the least one is the first entry.
    entry = settled(listed.orderBy(*listed.columns).withColumn("_at", F.monotonically_increasing_id()), "watchlist")
    by_id = entry.groupBy(F.col("matched_watchlist_id").alias("entity_id")).agg(F.min("_at").alias("_id_at"))
    named = entry.select(F.lower("matched_name").alias("_name"), "_at")
    grams = F.flatten(F.transform(
        F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("_name")),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.length("_name") - n + 1), lambda at: F.substring(F.col("_name"), at, n)
        ),
    ))
    letters = named.agg(F.sum(F.length("_name"))).first()[0] or 0
    by_name = (
        named.repartition(max(1, math.ceil(letters * len(sizes) / GRAM_ROWS)))
        .select("_at", F.explode(F.array_distinct(grams)).alias("_lower"))
        .groupBy("_lower").agg(F.min("_at").alias("_name_at"))
    )
    # Ids without a hit get numbers of their own, or they would all meet in one task.
    none = -1 - F.pmod(F.xxhash64("entity_id"), F.lit(1 << 40))
    joined = (
        asked.withColumn("_lower", F.lower("entity_id"))
        .join(by_id, "entity_id", "left")
        .join(by_name, "_lower", "left")
        .select("entity_id", F.coalesce(F.least("_id_at", "_name_at"), none).alias("_at"))
        .join(entry, "_at", "left")
    )
    return joined.select("entity_id", (F.col("_at") >= 0).alias("hit"), *listed.columns)


def watchlist_edges(screened: DataFrame, entity_type: str, matched_at: Column) -> DataFrame:
    return screened.filter("hit").select(
        "entity_id", F.lit(entity_type).alias("entity_type"),
        F.col("matched_watchlist_id").alias("watchlist_entity_id"), matched_at.alias("matched_at"),
    )


CASE_FIELDS = ["recommended_action", "confidence", "reason_codes", "summary"]


def _code_set(codes: str) -> Column:
    """The known reason codes as bits of a number."""
    bits = [F.when(F.array_contains(codes, c), F.lit(1 << i)).otherwise(0) for i, c in enumerate(REASON_CODES)]
    return sum(bits[1:], bits[0])


def similar_cases(queries: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` cases closest by cosine to each query (query_id, txn_risk_score, reason_codes) (actions).

    A case is its confidence followed by one 0/1 entry per known reason code. Among the cases
    with the same codes the cosine rises with the confidence up to one point, which follows
    from the query, and falls beyond. So the cases are ordered by (codes, confidence) once,
    each query's point is merged into that order, and only the k vectors below and above it are
    compared, for each of the at most 2^14 sets of codes in use. The order is range-partitioned;
    nothing is compared all against all. Equal vectors keep their first k ids, equal queries
    are looked up once. Ties go to the smaller id. Similarity is 0 for an all-zero vector. Of
    repeated case ids the one with the lowest confidence stands. The fields of a case that
    ``cases`` has come along.
    """
    fields = [c for c in CASE_FIELDS if c in cases.columns]
    known = settled(unique_by(
        cases.select("case_id", F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)).alias("_s"), _code_set("reason_codes").alias("_codes"), *fields),
        ["case_id"], [F.col("_s"), F.col("_codes")],
    ), "cases")
    # Without codes only the sign of the confidence counts.
    flat = F.when(F.col("_codes") == 0, F.signum("_s")).otherwise(F.col("_s")).alias("_s")
    few = top_k(known.select("case_id", "_codes", flat), ["_codes", "_s"], [F.col("case_id")], k, ["case_id"])
    vectors = settled(few.groupBy("_codes", "_s").agg(F.collect_list("case_id").alias("ids")), "vectors")
    sets = [r["_codes"] for r in vectors.select("_codes").distinct().collect()]  # at most 2^14

    asked = settled(queries.select(
        "query_id", F.coalesce(F.col("txn_risk_score").cast("double"), F.lit(0.5)).alias("_q"), _code_set("reason_codes").alias("_asked"),
    ), "asked")
    shared, size = F.bit_count(F.col("_asked").bitwiseAND(F.col("_codes"))), F.bit_count("_codes")
    points = asked.select("_q", "_asked").distinct().withColumn("_codes", F.explode(F.lit(sets).cast("array<int>")))
    points = points.withColumns({"_o": shared, "_b": size}).withColumn("_s", (
        F.when(F.col("_o") > 0, F.col("_q") * F.col("_b") / F.col("_o"))
        .when(F.col("_q") > 0, float("inf")).when(F.col("_q") < 0, float("-inf")).otherwise(0.0)
    ))
    one, none = F.lit(1).cast("long").alias("_one"), F.lit(0).cast("long").alias("_one")
    merged = vectors.select("_codes", "_s", "ids", one).unionByName(
        points.select("_codes", "_s", "_q", "_asked", "_o", "_b", none), allowMissingColumns=True
    )
    # At the same place a vector stands before a point, so it is among those below.
    placed = settled(running_totals(merged, [F.col("_codes"), F.col("_s"), F.desc("_one")], {"_place": "_one"}), "merged-cases")
    library = placed.filter("_one = 1").select("_codes", F.col("_s").alias("_c"), "ids", "_place")
    around = F.explode(F.sequence(F.col("_place") - (k - 1), F.col("_place") + k)).alias("_place")
    near = placed.filter("_one = 0").select("_codes", "_q", "_asked", "_o", "_b", around).join(library, ["_codes", "_place"])
    near = near.select("_q", "_asked", "_o", "_b", "_c", F.explode("ids").alias("case_id"))
    # Where nothing is in common all similarities are 0, and the first ids of the set count.
    firsts = top_k(known.select("case_id", "_codes", flat), ["_codes"], [F.col("case_id")], k, ["case_id"])
    level = points.filter("_q = 0 AND _o = 0").drop("_s").join(firsts, "_codes").select("_q", "_asked", "_o", "_b", F.col("_s").alias("_c"), "case_id")
    length = F.sqrt(F.col("_q") * F.col("_q") + F.bit_count("_asked")) * F.sqrt(F.col("_c") * F.col("_c") + F.col("_b"))
    rated = near.unionByName(level).distinct().select(
        "_q", "_asked", "case_id", F.coalesce((F.col("_q") * F.col("_c") + F.col("_o")) / F.nullif(length, F.lit(0.0)), F.lit(0.0)).alias("similarity"),
    )
    best = settled(top_k(rated, ["_q", "_asked"], [F.desc("similarity"), F.col("case_id")], k, ["case_id"], spread=1, rank="rank"), "best-cases")
    best = spread_join(best, known.select("case_id", *fields), ["case_id"], ["_q", "_asked"], "inner")
    # Both sides are read from written tables, so a query that many ask can be split.
    return asked.join(settled(best, "described-cases"), ["_q", "_asked"]).select(
        "query_id", "rank", "case_id", settle("similarity", 4).alias("similarity"), *fields,
    )


def case_detail(cases: DataFrame, alerts: DataFrame) -> DataFrame:
    """Cases with the scores and amount of their alert."""
    scores = alerts.select(
        "alert_id",
        *[
            settle(c, 4).alias(c)
            for c in ("txn_risk_score", "behavior_anomaly_score", "graph_risk_score", "final_risk_score")
        ],
        settle("amount", 2).alias("amount"),
    )
    numbers = [c for c in scores.columns if c != "alert_id"]
    joined = cases.join(scores, "alert_id", "left").fillna(0.0, numbers)
    return joined.withColumn("confidence_pct", settle(F.col("confidence") * 100, 1))


def case_entities(cases: DataFrame) -> DataFrame:
    """One row per entity named in a case: (case_id, entity_type, entity_id)."""
    kinds = {
        "account_ids": "Account", "device_ids": "Device",
        "merchant_ids": "Merchant", "beneficiary_ids": "Beneficiary",
    }

    def tagged(field: str, kind: str) -> Column:
        named = F.coalesce(F.col(f"entities_involved.{field}"), F.array().cast("array<string>"))
        return F.transform(named, lambda x: F.struct(F.lit(kind).alias("entity_type"), x.alias("entity_id")))

    lists = F.flatten(F.array(*[tagged(field, kind) for field, kind in kinds.items()]))
    return cases.select("case_id", F.explode(lists).alias("_e")).select("case_id", "_e.*")


def case_ids(cases: DataFrame) -> DataFrame:
    return cases.select("case_id").distinct().orderBy("case_id")


def account_card(
    ids: DataFrame, txn: DataFrame, flags: DataFrame, graph: DataFrame, caps: Caps = Caps()
) -> DataFrame:
    """Graph values, neighbours and patterns of each account in one row."""
    around = neighborhood(ids, txn, caps=caps)
    shown = graph_patterns(ids, txn, flags).withColumn("account_id", F.col("account_id").cast("string"))
    values = graph.select(
        F.col("account_id").cast("string").alias("account_id"), "account_degree", "graph_risk_score",
        F.concat(F.lit("Cluster_"), F.col("community_id").cast("string")).alias("community"),
        "community_fraud_rate",
    )
    return around.join(values, "account_id", "left").join(shown, "account_id", "left")
