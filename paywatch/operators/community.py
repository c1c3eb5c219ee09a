"""Accounts tied together by shared devices: projection, components and communities.

The account-to-account graph is never written out: a device with n accounts stands for
n(n-1)/2 pairs. Everything is computed from the (account, device) incidence, whose size
is the number of edges, and gives the same weights as the pair form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywatch.functions.keys import spread_join
from paywatch.operators.graph import account_label_rate
from paywatch.runtime import settled


# Community of every account when no device is shared at all.
UNDIVIDED = "ALL"


def incidence(edge_table: DataFrame) -> DataFrame:
    """(account, device, accounts on the device) for devices with at least two accounts."""
    uses = edge_table.filter(F.col("edge_type") == "account_device").select(
        F.col("src").alias("account_id"), F.col("dst").alias("device_id")
    )
    sizes = uses.groupBy("device_id").agg(F.count(F.lit(1)).alias("accounts")).filter("accounts > 1")
    joined = spread_join(uses, sizes, ["device_id"], ["account_id"], "inner")
    return joined.select("account_id", "device_id", "accounts")


def projected_degree(shared: DataFrame) -> DataFrame:
    """Weighted degree of each account in the projection: co-users summed over its devices."""
    return shared.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("shared_devices"),
        F.sum(F.col("accounts") - 1).alias("weighted_degree"),
        F.max(F.col("accounts") - 1).alias("largest_ring"),
    )


def projected_links(shared: DataFrame) -> DataFrame:
    """A spanning set of projected edges, each with its exact weight.

    Every device links its members to its smallest account. These links connect the same
    accounts as all pairs do, but grow with the members instead of their square. The
    weight of a link is the number of devices the two accounts share.
    """
    lead = shared.groupBy("device_id").agg(F.min("account_id").alias("account_a"))
    links = (
        spread_join(shared, lead, ["device_id"], ["account_id"], "inner")
        .filter(F.col("account_id") != F.col("account_a"))
        .select("account_a", F.col("account_id").alias("account_b"))
        .distinct()
    )
    return pair_weights(links, shared)


def pair_weights(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """Number of shared devices for the account pairs asked for.

    Of each pair only the account with fewer devices is expanded, and its devices are
    looked up for the other one, so an account on very many devices costs no more.
    """
    degree = shared.groupBy("account_id").agg(F.count(F.lit(1)).alias("_n"))

    def degree_of(side: str) -> DataFrame:
        return degree.select(F.col("account_id").alias(side), F.col("_n").alias(f"_{side}"))

    asked = pairs.select("account_a", "account_b")
    n = asked.count()
    sized = (
        spread_join(asked, degree_of("account_a"), ["account_a"], ["account_b"], "inner", asked, n)
        .transform(spread_join, degree_of("account_b"), ["account_b"], ["account_a"], "inner", asked, n)
    )
    a_is_lighter = F.col("_account_a") <= F.col("_account_b")
    sided = sized.select(
        "account_a", "account_b",
        F.when(a_is_lighter, F.col("account_a")).otherwise(F.col("account_b")).alias("_light"),
        F.when(a_is_lighter, F.col("account_b")).otherwise(F.col("account_a")).alias("_heavy"),
    )
    light = shared.select(F.col("account_id").alias("_light"), "device_id")
    heavy = shared.select(F.col("account_id").alias("_heavy"), "device_id")
    return (
        sided.join(light, "_light")
        .join(heavy, ["_heavy", "device_id"])
        .groupBy("account_a", "account_b")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def components(shared: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected accounts, named by their smallest account id (action per round).

    Alternates large-star and small-star steps (Kiveris et al. 2014): every vertex hands
    the smallest neighbour on to the others. The number of links never grows, and the
    number of rounds grows with the logarithm of the longest path.
    """
    links = shared.select(
        F.concat(F.lit("a:"), "account_id").alias("u"), F.concat(F.lit("d:"), "device_id").alias("v")
    )
    current = settled(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        current = settled(_large_star(current))
        current = settled(_small_star(current))
        # Settled when the links form stars: one link per vertex, and no centre points on.
        chained = current.join(current.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        doubled = current.groupBy("u").count().filter("count > 1")
        if chained.isEmpty() and doubled.isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    # Links now point from each vertex to the smallest vertex of its component; "a:" sorts
    # before "d:", and every device has an account, so that vertex is an account.
    root = F.substring("v", 3, 1 << 30).alias("component_id")
    members = current.filter(F.col("u").startswith("a:")).select(
        F.substring("u", 3, 1 << 30).alias("account_id"), root
    )
    roots = current.select(F.substring("v", 3, 1 << 30).alias("account_id"), root)
    return members.unionByName(roots.distinct())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))
    larger = both.filter(F.col("v") > F.col("u"))
    return spread_join(larger, least, ["u"], ["v"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = spread_join(links, least, ["u"], ["v"], "inner")
    handed = F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))
    out = joined.select(F.explode(handed).alias("_l")).select(
        F.col("_l.v").alias("u"), F.col("_l.m").alias("v")
    )
    return out.filter(F.col("u") != F.col("v")).distinct()


# Communities of one device that a node compares, about.
COMPARED = 64
# Rounds of disjoint moves before communities become the nodes of the next level.
LEVEL_ROUNDS = 4
# Rounds without gain after which free moves end, and the share of nodes that move in one.
PATIENCE, FREE_SHARE = 4, 3
GAIN = 1e-9


def communities(accounts: DataFrame, shared: DataFrame, compared: int = COMPARED) -> DataFrame:
    """Communities of the projection by modularity (actions in every round).

    ``accounts`` lists every account of the graph. Accounts without a shared device stay
    alone; if no device is shared at all, everyone is in one community.

    Accounts with the same devices start as one node where every best partition has them
    together (``twins``).

    Each node weighs the gain of every community it shares a device with. In the coarsening
    rounds a node asks for the community of the largest gain per degree, so that not all ask
    for the largest one, and equal ones are told apart by lot; it moves when its wish comes
    first of all moves from or to the two communities. Such moves touch no community twice, so
    their gains add up exactly and every round raises modularity, and a device with n
    communities is settled in about log n rounds. After LEVEL_ROUNDS rounds, or when nobody wants to move,
    communities become the nodes of the next level. From the second cycle on, single accounts
    move freely first, a third of them a round, as long as that helps. Cycles go on until
    modularity no longer rises; there is no other end. Communities that moves have torn apart
    are split into their connected parts, which raises modularity again.

    A device with more than ``compared`` communities offers a node its largest one and a share
    of about ``compared``, dealt out by hash: pairs grow with the members, not their square.
    The pull of a community that a device does not offer is left out, so gains are never
    overrated; the pull of the own community is always exact.
    """
    everyone = accounts.select("account_id").distinct()
    base = settled(
        shared.select(F.col("account_id").alias("node"), "device_id", F.lit(1).cast("bigint").alias("m"), "accounts")
    )
    size = base.count()
    if size == 0:
        return everyone.withColumn("community_id", F.lit(UNDIVIDED))

    # A device with n accounts stands for n(n-1) ordered pairs: n-1 for each of them.
    degrees = settled(base.groupBy("node").agg(F.sum(F.col("accounts") - 1).alias("k")))
    twice_weight = float(degrees.agg(F.sum("k")).first()[0])
    base = settled(spread_join(base.drop("accounts"), degrees, ["node"], ["device_id"], "inner", rows=size))
    graph = _Graph(base, size, degrees, twice_weight, compared)
    labels = settled(twins(base, degrees, twice_weight))
    quality, torn, cycle = graph.modularity(labels), False, 0
    while True:
        moved = False
        if cycle:
            better, left = graph.free_moves(labels, quality, cycle)
            if better is not None:
                labels, torn, moved = better, torn or left, True
        level, changed = graph.merged(labels), False
        while True:
            level_labels, left = level.disjoint_moves()
            if level_labels is None:
                break
            changed, torn = True, torn or left
            joined = level_labels.select(F.col("node").alias("c"), F.col("c").alias("_c"))
            labels = settled(
                spread_join(labels, joined, ["c"], ["node"], "inner", rows=size).select("node", F.col("_c").alias("c"), "k")
            )
            level = level.merged(level_labels)
        if not (moved or changed):
            break
        reached = graph.modularity(labels)
        if reached < quality + GAIN:
            break
        quality, cycle = reached, cycle + 1
    if torn:
        placed = graph.placed(labels)
        parts = components(placed.select(F.col("node").alias("account_id"), F.concat_ws("\u0001", "c", "device_id").alias("device_id")))
        # A node alone on its device within its community is a part too.
        labels = labels.join(parts.select(F.col("account_id").alias("node"), "component_id"), "node", "left").select(
            "node", F.coalesce("component_id", "node").alias("c")
        )
    assigned = labels.select(F.col("node").alias("account_id"), F.col("c").alias("community_id"))
    named = assigned.groupBy("community_id").agg(F.min("account_id").alias("_name"))
    inside = spread_join(assigned, named, ["community_id"], ["account_id"], "inner", rows=size).select(
        "account_id", F.col("_name").alias("community_id")
    )
    alone = everyone.join(inside, "account_id", "left_anti").withColumn("community_id", F.col("account_id"))
    return inside.unionByName(alone)


def twins(member: DataFrame, degrees: DataFrame, twice_weight: float) -> DataFrame:
    """(node, c, k): nodes with the same devices under the name of the smallest one.

    Two such nodes of degree k with links of weight w between them are together in every
    partition of largest modularity when w > k * k / twice_weight: else each would have to
    gain as much from the other's absence. Devices are compared by their number and 128 bits.
    """
    uses = member.groupBy("node", "device_id").agg(F.sum("m").alias("m"))
    signs = uses.groupBy("node").agg(
        F.count(F.lit(1)).alias("s0"), F.bit_xor(F.xxhash64("device_id", "m")).alias("s1"),
        F.bit_xor(F.xxhash64(F.lit(1), "device_id", "m")).alias("s2"), F.sum(F.col("m") * F.col("m")).alias("w"),
    )
    signs = signs.join(degrees, "node").filter(F.col("w") * F.lit(twice_weight) > F.col("k").cast("double") * F.col("k"))
    same = ["s0", "s1", "s2", "k"]
    first = signs.groupBy(*same).agg(F.min("node").alias("c"))
    named = spread_join(signs, first, same, ["node"], "inner", member).select("node", "c")
    return degrees.join(named, "node", "left").select("node", F.coalesce("c", "node").alias("c"), "k")


class _Graph:
    """Nodes of one level: ``member`` (node, k, device, accounts of it there), degrees in ``nodes``."""

    def __init__(self, member: DataFrame, size: int, nodes: DataFrame, twice_weight: float, compared: int):
        self.member, self.size, self.nodes = member, size, nodes
        self.twice_weight, self.compared = twice_weight, compared

    def merged(self, labels: DataFrame) -> _Graph:
        """The graph whose nodes are the communities."""
        nodes = settled(labels.groupBy(F.col("c").alias("node")).agg(F.sum("k").alias("k")))
        member = self.placed(labels).groupBy(F.col("c").alias("node"), "device_id").agg(F.sum("m").alias("m"))
        member = settled(spread_join(member, nodes, ["node"], ["device_id"], "inner", rows=self.size))
        return _Graph(member, self.size, nodes, self.twice_weight, self.compared)

    def placed(self, labels: DataFrame) -> DataFrame:
        """Device memberships with the community of their node."""
        return spread_join(self.member, labels.select("node", "c"), ["node"], ["device_id"], "inner", rows=self.size)

    def modularity(self, labels: DataFrame) -> float:
        """Share of the link weight inside communities, less the share expected by degree."""
        on_device = self.placed(labels).groupBy("device_id", "c").agg(F.sum("m").alias("n"))
        inside = on_device.select((F.col("n") * (F.col("n") - 1) / F.lit(self.twice_weight)).alias("q"))
        totals = labels.groupBy("c").agg(F.sum("k").alias("k"))
        expected = totals.select((-F.pow(F.col("k") / F.lit(self.twice_weight), 2)).alias("q"))
        return inside.unionByName(expected).agg(F.sum("q")).first()[0]

    def wishes(self, labels: DataFrame, seed: int, per_degree: bool = False) -> DataFrame:
        """(node, c, target, gain, place, mates) of the nodes that gain by leaving for a community on their devices.

        The target has the largest gain, or the largest one per degree; ``place`` orders the
        wishes. ``mates`` tells whether others stay behind in the community.
        """
        placed = self.placed(labels)
        on_device = placed.groupBy("device_id", "c").agg(F.sum("m").alias("n"))
        sizes = on_device.groupBy("device_id").agg(
            F.ceil(F.count(F.lit(1)) / self.compared).cast("int").alias("shares"),
            F.max_by(F.struct("c", "n"), F.struct("n", "c")).alias("lead"),
        )
        offered = spread_join(on_device, sizes, ["device_id"], ["c"], "inner", self.member, self.size)
        share_of = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.col("shares")).cast("int")
        offered = offered.withColumn("share", share_of("c"))
        own = spread_join(placed, offered.drop("n"), ["device_id", "c"], ["node"], "inner", rows=self.size)
        mates = offered.select("device_id", "share", F.col("c").alias("target"), "n")
        # The own community is always among them; a node does not pull itself.
        pull = (F.col("m") * (F.col("n") - F.when(F.col("target") == F.col("c"), F.col("m")).otherwise(0))).alias("pull")
        near = own.join(mates, ["device_id", "share"]).select("node", "k", "c", "target", pull)
        leads = own.filter((F.col("shares") > 1) & (share_of("lead.c") != F.col("share"))).select(
            "node", "k", "c", F.col("lead.c").alias("target"), (F.col("m") * F.col("lead.n")).alias("pull")
        )
        pulls = near.unionByName(leads).groupBy("node", "k", "c", "target").agg(F.sum("pull").alias("pull"))
        totals = labels.groupBy(F.col("c").alias("target")).agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("nodes"))
        rated = spread_join(pulls, totals, ["target"], ["node"], "inner", rows=self.size)
        stays = F.col("target") == F.col("c")
        others = F.col("total") - F.when(stays, F.col("k")).otherwise(0)
        value = F.col("pull") - F.col("k") * others / F.lit(self.twice_weight)
        rated = rated.withColumn("v", value)
        if per_degree:
            # Gains that differ by rounding alone count as equal; both ends draw the same lot.
            ratio = F.when(F.col("v") > 0, F.round(F.log(F.col("v") / F.col("k") / F.col("total")), 6))
            lot = F.xxhash64(F.least("c", "target"), F.greatest("c", "target"), F.lit(seed))
            place = F.struct(ratio.alias("ratio"), lot.alias("lot"))
        else:
            place = F.struct("v")
        best = rated.groupBy("node", "c").agg(
            F.max(F.when(~stays, F.struct(place.alias("place"), "v", "target"))).alias("best"),
            F.max(F.when(stays, F.col("v"))).alias("kept"),
            F.max(F.when(stays, F.col("nodes") > 1)).alias("mates"),
        )
        return best.select(
            "node", "c", F.col("best.target").alias("target"), (F.col("best.v") - F.col("kept")).alias("gain"),
            F.col("best.place").alias("place"), "mates",
        ).filter(F.col("gain") > GAIN)

    def disjoint_moves(self) -> tuple[DataFrame | None, bool]:
        """Labels after up to LEVEL_ROUNDS rounds, None when nobody wants to move, and whether
        a community was left by some of its nodes."""
        labels, changed, torn = self.nodes.select("node", F.col("node").alias("c"), "k"), False, False
        for turn in range(LEVEL_ROUNDS):
            wishes = settled(self.wishes(labels, turn, per_degree=True))
            order = F.struct("place", F.xxhash64("node"), "node")
            sides = wishes.select("node", F.explode(F.array("c", "target")).alias("side"), order.alias("o"))
            first = sides.groupBy("side").agg(F.max("o").alias("o")).select(F.col("o.node").alias("node"))
            both = first.groupBy("node").count().filter("count = 2").select("node")
            moves = wishes.join(both, "node", "left_semi").select("node", "target", "mates")
            moved = settled(labels.join(moves, "node", "left").select("node", F.coalesce("target", "c").alias("c"), "k", "mates"))
            told = moved.agg(F.count("mates").alias("n"), F.max("mates").alias("torn")).first()
            if not told["n"]:
                break
            changed, torn = True, torn or told["torn"]
            labels = moved.select("node", "c", "k")
        return (labels, torn) if changed else (None, False)

    def free_moves(self, labels: DataFrame, quality: float, cycle: int) -> tuple[DataFrame | None, bool]:
        """The best labels met while shares of the nodes move at once, None when none is better."""
        best, stale, turn = None, 0, 0
        while stale < PATIENCE:
            turn += 1
            wishes = settled(self.wishes(labels, turn))
            if wishes.isEmpty():
                break
            active = F.pmod(F.xxhash64("node", F.lit(cycle * 1000 + turn)), F.lit(FREE_SHARE)) == 0
            moves = wishes.filter(active).select("node", "target")
            labels = settled(labels.join(moves, "node", "left").select("node", F.coalesce("target", "c").alias("c"), "k"))
            reached = self.modularity(labels)
            if reached > quality + GAIN:
                best, quality, stale = labels, reached, 0
            else:
                stale += 1
        return best, best is not None


def community_features(assigned: DataFrame, txn: DataFrame, label_cutoff=None) -> DataFrame:
    """Size and mean account label rate of each account's community.

    When no device is shared (one undivided community) the rate is 0.
    """
    rates = account_label_rate(txn, label_cutoff).select(
        F.col("account_id").cast("string").alias("account_id"), "account_fraud_rate"
    )
    rated = assigned.join(rates, "account_id", "left").fillna(0.0, ["account_fraud_rate"])
    totals = rated.groupBy("community_id").agg(
        F.count(F.lit(1)).alias("community_size"),
        F.avg("account_fraud_rate").alias("_rate"),
    )
    rate = F.when(F.col("community_id") == UNDIVIDED, F.lit(0.0)).otherwise(F.col("_rate"))
    return spread_join(assigned, totals, ["community_id"], ["account_id"], "inner", assigned).select(
        "account_id", "community_id", "community_size", rate.alias("community_fraud_rate")
    )


def community_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.countDistinct("community_id").alias("communities"),
        F.avg("community_size").alias("avg_community_size"),
        F.avg("community_fraud_rate").alias("avg_community_fraud_rate"),
    )


