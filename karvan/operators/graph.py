"""Connected components and constrained merging as DataFrame loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karvan.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each component.

    A node whose only neighbour is smaller has that neighbour's component and can be nobody's
    smallest node, so such leaves (all of a star but its centre) are set aside in one pass and
    named at the end; the rest goes through rounds. Edges are read once and stored.
    """
    stored = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    both = stored.unionByName(stored.select(F.col("v").alias("u"), F.col("u").alias("v")))
    other = F.when(F.col("u") != F.col("v"), F.col("v"))
    nodes = both.groupBy("u").agg(F.min(other).alias("lo"), F.max(other).alias("hi"))
    hangs = (F.col("lo") == F.col("hi")) & (F.col("u") > F.col("lo"))
    anchored = cut_lineage(nodes.select(F.col("u").alias("node"), F.when(hangs, F.col("lo")).alias("anchor")))
    leaves = anchored.where("anchor IS NOT NULL").select(F.col("node").alias("u"))
    ordered = stored.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    core = _components_of_core(ordered.join(leaves, "u", "left_anti")).withColumnRenamed("node", "anchor")
    named = anchored.withColumn("anchor", F.coalesce("anchor", "node")).join(core, "anchor", "left")
    return named.select("node", F.coalesce("component", "anchor").alias("component"))


def _components_of_core(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (u, v).

    Alternating large-star / small-star. Both steps are a map-side-combined minimum
    per node and one equi-join, so a hub with a third of the edges is reduced before
    the shuffle and its fan-out is an ordinary skewed join for AQE to split. Each round
    is written to the checkpoint folder; the driver only sees a count and a hash.
    """
    current = edges.distinct()
    current = cut_lineage(current)
    before = _state(current)
    while True:  # every round that is not the last lowers some label
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        current = cut_lineage(small.where("u <> v").distinct())
        after = _state(current)
        if after == before:
            return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = after


def constrained_components(edges: DataFrame, cannot_link: DataFrame) -> DataFrame:
    """Components over scored edges in which no forbidden pair ends up together.

    The result is that of taking edges best first and skipping each that would join a
    forbidden pair, done in parallel. Two kinds of edges cannot be affected by any other
    merge and are taken at once each round: the best edge of a cluster that is in no
    forbidden pair, and an edge that is the best valid one for both of its clusters.
    Only components that hold a forbidden pair enter the loop.

    ``edges``: a, b, score. ``cannot_link``: a, b.
    """
    plain = cut_lineage(connected_components(edges))
    tagged = cannot_link.join(plain.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(
        plain.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b"
    )
    troubled = tagged.where("ca = cb").select(F.col("ca").alias("component")).distinct()
    calm = plain.join(troubled, "component", "left_anti").select("node", "component")
    label = cut_lineage(
        plain.join(troubled, "component", "left_semi").select("node", F.col("node").alias("cluster"))
    )
    inside = label.select("node")

    def within(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(inside, F.col(end) == F.col("node"), "left_semi")
        return pairs

    tie = F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
    rated = within(edges).withColumn("tie", tie)
    live = _best_between(rated.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("score", "tie").alias("r")))
    one_way = within(cannot_link.select("a", "b"))
    walls = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))
    forbidden = cut_lineage(walls.select(F.col("a").alias("ca"), F.col("b").alias("cb")).distinct())
    # Edges and walls are those of the clusters, and get fewer with them; what became of a cluster
    # in a round is remembered, and followed from the last round back to the nodes.
    rounds: list[DataFrame] = []
    while True:  # every round but the last merges clusters
        live = cut_lineage(live.join(forbidden, (F.col("x") == F.col("ca")) & (F.col("y") == F.col("cb")), "left_anti"))
        ends = live.select(F.explode(F.array("x", "y")).alias("c"), F.struct("r", "x", "y").alias("e"))
        best = ends.groupBy("c").agg(F.max("e").alias("e"))
        free = best.join(forbidden.select(F.col("ca").alias("c")).distinct(), "c", "left_anti")
        mutual = best.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        chosen = free.select("e").unionByName(mutual.select("e")).select("e.x", "e.y").distinct()
        chosen = cut_lineage(chosen)
        if chosen.isEmpty():
            break
        merged = cut_lineage(connected_components(chosen, "x", "y").withColumnRenamed("node", "cluster"))
        rounds.append(merged)
        live = _best_between(_renamed(_renamed(live, "x", merged), "y", merged))
        forbidden = cut_lineage(_renamed(_renamed(forbidden, "ca", merged), "cb", merged).distinct())
    while len(rounds) > 1:
        later, earlier = rounds.pop(), rounds.pop()
        untouched = later.join(earlier.select("cluster"), "cluster", "left_anti")
        rounds.append(cut_lineage(_renamed(earlier, "component", later).unionByName(untouched)))
    named = label.select("node", F.col("node").alias("component"))
    return calm.unionByName(_renamed(named, "component", rounds[0]) if rounds else named)


def _best_between(edges: DataFrame) -> DataFrame:
    """The best edge (x, y, r) between every two clusters."""
    some = edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "r")
    return some.groupBy("x", "y").agg(F.max("r").alias("r"))


def _renamed(rows: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    """``rows`` with the clusters of ``column`` called by their component in ``merged`` (cluster, component)."""
    new = merged.select(F.col("cluster").alias(column), F.col("component").alias("__new"))
    columns = [F.coalesce("__new", column).alias(c) if c == column else F.col(c) for c in rows.columns]
    return rows.join(new, column, "left").select(*columns)


def star_edges(rows: DataFrame, group: list[str], node: str) -> DataFrame:
    """Connect every node of a group to its smallest node: n-1 edges, not n squared."""
    centers = rows.groupBy(*group).agg(F.min(node).alias("a"))
    return (
        rows.join(centers, group)
        .where(F.col(node) != F.col("a"))
        .select("a", F.col(node).alias("b"))
        .distinct()
    )


#: Words of 64 bits in the signature of a set.
SIGNATURE_WORDS = 4


def _signature(token: str) -> list[Column]:
    """Aggregates over the tokens of a set: the words of a bitmap that holds a bit per hashed token."""
    place = F.pmod(F.xxhash64(token), F.lit(64 * SIGNATURE_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    none = F.lit(0).cast("long")
    return [F.bit_or(F.when(F.floor(place / 64) == i, bit).otherwise(none)).alias(f"b{i}") for i in range(SIGNATURE_WORDS)]


def pairs_of_similar_sets(
    sets: DataFrame, block: list[str], item: str, tokens: str, threshold: float
) -> DataFrame:
    """Exact Jaccard join inside blocks by prefix filtering.

    A pair that reaches the threshold has its rarest common token among the rarest
    ``n - ceil(2t / (1 + t) * n) + 1`` of the smaller set and ``n - ceil(t * n) + 1`` of the larger,
    so only those are joined on. What the places of the token and the bitmaps of both sets leave
    possible is looked at before the sets themselves are. Emits (block..., x, y, similarity) with
    x < y. ``sets`` must hold distinct items, and every survivor is verified on the full sets.
    """
    rows = sets.select(*block, item, F.array_distinct(tokens).alias("t")).where(F.size("t") > 0)
    exploded = rows.select(*block, item, F.explode("t").alias("tok"))
    weight = exploded.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    words = [f"b{i}" for i in range(SIGNATURE_WORDS)]
    ordered = exploded.join(weight, "tok").groupBy(*block, item).agg(
        F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("s"), *_signature("tok")
    )
    bits = lambda w: sum((F.bit_count(c) for c in w[1:]), F.bit_count(w[0]))
    full = ordered.select(
        *block, item, F.transform("s", lambda x: x["tok"]).alias("t"), F.size("s").alias("n"), *words,
        (F.size("s") - bits([F.col(w) for w in words])).alias("c"),
    )

    def prefix(share: float, side: str) -> DataFrame:
        """Each of the first tokens of a set that keeps ``share`` of it behind them."""
        keep = F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9).cast("int") + 1
        cut = full.select("*", F.posexplode(F.slice("t", F.lit(1), keep)).alias("p", "tok"))
        named = [F.col(k).alias(f"{k}{side}") for k in ("t", "n", "c", "p", *words)]
        return cut.select(*block, "tok", F.col(item).alias(f"i{side}"), *named)

    left, right = prefix(2 * threshold / (1 + threshold), "x"), prefix(threshold, "y")
    once = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("ix") < F.col("iy")))
    need = F.lit(threshold / (1 + threshold)) * (F.col("nx") + F.col("ny")) - 1e-6
    behind = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))  # the joined token and what follows it
    # Tokens that share a bit inside one set are at most ``c`` more than the bits show.
    shared = bits([F.col(f"{w}x").bitwiseAND(F.col(f"{w}y")) for w in words]) + F.least("cx", "cy")
    both = F.size(F.array_intersect("tx", "ty"))
    # A pair meets once per shared prefix token; it is kept only at the first of them.
    first = F.element_at(F.array_intersect("tx", "ty"), 1)
    return (
        left.join(right, [*block, "tok"])
        .where(once & (behind >= need) & (shared >= need))
        .withColumn("similarity", both / (F.col("nx") + F.col("ny") - both))
        .where((F.col("similarity") >= threshold) & (F.col("tok") == first))
        .select(*block, F.least("ix", "iy").alias("x"), F.greatest("ix", "iy").alias("y"), "similarity")
    )
