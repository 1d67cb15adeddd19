"""Bounded walks over edges (src, dst[, id]): reachability, first paths, trails, roots, components.

A frontier, one row for each seed and node, meets the edges in an equi-join a round. A round's plan holds only the round
before it over plain scans of the edges. Walks of few seeds over many edges and loops to a fixpoint leave out what has been visited and
are settled in the shared folder each round; walks of roots and of whole paths are one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import settle

MAX_DEPTH = 6
#: Words of 64 bits in a row of marks.
WORDS = 16


def clamp(value: int | None, default: int, low: int = 1, high: int = MAX_DEPTH) -> int:
    return max(low, min(high, default if value is None else int(value)))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col(c).alias({"src": "dst", "dst": "src"}.get(c, c)) for c in edges.columns])


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in either direction, with `outbound` telling which is its own."""
    return edges.withColumn("outbound", F.lit(True)).unionByName(reverse(edges).withColumn("outbound", F.lit(False)))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, keep_seeds: bool = False, blocked: DataFrame | None = None) -> DataFrame:
    """(seed, id, hops): nodes within depth of each seed (seeds: id), at their fewest hops. A cycle does not lead back to the seed.

    blocked (id): nodes that no walk enters. A frontier holds only what is met for the first time and is settled, so that a small one
    is brought to the edges, not the edges to it."""
    e = edges.select("src", "dst")
    frontier = settle(seeds.select(F.col("id").alias("seed"), "id").distinct())
    seen = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        step = frontier.join(e, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()
        if blocked is not None:
            step = step.join(blocked.select("id"), "id", "left_anti")
        frontier = settle(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id"))
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return seen if keep_seeds else seen.where("hops > 0")


def first_paths(edges: DataFrame, seeds: DataFrame, depth: int, blocked: DataFrame | None = None) -> DataFrame:
    """(seed, id, hops, node_ids, rel_ids): for each seed and node one path of fewest hops, the least by its nodes, then its edges."""
    e = edges.select("id", "src", "dst").withColumnRenamed("id", "rel")
    if blocked is not None:
        e = e.join(blocked.select(F.col("id").alias("dst")), "dst", "left_anti")
    none = F.array().cast("array<string>")
    p = F.struct(F.lit(0).alias("hops"), F.array("id").alias("node_ids"), none.alias("rel_ids")).alias("p")
    frontier = seeds.select("id").distinct().select(F.col("id").alias("seed"), "id", p)
    seen = frontier
    for hop in range(1, depth + 1):
        step = frontier.join(e, F.col("id") == F.col("src")).select(
            "seed", F.col("dst").alias("id"), F.struct(F.lit(hop).alias("hops"), F.concat("p.node_ids", F.array("dst")).alias("node_ids"), F.concat("p.rel_ids", F.array("rel")).alias("rel_ids")).alias("p")
        )
        frontier = step.groupBy("seed", "id").agg(F.min("p").alias("p"))
        seen = seen.unionByName(frontier)
    return seen.groupBy("seed", "id").agg(F.min("p").alias("p")).select("seed", "id", "p.hops", "p.node_ids", "p.rel_ids").where("hops > 0")


def first_ways(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, hops, via): for each seed and node the nodes between them on one path of fewest hops, the least of these. What is met at a
    hop is left out of later ones; rows hold no edges, and neither end twice."""
    e, none = edges.select("src", "dst"), F.array().cast("array<string>")
    frontier = settle(seeds.select("id").distinct().select(F.col("id").alias("seed"), "id", none.alias("via")))
    seen, out = frontier.select("seed", "id"), None
    for hop in range(1, depth + 1):
        via = none if hop == 1 else F.concat("via", F.array("id"))
        one = frontier.join(e, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id"), via.alias("via")).groupBy("seed", "id").agg(F.min("via").alias("via")).join(seen, ["seed", "id"], "left_anti")
        frontier = settle(one) if hop < depth else one
        seen, one = seen.unionByName(frontier.select("seed", "id")), frontier.select("seed", "id", F.lit(hop).alias("hops"), "via")
        out = one if out is None else out.unionByName(one)
    return out


def steps(edges: DataFrame, seeds: DataFrame, depth: int, blocked: DataFrame | None = None) -> DataFrame:
    """(seed, id, hops, parent, rel): of each node within depth of a seed the node and edge before it on a path of fewest hops, of those
    the least. A row holds one step, however long the path; chains() reads paths back for the rows that are kept. Each hop is settled and
    holds only what is met for the first time. blocked (id): nodes that no walk enters; they are looked for in what a frontier meets, not in all edges."""
    e = edges.select(F.col("id").alias("rel"), "src", "dst")
    frontier = settle(seeds.select(F.col("id").alias("seed"), "id").distinct())
    seen, out = frontier, None
    for hop in range(1, depth + 1):
        met = frontier.join(e, F.col("id") == F.col("src")).groupBy("seed", "dst").agg(F.min(F.struct(F.col("id").alias("parent"), "rel")).alias("p"))
        one = met.select("seed", F.col("dst").alias("id"), F.lit(hop).alias("hops"), "p.parent", "p.rel").join(seen, ["seed", "id"], "left_anti")
        if blocked is not None:
            one = one.join(blocked.select("id"), "id", "left_anti")
        one = settle(one.select("seed", "id", "hops", "parent", "rel"))
        frontier, out = one.select("seed", "id"), one if out is None else out.unionByName(one)
        seen = seen.unionByName(frontier)
    return out


def chains(stepped: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """ends (seed, id and others) with node_ids and rel_ids of the way from id back to its seed. stepped: of steps(), best settled."""
    one = stepped.select("seed", F.col("id").alias("at"), "parent", "rel")
    now = ends.select("*", F.col("id").alias("at"), F.array("id").alias("node_ids"), F.array().cast("array<string>").alias("rel_ids"))
    for _ in range(depth):
        more = lambda name, x: F.when(F.col(x).isNotNull(), F.concat(name, F.array(x))).otherwise(F.col(name)).alias(name)
        now = now.join(one, ["seed", "at"], "left").select(*ends.columns, F.coalesce("parent", "at").alias("at"), more("node_ids", "parent"), more("rel_ids", "rel"))
    return now.drop("at")


def numbered(ids: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(id, block, bit): ids (id) in blocks of at most 64 * WORDS, each with a bit of its block. With edges, ids of like neighbours share a
    block, so that a block reaches a part of a large graph, not some of every part."""
    ids, size = settle(ids.select("id").where("id is not null").distinct()), 64 * WORDS
    k, row = F.monotonically_increasing_id(), (1 << 33) - 1
    blocks = ids.count() // (size * 15 // 16) + 1
    if edges is None or blocks == 1:
        at = ids.repartition(blocks).withColumn("k", k)
    else:
        near = edges.select(F.col("src").alias("id"), "dst").join(ids, "id", "left_semi").groupBy("id").agg(F.min("dst").alias("near"))
        at = settle(ids.join(near, "id", "left")).repartitionByRange(blocks, F.coalesce("near", "id"), "id").withColumn("k", k)
    within = F.col("k").bitwiseAND(row)
    return settle(at.select("id", (F.shiftright("k", 33) * 4096 + F.shiftright(within, 6 + WORDS.bit_length() - 1)).alias("block"), (within % size).cast("int").alias("bit")))


def marks(edges: DataFrame, asked: DataFrame, depth: int, ends: DataFrame) -> list[DataFrame]:
    """For 0, 1, .., depth hops (id, block, w0, w1, ..): which of asked (of numbered()) reach a node within so many hops, a bit for each. The
    last is of the nodes ends (id) alone. A hop makes a row an edge and block of asked, where pairs would make one an edge and asked node."""
    names = [f"w{i}" for i in range(WORDS)]
    own = [F.when(F.floor(F.col("bit") / 64) == i, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(names)]
    out = [settle(asked.select("id", "block", *own))]
    for hop in range(1, depth + 1):
        step = out[-1].join(edges.select("src", "dst"), F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "block", *names)
        every = out[-1].unionByName(step)
        if hop == depth:
            every = every.join(ends.select("id"), "id", "left_semi")
        out.append(settle(every.groupBy("id", "block").agg(*[F.bit_or(w).alias(w) for w in names])))
    return out


def has_mark(bit: Column) -> Column:
    """Whether a row of marks() has this bit."""
    return F.getbit(F.get(F.array(*[f"w{i}" for i in range(WORDS)]), F.floor(bit / 64).cast("int")), bit % 64) == 1


def nearest_chains(edges: DataFrame, ids: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """(seed, id, hops, reachable, node_ids, rel_ids): for each of ids the nearest of ends (id) but itself within depth, of equal ones the least; how
    many there are within depth; and the least of the shortest ways, from that end back to the seed. A row an edge and block of ids a hop."""
    asked = numbered(ids, edges)
    order = settle(ends.select("id").distinct().orderBy("id").withColumn("k", F.monotonically_increasing_id()))
    at = order.join(asked.select("id", F.col("block").alias("own"), F.col("bit").alias("own_bit")), "id", "left")
    by_hops, found = marks(edges, asked, depth, order), None
    for hop in range(1, depth + 1):
        word = by_hops[hop].join(at, "id").select("k", "block", "own", "own_bit", F.posexplode(F.array(*[f"w{i}" for i in range(WORDS)])).alias("word", "bits")).where("bits <> 0")
        each = word.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(F.getbit("bits", F.col("j")) == 1).withColumn("bit", F.col("word") * 64 + F.col("j"))
        one = each.where("own is null or own <> block or own_bit <> bit").groupBy("block", "bit").agg(F.min("k").alias("k"), F.count("*").alias("n")).withColumn("hops", F.lit(hop))
        found = one if found is None else found.unionByName(one)
    first = found.groupBy("block", "bit").agg(F.min("hops").alias("hops"), F.min_by("k", "hops").alias("k"), F.max("n").alias("reachable"))
    none = F.array().cast("array<string>").alias("rel_ids")
    now = settle(first.join(order, "k").join(asked.withColumnRenamed("id", "seed"), ["block", "bit"]).select("seed", "block", "bit", "id", "hops", "reachable", F.col("id").alias("at"), F.array("id").alias("node_ids"), none))
    for back in range(depth, 0, -1):
        e = edges.select(F.col("id").alias("rel"), F.col("src").alias("parent"), F.col("dst").alias("at"))
        step = now.where(F.col("hops") >= back).select("seed", "block", "bit", "at").join(e, "at")
        step = step.join(by_hops[back - 1].withColumnRenamed("id", "parent"), ["parent", "block"]).where(has_mark(F.col("bit"))).groupBy("seed").agg(F.min(F.struct("parent", "rel")).alias("p"))
        more = lambda name, x: F.when(F.col("p").isNotNull(), F.concat(name, F.array(x))).otherwise(F.col(name)).alias(name)
        now = settle(now.join(step, "seed", "left").select("seed", "block", "bit", "id", "hops", "reachable", F.coalesce("p.parent", "at").alias("at"), more("node_ids", "p.parent"), more("rel_ids", "p.rel")))
    return now.select("seed", "id", "hops", "reachable", "node_ids", "rel_ids")


def trails(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, hops, node_ids, rel_ids): every walk from each seed that uses no edge twice; nodes may come again."""
    e = edges.select(F.col("id").alias("rel"), "src", "dst")
    at = seeds.select(F.col("id").alias("seed"), "id", F.array("id").alias("node_ids"), F.array().cast("array<string>").alias("rel_ids"))
    out = None
    for hop in range(1, depth + 1):
        at = at.join(e, F.col("id") == F.col("src")).where(~F.array_contains("rel_ids", F.col("rel"))).select(
            "seed", F.col("dst").alias("id"), F.concat("node_ids", F.array("dst")).alias("node_ids"), F.concat("rel_ids", F.array("rel")).alias("rel_ids")
        )
        one = at.withColumn("hops", F.lit(hop))
        out = one if out is None else out.unionByName(one)
    return out


def nearest(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, seed, hops): for each node the nearest seed but itself, of equal ones the least, within depth.

    Two seeds a node go with the frontier, as the second serves nodes that are seeds themselves: a round makes at most two rows an
    edge, however many seeds there are. Nodes that have two are settled for good, as later rounds are farther: edges into them are
    left out of the rounds to come. Rows are dealt by node once a round, and each round is settled."""
    e = edges.select("src", "dst")
    two = Window.partitionBy("id").orderBy("hops", "seed")
    seen = settle(seeds.select("id", F.col("id").alias("seed"), F.lit(0).alias("hops")).distinct())
    for hop in range(1, depth + 1):
        frontier = seen.where(F.col("hops") == hop - 1).select("id", "seed")
        step = frontier.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "seed", F.lit(hop).alias("hops"))
        every = seen.unionByName(step).repartition("id").groupBy("id", "seed").agg(F.min("hops").alias("hops"))
        seen = settle(every.withColumn("k", F.row_number().over(two)).where("k <= 2").drop("k"))
        if hop < depth:
            full = seen.groupBy("id").agg(F.count("*").alias("n")).where("n = 2")
            e = settle(e.join(full.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst").distinct())
    return top(seen.where("seed <> id"), ["id"], [F.asc("hops"), F.asc("seed")], 1).drop("rank")


def nearest_to(edges: DataFrame, seeds: DataFrame, depth: int, ids: DataFrame) -> DataFrame:
    """nearest() of the nodes ids (id) alone. One hop is tried first, then two of those that have no seed yet, and so on; a try walks only
    edges into nodes from which what is left can be reached in the hops that remain, so few ids read few edges. Same rows as nearest()."""
    e, out = edges.select("src", "dst"), None
    left, seeds = settle(ids.select("id").distinct()), settle(seeds.select("id").distinct())
    for far in range(1, depth + 1):
        ways = [e.join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()]  # of the last hop, the one before, ..
        for _ in range(1, far):
            ways[-1] = settle(ways[-1])
            before = ways[-1].select(F.col("src").alias("dst")).distinct()
            ways.append(e.join(before, "dst", "left_semi").select("src", "dst").distinct())
        # two seeds a node, as in nearest(); what has none within far - 1 hops has its nearest at far, but rows of all nodes on the way count
        now = seeds.select("id", F.col("id").alias("seed"))
        for hop in range(far):
            step = now.join(ways[far - 1 - hop], F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "seed").distinct()
            now = settle(top(step, ["id"], [F.asc("seed")], 2).drop("rank"))
        found = settle(now.where("seed <> id").join(left, "id", "left_semi").groupBy("id").agg(F.min("seed").alias("seed")))
        one = found.withColumn("hops", F.lit(far)).select("id", "seed", "hops")
        out = one if out is None else out.unionByName(one)
        left = settle(left.join(found.select("id"), "id", "left_anti"))
        if not left.take(1):
            break
    return out


def roots(owns: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, root, hops): owners of each start, at fewest hops, that nobody owns. owns: owner src, owned dst."""
    e, frontier, up = reverse(owns.select("src", "dst")).distinct(), starts.select(F.col("id").alias("seed"), "id").distinct(), None
    for hop in range(1, depth + 1):
        frontier = frontier.join(e, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()
        one = frontier.withColumn("hops", F.lit(hop))
        up = one if up is None else up.unionByName(one)
    up = up.where("seed <> id").groupBy("seed", "id").agg(F.min("hops").alias("hops"))
    return up.join(owns.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select(F.col("seed").alias("id"), F.col("id").alias("root"), "hops")


def fixpoint(edges: DataFrame, seeds: DataFrame, enter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id): all that is reached from seeds, any number of hops; enter filters the nodes of a frontier."""
    e = edges.select("src", "dst").distinct()
    seen = settle(seeds.select("id").distinct())
    frontier = seen
    while True:
        step = frontier.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = settle(enter(step) if enter else step)
        if not frontier.take(1):
            return seen
        seen = settle(seen.unionByName(frontier))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component, by hanging nodes below the least neighbour in turns."""
    e = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct()
    e, before = settle(e), None
    while True:
        two = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = two.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = two.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = settle(small.where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return nodes.select("id").join(e.select(F.col("a").alias("id"), "b"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))
        before = now


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
