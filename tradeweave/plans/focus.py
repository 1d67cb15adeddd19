"""What is drawn around a node: a walk bounded in hops and nodes, kept inside one program, with its risky nodes and without ordinary people.

Ties between organisations and of people are always walked; layers add more types. With a program no walk enters another one, ownership
is walked to the owners only, and every risky node is brought in on a shortest way back to the root, whatever the depth. Without
the people layer ordinary people are cut, and then what only they had tied in. Reports are entered, never left.

Nodes come in the order of (hops, id) up to the limit. Ways back are the least of the shortest. A root that isn't in the graph: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import walks as W
from ..operators.rounds import settle
from .layers import PIN_FLOOR

#: Types that are always walked, that each layer adds, that are walked against their direction alone.
TIES = ("SUPPLIES", "OWNS", "ULTIMATE_PARENT_OF", "MEMBER_OF", "TRANSACTS_WITH", "LOBBIES", "DONATED_TO")
PERSONAL = ("HELD_ROLE", "BENEFICIAL_OWNER_OF")
LAYERS = {
    "categories": ("PROVIDES", "SUBCATEGORY_OF"), "countries": ("INCORPORATED_IN", "OPERATES_IN", "MANUFACTURES_IN", "PARENT_SEATED_IN"),
    "artifacts": ("EVIDENCES", "ABOUT"), "sources": ("EVIDENCES", "ABOUT"), "claims": ("ASSERTS", "TARGETS", "EVIDENCES"),
}
OWNING, REPORTS = ("OWNS", "ULTIMATE_PARENT_OF"), ("REPORTS_ON", "CITES")
LIMIT = 400


def walked(layers: tuple[str, ...]) -> list[str]:
    """The types that are walked either way."""
    return list(dict.fromkeys([*TIES, *PERSONAL, *(t for layer in layers for t in LAYERS.get(layer, ()))]))


def risky(g: Graph, floor: int = PIN_FLOOR) -> DataFrame:
    """id of organisations scored over the floor, and of people who are flagged (people have no stored score)."""
    return g.entity.where(F.col("risk_score") > floor).select("id").unionByName(g.person.where("flagged").select("id"))


def _walk(g: Graph, types: list[str], layers: tuple[str, ...], upward: bool) -> DataFrame:
    one_way = [t for t in types if upward and t in OWNING]
    e = W.both_ways(g.edge(*[t for t in types if t not in one_way])).select("id", "src", "dst")
    against = [*one_way, *(REPORTS if "reports" in layers else ())]
    return e.unionByName(W.reverse(g.edge(*against)).select("id", "src", "dst"))


def focus(g: Graph, root: str, depth: int = 2, layers: tuple[str, ...] = (), program: str | None = None, limit: int = LIMIT, floor: int = PIN_FLOOR) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, hops, null for those brought in; edges: id, src, dst, type)."""
    types, start = walked(layers), g.entity.select("id").unionByName(g.person.select("id")).where(F.col("id") == root)
    blocked = settle(g.entity.where((F.col("kind") == "program") & (F.col("id") != program)).select("id")) if program else None
    inside = _walk(g, types, layers, bool(program))
    near = W.reach(inside, start, W.clamp(depth, 2), keep_seeds=True, blocked=blocked).select("id", "hops")
    nodes = settle(near.orderBy("hops", "id").limit(W.clamp(limit, LIMIT, 1, 5000)))
    edges = W.induced(g.all_edges, nodes)
    if program:
        free = W.both_ways(g.edge(*types)).select("id", "src", "dst")
        stepped = settle(W.steps(free, start, W.MAX_DEPTH, blocked))
        hot = stepped.join(risky(g, floor), "id", "left_semi").join(nodes.select("id"), "id", "left_anti").select("seed", "id")
        ways = settle(W.chains(stepped, hot, W.MAX_DEPTH).select("node_ids", "rel_ids"))
        brought = ways.select(F.explode("node_ids").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").withColumn("hops", F.lit(None).cast("int"))
        nodes = nodes.unionByName(brought)
        edges = edges.unionByName(g.all_edges.join(ways.select(F.explode("rel_ids").alias("id")).distinct(), "id", "left_semi").select(*edges.columns)).distinct()
    if "people" in layers:
        return nodes, edges
    ordinary = g.person.select("id").join(risky(g, floor), "id", "left_anti")
    kept = nodes.join(ordinary.where(F.col("id") != root), "id", "left_anti")
    edges = W.induced(edges, kept)
    tied = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().unionByName(start).distinct()
    return kept.join(tied, "id", "left_semi").select("id", "hops"), edges
