"""What a drawing of the graph hides: layers that are off, organisations that the chain doesn't reach, and those left with nothing to
hang off; risky nodes are pinned. Walks go to a fixpoint over tables, each round settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import walks as W

#: Layers of labels, kinds of artifacts that are sources, edges of the chain and those walked inward only, and
#: the score above which a node is pinned.
LAYER = {"Person": "people", "Location": "countries", "Category": "categories", "Artifact": "artifacts", "Claim": "claims", "Report": "reports"}
SOURCE_KINDS = ("record", "registry")
CHAIN, INWARD, PIN_FLOOR = ("SUPPLIES", "OWNS", "ULTIMATE_PARENT_OF"), ("OWNS", "ULTIMATE_PARENT_OF"), 20


def layer_of() -> Column:
    out = F.lit(None).cast("string")
    for label, layer in LAYER.items():
        out = F.when(F.col("label") == label, layer).otherwise(out)
    return F.when((F.col("label") == "Artifact") & F.coalesce("kind", F.lit("record")).isin(*SOURCE_KINDS), "sources").otherwise(out)


def _organisation() -> Column:
    return (F.col("label") == "Entity") & (F.coalesce("kind", F.lit("")) != "program")


def off(nodes: DataFrame, enabled: tuple[str, ...]) -> DataFrame:
    """id of the nodes whose layer isn't drawn."""
    return nodes.withColumn("layer", layer_of()).where(F.col("layer").isNotNull() & ~F.col("layer").isin(*enabled) if enabled else F.col("layer").isNotNull()).select("id")


def pinned(nodes: DataFrame, edges: DataFrame, hidden: DataFrame, floor: int = PIN_FLOOR) -> DataFrame:
    """id of organisations and people scored above the floor that some path joins to a supplier, through what is drawn or risky people."""
    risky = nodes.where((_organisation() | (F.col("label") == "Person")) & (F.coalesce("risk_score", F.lit(0)) > floor))
    drawn = nodes.join(hidden, "id", "left_anti").where("label in ('Entity', 'Person')").select("id")
    conducts = drawn.unionByName(risky.where("label = 'Person'").select("id")).distinct()
    suppliers = edges.where("type = 'SUPPLIES'").select(F.col("src").alias("id")).distinct().join(conducts, "id", "left_semi")
    reached = W.fixpoint(W.both_ways(edges.where("src <> dst")), suppliers, lambda f: f.join(conducts, "id", "left_semi"))
    return risky.select("id").join(reached, "id", "left_semi")


def indirect(nodes: DataFrame, edges: DataFrame, hidden: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """id of drawn organisations that no chain of contracts and ownership joins to a program or to keep (id); ownership leads upward only.
    Without a program or a kept node nothing is indirect."""
    drawn = nodes.join(hidden, "id", "left_anti").where("label = 'Entity'")
    anchors = drawn.where("kind = 'program'").select("id")
    if keep is not None:
        anchors = anchors.unionByName(keep.select("id").join(nodes.select("id"), "id", "left_semi")).distinct()
    chain = edges.where(F.col("type").isin(*CHAIN) & (F.col("src") != F.col("dst")))
    steps = W.reverse(chain).select("src", "dst").unionByName(chain.where(~F.col("type").isin(*INWARD)).select("src", "dst"))
    reached = W.fixpoint(steps, anchors, lambda f: f.join(drawn.select("id"), "id", "left_semi"))
    some = anchors.limit(1).select(F.lit(True).alias("some"))
    return drawn.where(_organisation()).select("id").join(reached, "id", "left_anti").join(F.broadcast(some)).select("id")  # one row, or none


def orphaned(nodes: DataFrame, edges: DataFrame, hidden: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """id of drawn organisations all of whose neighbours, of which they have some, are hidden."""
    ids = nodes.select("id")
    near = W.both_ways(edges.where("src <> dst").select("src", "dst")).select(F.col("src").alias("id"), F.col("dst").alias("other"))
    near = near.join(ids.withColumnRenamed("id", "other"), "other", "left_semi").distinct()
    seen = near.join(hidden.select(F.col("id").alias("other"), F.lit(True).alias("gone")), "other", "left").groupBy("id").agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("alone"))
    out = nodes.where(_organisation()).select("id").join(hidden, "id", "left_anti").join(seen.where("alone"), "id", "left_semi")
    return out.join(keep.select("id"), "id", "left_anti") if keep is not None else out


def hidden_nodes(g: Graph, enabled: tuple[str, ...] = (), show_indirect: bool = False, keep: DataFrame | None = None) -> DataFrame:
    """id of what isn't drawn. Pins are lifted last, so a pinned node brings nothing else back."""
    nodes, edges = g.nodes, g.all_edges
    layers = off(nodes, enabled)
    pins = pinned(nodes, edges, layers)
    gone = layers
    if not show_indirect:
        gone = gone.unionByName(indirect(nodes, edges, gone, keep)).distinct()
    gone = gone.unionByName(orphaned(nodes, edges, gone, keep)).distinct()
    return gone.join(pins, "id", "left_anti")
