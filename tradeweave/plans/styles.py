"""How a graph is drawn after an ordered list of style operations, the scheme of risk bands, and what a live change adds to what is drawn.

Operations are rows (seq, op, scope and style), what they address by id rows (seq, id). A fold over them is order-dependent but needs no
order of execution: for each element the last value of each property after the last clear of its kind wins, and it is muted if its
last mute came after its last paint. Of operations that address a whole kind only the last clear, mute and hide of each kind count,
two rows that are broadcast. Unknown colours are neutral; ids that aren't drawn are ignored; equal seq: the greater value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import band_of
from ..model import Graph
from ..operators.rounds import settle

#: Colours, the ramp of bands with what the legend says, how many nodes a scheme paints.
PALETTE = ("neutral", "blue", "red", "orange", "yellow", "green", "teal", "purple", "pink")
RAMP = (("severe", "red", "Severe (75+)"), ("high", "orange", "High (50–74)"), ("elevated", "yellow", "Elevated (25–49)"), ("low", "green", "Low (0–24)"))
UNSCORED, PAINTED = "Unscored — nothing to grade", 2000
OPS = "seq int, op string, scope string, fill string, stroke string, badge string, size string, shape string, dashed boolean, label string"
PROPERTIES = ("fill", "stroke", "badge", "size", "shape")


def swatch(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin(*PALETTE), s).when(F.coalesce(s, F.lit("")) != "", "neutral")


def style_state(elements: DataFrame, ops: DataFrame, targets: DataFrame) -> DataFrame:
    """id, the PROPERTIES, dashed, highlight, dim, hide of each of elements (id, kind: nodes or edges). ops: OPS; targets: (seq, id)."""
    painting = F.col("op").isin("set", "highlight")
    given = targets.select("seq").distinct().withColumn("given", F.lit(True))
    every = ops.join(F.broadcast(given), "seq", "left")  # a row for each operation
    wide = every.where((F.col("op") == "clear") | (~painting & F.col("given").isNull()))
    kinds = wide.withColumn("kind", F.explode(F.when(F.coalesce("scope", F.lit("all")) == "all", F.array(F.lit("nodes"), F.lit("edges"))).otherwise(F.array("scope"))))
    last = lambda op: F.max(F.when(F.col("op") == op, F.col("seq")))
    by_kind = kinds.groupBy("kind").agg(last("clear").alias("cleared"), last("dim").alias("all_dim"), last("hide").alias("all_hide"))
    el = elements.join(F.broadcast(by_kind), "kind", "left").withColumn("cleared", F.coalesce("cleared", F.lit(-1)))
    met = targets.distinct().join(F.broadcast(ops.where(F.col("op") != "clear")), "seq").join(el.select("id", "cleared"), "id").where(F.col("seq") > F.col("cleared"))
    lastly = lambda c: F.max(F.when(painting & c.isNotNull(), F.struct("seq", c.alias("v"))))["v"]
    of = {"fill": swatch(F.col("fill")), "stroke": swatch(F.col("stroke"))} | {p: F.nullif(p, F.lit("")) for p in PROPERTIES[2:]}
    own = met.groupBy("id").agg(
        *[lastly(c).alias(p) for p, c in of.items()], F.bool_or(painting & F.coalesce("dashed", F.lit(False))).alias("dashed"), F.bool_or(F.col("op") == "highlight").alias("highlight"),
        F.max(F.when(painting, F.col("seq"))).alias("painted"), last("dim").alias("own_dim"), last("hide").alias("own_hide"),
    )
    all_ = el.join(own, "id", "left")
    muted, hidden = F.greatest("own_dim", F.when(F.col("all_dim") > F.col("cleared"), F.col("all_dim"))), F.greatest("own_hide", F.when(F.col("all_hide") > F.col("cleared"), F.col("all_hide")))
    no = F.lit(False)
    return all_.select("id", *PROPERTIES, F.coalesce("dashed", no).alias("dashed"), F.coalesce("highlight", no).alias("highlight"), F.coalesce(muted > F.coalesce("painted", F.lit(-1)), no).alias("dim"), hidden.isNotNull().alias("hide"))


def legend(ops: DataFrame, targets: DataFrame) -> DataFrame:
    """place, swatch, label, count of what was painted after the last clear of any kind, in the order it first was."""
    after = F.coalesce(ops.agg(F.max(F.when(F.col("op") == "clear", F.col("seq"))).alias("c")).select("c").scalar(), F.lit(-1))
    n = targets.groupBy("seq").agg(F.count("*").alias("n"))
    shown = F.coalesce(swatch(F.coalesce("fill", "stroke")), F.lit("neutral"))
    rows = ops.where(F.col("op").isin("set", "highlight") & (F.col("seq") > after)).join(n, "seq", "left").withColumn("swatch", shown)
    named = rows.withColumn("label", F.coalesce("label", "badge", F.initcap("swatch")))
    from pyspark.sql import Window

    groups = named.groupBy("swatch", "label").agg(F.min("seq").alias("first"), F.sum(F.coalesce("n", F.lit(0))).alias("count"))
    return groups.select(F.row_number().over(Window.orderBy("first", "label")).alias("place"), "swatch", "label", "count")  # a row for each kind of paint


def risk_scheme(g: Graph, limit: int = PAINTED) -> tuple[DataFrame, DataFrame]:
    """(OPS, targets) that paint the worst `limit` organisations and people by their band; unscored ones are outlined, never coloured."""
    rows = g.entity.select("id", "risk_score", "risk_band").unionByName(g.person.select("id", F.lit(None).cast("int").alias("risk_score"), F.lit(None).cast("string").alias("risk_band")))
    kept = rows.orderBy(F.col("risk_score").isNull(), F.desc("risk_score"), "id").limit(limit)
    band = F.when(F.col("risk_score").isNotNull(), F.coalesce("risk_band", band_of(F.col("risk_score"))))
    place = F.lit(len(RAMP))
    for k, (name, _, _) in enumerate(RAMP):
        place = F.when(band == name, k).otherwise(place)
    targets = settle(kept.select(place.alias("seq"), "id"))
    listed = [(k, "set", None, colour, None, None, None, None, None, label) for k, (_, colour, label) in enumerate(RAMP)] + [(len(RAMP), "set", None, None, "neutral", None, None, None, True, UNSCORED)]
    ops = g.spark.createDataFrame(listed, OPS).join(targets.select("seq").distinct(), "seq", "left_semi")
    return ops, targets


def apply_delta(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, changed: DataFrame, focus: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, fresh: id) after a change arrives: new_nodes (id, kind, ...) and new_edges (id, src, dst, ..., seq) around the nodes changed
    (id). Arriving rows replace drawn ones of their id. With a focus other programs stay out, and unless the change is about a node that isn't
    drawn yet, only what hangs on drawn nodes is taken: an edge passes on what came with the edges before it."""
    if focus:
        foreign = new_nodes.where((F.col("kind") == "program") & (F.col("id") != focus)).select("id")
        new_nodes = new_nodes.join(foreign, "id", "left_anti")
        new_edges = new_edges.join(foreign.toDF("src"), "src", "left_anti").join(foreign.toDF("dst"), "dst", "left_anti").select(*new_edges.columns)
        if not changed.join(nodes.select("id"), "id", "left_anti").take(1):
            either = settle(new_edges.select("src", "dst", "seq").unionByName(new_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "seq")))
            came = settle(new_nodes.join(nodes.select("id"), "id", "left_semi").select("id", F.lit(-1).alias("at")))
            while True:  # the earliest edge that each node comes with; a change holds a few thousand elements
                step = came.join(either, (F.col("id") == F.col("src")) & (F.col("seq") > F.col("at"))).select(F.col("dst").alias("id"), F.col("seq").alias("at"))
                now = settle(came.unionByName(step).groupBy("id").agg(F.min("at").alias("at")))
                if not now.exceptAll(came).take(1):
                    break
                came = now
            new_nodes = new_nodes.join(came.select("id"), "id", "left_semi")
    after = nodes.join(new_nodes.select("id"), "id", "left_anti").unionByName(new_nodes.select(*nodes.columns))
    met = edges.join(new_edges.select("id"), "id", "left_anti").unionByName(new_edges.select(*edges.columns))
    ids = after.select("id")
    tied = met.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select(*edges.columns)
    there = ids.unionByName(tied.select("id"))
    arrived = new_nodes.select("id").join(nodes.select("id"), "id", "left_anti").unionByName(new_edges.select("id").join(edges.select("id"), "id", "left_anti")).unionByName(changed.select("id")).distinct()
    return after, tied, arrived.join(there, "id", "left_semi")
