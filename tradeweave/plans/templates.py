"""The named query templates: (graph, parameters) to a lazy DataFrame. Depths are clamped to six."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CONTROL, Graph
from ..operators import walks as W


def _one(g: Graph, id_: str) -> DataFrame:
    return g.spark.createDataFrame([(id_,)], "id string")


def _suppliers(g: Graph, root: str, depth: int) -> DataFrame:
    """(id, tier): those that supply root through at most depth hops."""
    return W.reach(W.reverse(g.edges["SUPPLIES"]), _one(g, root), depth).select("id", F.col("hops").alias("tier"))


def _named(df: DataFrame, g: Graph, *more: str) -> DataFrame:
    return df.join(g.entity.select("id", "name", *more), "id")


def vendors_of(g: Graph, entity_id: str, depth: int = 3) -> DataFrame:
    """id, name, tier: each supplier at its least tier."""
    return _named(_suppliers(g, entity_id, W.clamp(depth, 3)), g).select("id", "name", "tier")


def vendors_of_paths(g: Graph, entity_id: str, depth: int = 3) -> DataFrame:
    """id, name, tier, path: a row for each path; a cycle of supply can lead back to the entity itself."""
    t = W.trails(W.reverse(g.edges["SUPPLIES"]), _one(g, entity_id), W.clamp(depth, 3))
    return _named(t, g).select("id", "name", F.col("hops").alias("tier"), F.array_join("node_ids", ">").alias("path"))


def color_by_category(g: Graph, entity_id: str, depth: int = 1) -> DataFrame:
    """id, bucket: what a vendor's categories are, by the kind of their topmost category."""
    parents = g.category.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    tops = W.roots(parents, g.category.select("id"), 4).join(g.category.select(F.col("id").alias("root"), F.col("kind").alias("top")), "root").groupBy("id").agg(F.min("top").alias("top"))
    kinds = g.category.select("id", "kind").join(tops, "id", "left").select(F.col("id").alias("dst"), F.coalesce("top", "kind").alias("kind"))
    of = g.edges["PROVIDES"].join(kinds, "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("kind").alias("kinds"))
    has = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
    bucket = F.when(has("goods") & has("services"), "both").when(has("goods"), "goods").when(has("services"), "services").otherwise("unknown")
    return _suppliers(g, entity_id, W.clamp(depth, 1)).join(of, "id", "left").select("id", bucket.alias("bucket"))


def at_place(code: Column, wanted: str) -> Column:
    w = wanted.upper() if len(wanted) <= 3 else wanted
    return (code == w) | code.startswith(w + "-") | (F.lower(code) == w.lower())


def manufactures_in(g: Graph, root_id: str, country: str, min_tier: int = 1, depth: int = 6) -> DataFrame:
    """id, name, tier, codes of suppliers from min_tier on that make things in a country."""
    made = g.edges["MANUFACTURES_IN"].where(at_place(F.col("code"), country)).groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return _named(_suppliers(g, root_id, W.clamp(depth, 6)).where(F.col("tier") >= W.clamp(min_tier, 1)).join(made, "id"), g).select("id", "name", "tier", "codes")


def _owning(g: Graph) -> DataFrame:
    return g.edge("OWNS", "ULTIMATE_PARENT_OF")


def ownership_chain(g: Graph, entity_id: str, depth: int = 6) -> DataFrame:
    """id, name, direction (up, down), hops, path, country: owners above and companies below, a row for each; no product of the two."""
    d = W.clamp(depth, 6)
    up = W.first_paths(W.reverse(_owning(g)), _one(g, entity_id), d).withColumn("direction", F.lit("up"))
    down = W.first_paths(_owning(g), _one(g, entity_id), d).withColumn("direction", F.lit("down"))
    seat = g.edges["INCORPORATED_IN"].groupBy(F.col("src").alias("id")).agg(F.min("code").alias("country"))
    return _named(up.unionByName(down), g).join(seat, "id", "left").select("id", "name", "direction", "hops", F.array_join("node_ids", ">").alias("path"), "country")


def shared_directors(g: Graph, root_id: str, depth: int = 3) -> DataFrame:
    """person_id, person, a_id, b_id: people with roles at two members of a supply chain."""
    members = _suppliers(g, root_id, W.clamp(depth, 3)).select("id").unionByName(_one(g, root_id)).distinct()
    seats = g.edges["HELD_ROLE"].join(members.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("person_id"), "dst").distinct()
    pairs = seats.withColumnRenamed("dst", "a_id").join(seats.withColumnRenamed("dst", "b_id"), "person_id").where("a_id < b_id")
    if "lei" in g.entity.columns:
        lei = g.entity.select("id", "lei")
        pairs = pairs.join(lei.toDF("a_id", "a_lei"), "a_id").join(lei.toDF("b_id", "b_lei"), "b_id").where("a_lei is null or b_lei is null or a_lei <> b_lei")
    return pairs.join(g.person.select(F.col("id").alias("person_id"), F.col("name").alias("person")), "person_id").select("person_id", "person", "a_id", "b_id")


def sole_source(g: Graph, root_id: str, depth: int = 3) -> DataFrame:
    """id, name, tier of suppliers that stand in some award of the chain as its only source: their own edge towards root is sole-source."""
    d = W.clamp(depth, 3)
    buyers = _suppliers(g, root_id, d - 1).unionByName(_one(g, root_id).withColumn("tier", F.lit(0))) if d > 1 else _one(g, root_id).withColumn("tier", F.lit(0))
    sole = g.edges["SUPPLIES"].where("sole_source").join(buyers.groupBy("id").agg(F.min("tier").alias("t")).withColumnRenamed("id", "dst"), "dst")
    return _named(sole.groupBy(F.col("src").alias("id")).agg((F.min("t") + 1).alias("tier")), g).select("id", "name", "tier")


def foreign_parent(g: Graph, root_id: str, home: str = "US", depth: int = 3) -> DataFrame:
    """id, name, tier, seat, parent_id: suppliers whose parent is seated abroad, with the topmost owner where one is known."""
    seat = g.edges["PARENT_SEATED_IN"].where(~F.col("code").startswith(home)).groupBy(F.col("src").alias("id")).agg(F.min("code").alias("seat"))
    found = _suppliers(g, root_id, W.clamp(depth, 3)).join(seat, "id")
    up = ultimate_parents(g, found.select("id"), 4).where("rank = 1").select("id", "parent_id")
    return _named(found.join(up, "id", "left"), g).select("id", "name", "tier", "seat", "parent_id")


def ultimate_parents(g: Graph, starts: DataFrame | None = None, depth: int = 6) -> DataFrame:
    """id, parent_id, parent, hops, rank: owners that nobody owns, nearest first."""
    found = W.roots(_owning(g), starts if starts is not None else g.entity.select("id"), W.clamp(depth, 6))
    named = found.join(g.entity.select(F.col("id").alias("root"), F.col("name").alias("parent")), "root")
    order = Window.partitionBy("id").orderBy("hops", F.asc_nulls_last("parent"), "root")
    return named.select("id", F.col("root").alias("parent_id"), "parent", "hops", F.row_number().over(order).alias("rank"))


def unscored_last() -> list[Column]:
    return [F.col("risk_score").isNull(), F.desc("risk_score"), F.desc_nulls_first("risk_confidence"), F.asc_nulls_last("name"), F.asc("id")]


def risk_ranked(g: Graph, root_id: str, band: str | None = None, limit: int = 100, depth: int = 6) -> DataFrame:
    """rank, id, name, tier, risk_score, risk_band, risk_confidence: worst first, unscored last but there. The rank is of the rows kept."""
    rows = _named(_suppliers(g, root_id, W.clamp(depth, 6)), g, "risk_score", "risk_band", "risk_confidence")
    if band:
        rows = rows.where(F.col("risk_band") == band)
    kept = rows.orderBy(*unscored_last()).limit(W.clamp(limit, 100, 1, 2000))
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*unscored_last())))  # limit rows


def near_designated(g: Graph, hops: int = 2) -> DataFrame:
    """seed, id, hops, path: entities and people within hops of a flagged party, over control, personnel and supply, either way."""
    flagged = g.entity.where("flagged").select("id").unionByName(g.person.where("flagged").select("id"))
    walk = W.both_ways(g.edge(*CONTROL, "SUPPLIES")).select("src", "dst")
    return W.first_ways(walk, flagged, W.clamp(hops, 2, 1, 3)).select("seed", "id", "hops", F.array_join(F.concat(F.array("seed"), "via", F.array("id")), ">").alias("path"))


def people_of(g: Graph, entity_id: str) -> DataFrame:
    """rank, person_id, person, title, from, to, current: one row a tenure, current and latest first."""
    rows = g.edges["HELD_ROLE"].where(F.col("dst") == entity_id).join(g.person.select(F.col("id").alias("src"), F.col("name").alias("person")), "src")
    order = Window.orderBy(F.desc_nulls_first("current"), F.desc_nulls_first("from"), F.asc_nulls_last("person"), "title")  # of one entity
    return rows.select("*", F.row_number().over(order).alias("rank")).select("rank", F.col("src").alias("person_id"), "person", "title", "from", "to", "current")


def as_of(date: str) -> Column:
    return (F.col("from").isNull() | (F.col("from") <= date)) & (F.col("to").isNull() | (F.col("to") >= date))


def as_of_board(g: Graph, entity_id: str, date: str) -> DataFrame:
    rows = g.edges["HELD_ROLE"].where((F.col("dst") == entity_id) & as_of(date))
    return rows.join(g.person.select(F.col("id").alias("src"), F.col("name").alias("person")), "src").select(F.col("src").alias("person_id"), "person", "title", "from", "to")


#: Edge types that a layer adds to a neighbourhood.
LAYERS = {"entities": ("SUPPLIES", "OWNS", "ULTIMATE_PARENT_OF", "MEMBER_OF", "TRANSACTS_WITH", "LOBBIES", "DONATED_TO"), "people": ("HELD_ROLE", "BENEFICIAL_OWNER_OF"), "countries": ("INCORPORATED_IN", "OPERATES_IN", "MANUFACTURES_IN", "PARENT_SEATED_IN"), "categories": ("PROVIDES", "SUBCATEGORY_OF"), "artifacts": ("ABOUT",), "claims": ("ASSERTS", "TARGETS", "EVIDENCES"), "reports": ("REPORTS_ON", "CITES")}


def neighbourhood(g: Graph, root: str, depth: int = 2, layers: tuple[str, ...] = ("entities",), program: str | None = None, risk_hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, hops; edges: id, src, dst, type) around root, over the types of the layers.

    With a program, no walk enters another program and ownership is walked upward only, so a shared owner does not pull in all it
    owns; then flagged parties within risk_hops of what is inside are added with the paths to them, avoiding other programs; and
    people with no risk are cut unless their layer is asked for."""
    types = [t for layer in layers for t in LAYERS[layer]]
    e = g.edge(*types)
    if program is None:
        inside = W.reach(W.both_ways(e), _one(g, root), W.clamp(depth, 2), keep_seeds=True).select("id", "hops")
        return inside, W.induced(e, inside)
    others = g.entity.where((F.col("kind") == "program") & (F.col("id") != program)).select("id")
    upward = ["OWNS", "ULTIMATE_PARENT_OF"]
    walk = W.both_ways(g.edge(*[t for t in types if t not in upward])).drop("outbound").unionByName(W.reverse(g.edge(*[t for t in types if t in upward])))
    inside = W.reach(walk, _one(g, root), W.clamp(depth, 2), keep_seeds=True, blocked=others).select("id", "hops")
    flagged = g.entity.where("flagged").select("id").unionByName(g.person.where("flagged").select("id"))
    back = W.both_ways(g.edge(*CONTROL, "SUPPLIES")).drop("outbound")
    paths = W.first_paths(back, flagged, W.clamp(risk_hops, 3, 1, 3), blocked=others).join(inside.select("id"), "id", "left_semi")
    nearest = W.top(paths, ["seed"], [F.asc("hops"), F.asc("node_ids")], 1)
    swept = nearest.select(F.explode("node_ids").alias("id")).distinct().withColumn("hops", F.lit(None).cast("int"))
    nodes = inside.unionByName(swept).groupBy("id").agg(F.min("hops").alias("hops"))
    return nodes, W.induced(g.edge(*dict.fromkeys([*types, *CONTROL, "SUPPLIES"])), nodes)


TEMPLATES: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (vendors_of, vendors_of_paths, color_by_category, manufactures_in, ownership_chain, shared_directors, sole_source, foreign_parent, risk_ranked, near_designated, people_of, as_of_board)}
TEMPLATES["neighbourhood"] = lambda g, **p: neighbourhood(g, **p)[0]


def run_template(g: Graph, name: str, **params) -> DataFrame:
    if name not in TEMPLATES:
        raise KeyError(f"no template {name}; there are {', '.join(TEMPLATES)}")
    return TEMPLATES[name](g, **params)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
