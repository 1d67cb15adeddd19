"""Findings of a risk assessment, its coverage and gaps, and pages of the graph's lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import walks as W
from ..operators.rounds import settle
from . import templates as T
from .layers import PIN_FLOOR, layer_of

#: Hops of a report, the score from which a supplier is a finding, how many findings and gaps it lists.
DEPTH, FLOOR, FINDINGS, GAPS, THIN = 4, 25, 25, 20, 60
#: What can be done about a finding, by dimension.
ACTIONS = {
    "designation": ("confirm the match with the issuing list", "stop new obligations and inform counsel", "trace what has shipped"),
    "proximity": ("confirm each hop still holds", "ask for disclosure in writing", "require notice of changes of control"),
    "foreign": ("get a registry extract of the ultimate parent", "check the sourcing rules before the next award", "consider a mitigation agreement"),
    "financial": ("ask for financials and confirm the registration", "hold stock for the time to replace", "add continuity terms"),
    "regional": ("establish where the work is done", "ask for a continuity plan and another site"),
    "dependency": ("measure the time to replace", "qualify a second source", "enter it in the risk register"),
    "media": ("read the coverage", "ask the supplier for its account"),
}
VERIFY, SECOND_SOURCE, ENRICH = "verify against the cited sources", "qualify an alternate for the sole-source award", "enrich the supplier so that it can be scored"


def base_of(g: Graph, subject: str, depth: int = DEPTH) -> DataFrame:
    """(seed, id, hops): the suppliers of the subject, up to depth tiers; written once, for what reads them again."""
    return settle(W.reach(W.reverse(g.edges["SUPPLIES"]), T._one(g, subject), W.clamp(depth, DEPTH)))


def supply_findings(g: Graph, subject: str, depth: int = DEPTH, floor: int = FLOOR, limit: int = FINDINGS, near: DataFrame | None = None) -> DataFrame:
    """rank, id, name, score, flagged, tier, path, rel_ids, sole_source, contracts, categories: suppliers of the subject that are scored from
    the floor on or flagged, worst first, each with its shortest route. Only the kept ones get routes. near: base_of() the subject, where it is known."""
    risky = g.entity.where((F.coalesce("risk_score", F.lit(-1)) >= floor) | F.coalesce("flagged", F.lit(False)))
    near = (base_of(g, subject, depth) if near is None else near).select("id", F.col("hops").alias("tier"))
    kept = near.where(F.col("id") != subject).join(risky.select("id", "name", "risk_score", "flagged"), "id").orderBy(F.desc(F.coalesce("risk_score", F.lit(0))), "name", "id").limit(limit)
    kept = settle(kept)
    chain = W.induced(g.edges["SUPPLIES"].select("id", "src", "dst"), near.select("id").unionByName(T._one(g, subject)))  # no way to the subject leaves its suppliers
    stepped = settle(W.steps(chain, kept, W.clamp(depth, DEPTH)))  # from the kept ones on, along what they supply
    ends = stepped.where(F.col("id") == subject).select("seed", "id")
    paths = W.chains(stepped, ends, W.clamp(depth, DEPTH)).select(F.col("seed").alias("id"), "node_ids", "rel_ids")
    hops = paths.select("id", F.posexplode("rel_ids").alias("at", "rel")).join(g.edges["SUPPLIES"].select(F.col("id").alias("rel"), "sole_source", "contract_ref"), "rel")
    along = hops.groupBy("id").agg(F.bool_or("sole_source").alias("sole_source"), F.array_join(F.array_sort(F.collect_list(F.struct("at", "contract_ref")))["contract_ref"], ",").alias("contracts"))
    goods = g.edges["PROVIDES"].withColumnRenamed("src", "id2").join(kept.select(F.col("id").alias("id2")), "id2", "left_semi").groupBy(F.col("id2").alias("id")).agg(F.count_distinct("dst").alias("categories"))
    rows = kept.join(paths.select("id", "node_ids", "rel_ids"), "id").join(along, "id", "left").join(goods, "id", "left")
    order = Window.orderBy(F.desc(F.coalesce("risk_score", F.lit(0))), "tier", "name", "id")  # limit rows
    return rows.select(
        F.row_number().over(order).alias("rank"), "id", "name", F.col("risk_score").alias("score"), "flagged", "tier", F.array_join("node_ids", ">").alias("path"),
        F.coalesce("sole_source", F.lit(False)).alias("sole_source"), "contracts", F.coalesce("categories", F.lit(0)).alias("categories"),
    )


def coverage(g: Graph, subject: str, depth: int = DEPTH, near: DataFrame | None = None) -> DataFrame:
    """suppliers, scored, unscored, thin, flagged: how much of the supply base has been looked at."""
    near = (base_of(g, subject, depth) if near is None else near).join(g.entity, "id")
    scored = F.col("risk_score").isNotNull()
    return near.agg(
        F.count("*").alias("suppliers"), F.count_if(scored).alias("scored"), F.count_if(~scored).alias("unscored"),
        F.count_if(scored & (F.coalesce("risk_confidence", F.lit(0)) < THIN)).alias("thin"), F.count_if(F.coalesce("flagged", F.lit(False))).alias("flagged"),
    )


def unscreened_sole_sources(g: Graph, subject: str, depth: int = DEPTH, limit: int = GAPS, near: DataFrame | None = None) -> DataFrame:
    """rank, id, name, consumer, contract_ref, tier: suppliers in the chain without a score that are some consumer's only source."""
    near = (base_of(g, subject, depth) if near is None else near).select("id")
    blind = near.join(g.entity.where("risk_score is null").select("id", "name"), "id")
    sole = g.edges["SUPPLIES"].where("sole_source").select(F.col("src").alias("id"), F.col("dst").alias("to"), "contract_ref", "tier")
    rows = blind.join(sole, "id").join(g.entity.select(F.col("id").alias("to"), F.col("name").alias("consumer")), "to")
    order = [F.asc(F.coalesce("tier", F.lit(9))), F.asc("name"), F.asc("consumer"), F.asc("contract_ref")]
    kept = rows.orderBy(*order).limit(limit)
    return kept.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "id", "name", "consumer", "contract_ref", "tier")  # limit rows


def mitigations(findings: DataFrame, drivers: DataFrame) -> DataFrame:
    """id, step, action: what to do about each finding (id, flagged, sole_source, score); drivers: id, dimension, in order of `place`."""
    actions = F.create_map(*[x for d, a in ACTIONS.items() for x in (F.lit(d), F.array(*map(F.lit, a)))])
    of = drivers.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("place", "dimension")))["dimension"].alias("dims"))
    none = F.array().cast("array<string>")
    dims = F.coalesce("dims", none)
    every = F.flatten(F.transform(dims, lambda d: F.coalesce(actions[d], none)))
    flag = F.when(F.coalesce("flagged", F.lit(False)) & ~F.array_contains(dims, "designation"), actions[F.lit("designation")]).otherwise(none)
    sole = F.when(F.coalesce("sole_source", F.lit(False)), F.array(F.lit(SECOND_SOURCE))).otherwise(none)
    thin = F.when(F.coalesce("score", F.lit(0)) == 0, F.array(F.lit(ENRICH))).otherwise(none)
    steps = F.array_distinct(F.concat(F.array(F.lit(VERIFY)), every, flag, sole, thin))
    return findings.join(of, "id", "left").select("id", F.posexplode(steps).alias("step", "action"))


def entities_page(g: Graph, q: str | None = None, kind: str | None = None, flagged: bool | None = None, band: str | None = None, sort: str = "tier", limit: int = 100, offset: int = 0) -> DataFrame:
    """rank, id, name, kind, risk_score, tier, total: a page of entities that meet all filters, by least tier or by risk; total counts all."""
    conditions = [F.lit(True)]
    if q:
        conditions.append(F.lower("name").contains(q.lower()))
    if kind:
        conditions.append(F.col("kind") == kind)
    if flagged is not None:
        conditions.append(F.coalesce("flagged", F.lit(False)) == flagged)
    if band:
        conditions.append(F.col("risk_band") == band)
    tiers = g.edges["SUPPLIES"].groupBy(F.col("src").alias("id")).agg(F.min("tier").alias("tier"))
    rows = g.entity.where(T.all_of(conditions)).join(tiers, "id", "left")
    order = [F.col("risk_score").isNull(), F.desc("risk_score"), F.asc("name"), F.asc("id")] if sort == "risk" else [F.asc_nulls_last("tier"), F.asc("name"), F.asc("id")]
    total = g.entity.where(T.all_of(conditions)).count()
    kept = rows.orderBy(*order).limit(offset + W.clamp(limit, 100, 1, 1000))
    ranked = kept.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "id", "name", "kind", "risk_score", "tier", F.lit(total).alias("total"))  # a page's rows
    return ranked.where(F.col("rank") > offset)


def whole_graph(g: Graph, layers: tuple[str, ...] = ("people", "reports"), limit: int = 1500) -> DataFrame:
    """id, label, name: entities, the layers asked for and risky people, by label and name, limit of them."""
    n = g.nodes.withColumn("layer", layer_of())
    wanted = F.col("layer").isNull() | F.col("layer").isin(*layers) | ((F.col("label") == "Person") & (F.coalesce("risk_score", F.lit(0)) > PIN_FLOOR))
    place = F.lit(6)
    for i, label in enumerate(("Entity", "Report", "Person", "Location", "Category", "Artifact")):
        place = F.when(F.col("label") == label, i).otherwise(place)
    return n.where(wanted).orderBy(place, F.coalesce("name", "id"), "id").limit(min(limit, 5000)).select("id", "label", "name")


def person_page(g: Graph, person_id: str) -> DataFrame:
    """entity_id, entity, title, from, to, current, colleagues: a person's tenures and how many others hold seats there."""
    mine = g.edges["HELD_ROLE"].where(F.col("src") == person_id)
    others = g.edges["HELD_ROLE"].where(F.col("src") != person_id).join(mine.select("dst").distinct(), "dst", "left_semi").groupBy("dst").agg(F.count_distinct("src").alias("colleagues"))
    named = mine.join(others, "dst", "left").join(g.entity.select(F.col("id").alias("dst"), F.col("name").alias("entity")), "dst")
    return named.select(F.col("dst").alias("entity_id"), "entity", "title", "from", "to", "current", F.coalesce("colleagues", F.lit(0)).alias("colleagues"))
