"""Why a node has its score: for each dimension its grade, what it rests on in words, and the nodes and edges it was read from.

All of it is computed for the nodes asked about alone: their claims, places and signs, the chain to the nearest designated party read
back from a table of steps, and the suppliers that carry most of a consumer's exposure. Grades are those of rescore(): suppliers
count with the scores they have stored. A dimension without data has no severity, and says so. Ties are broken by id.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import PERSON_DIMENSIONS, WEIGHTS, placed
from ..model import Graph
from ..operators import walks as W
from ..operators.rounds import settle
from . import profiles as P
from . import risk as R

TOP = 3
EXPLAINED = ("id", "dimension", "severity", "weight", "label", "detail", "source", "element_ids")


def drivers(weighted: DataFrame, scores: DataFrame, k: int = TOP) -> DataFrame:
    """consumer, rank, id, edge_id, sole, weight, score, part of the k suppliers (with a score) that carry most of each consumer's exposure."""
    met = weighted.join(scores.where("score is not null"), "id").withColumn("part", F.round(F.col("weight") * F.col("score"), 3))
    return W.top(met, ["consumer"], [F.desc("part"), F.asc("id"), F.asc("edge_id")], k).select("consumer", "rank", "id", "edge_id", "sole", "weight", "score", "part")


def _joined(c: Column, sep: str = " · ") -> Column:
    return F.nullif(F.array_join(F.array_sort(F.collect_set(c)), sep), F.lit(""))


def _plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))


def _names(g: Graph) -> DataFrame:
    return g.entity.select("id", F.coalesce("name", "id").alias("name")).unionByName(g.person.select("id", F.coalesce("name", "id").alias("name")))


def _said(g: Graph) -> DataFrame:
    """id, predicate, source, value, detail of the latest committed screens by source."""
    rows = g.claim.where(F.col("predicate").endswith("_screen") & (F.col("status") == "committed"))
    first = W.top(rows.withColumn("source", F.coalesce("source", F.lit(""))), ["subject_id", "predicate", "source"], [F.desc_nulls_first("retrieved_at"), F.asc("id")], 1)
    return first.select(F.col("subject_id").alias("id"), "predicate", "source", F.col("object_value").alias("value"), "detail", "retrieved_at", F.col("id").alias("claim_id"))


def designation(part: Graph) -> DataFrame:
    hit = F.col("value") == "hit"
    ran = _said(part).where(F.col("predicate").isin(*P.DESIGNATING)).groupBy("id").agg(
        F.count("*").alias("n"), _joined(F.when(hit, F.col("source"))).alias("by"), _joined("source").alias("sources"), _joined(F.when(hit, F.col("detail")), "; ").alias("hits"), _joined("detail", "; ").alias("details"), F.bool_or(hit).alias("hit")
    )
    rows = R._nodes(part).join(ran, "id", "left")
    flagged, listed = F.coalesce("flagged", F.lit(False)), F.coalesce("hit", F.lit(False))
    label = F.when(listed, F.concat(F.lit("Designated by "), F.coalesce("by", F.lit("a list")))).when(flagged, "Flagged in the graph").when(F.col("n") > 0, F.concat(F.lit("Clear on "), _plural(F.col("n"), "list"))).otherwise("Not screened against any list")
    return rows.select("id", label.alias("label"), F.when(listed, F.col("hits")).when(~flagged, F.col("details")).alias("detail"), F.when(listed, F.col("by")).when(flagged, "graph").otherwise(F.col("sources")).alias("source"), F.array("id").alias("element_ids"))


def proximity(g: Graph, part: Graph, near: DataFrame) -> DataFrame:
    """near: of proximity_of()."""
    named = near.select("id", F.posexplode("node_ids").alias("at", "node")).join(_names(g).withColumnRenamed("id", "node"), "node", "left")
    chain = named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", "node").alias("name")))), lambda x: x["name"]), " → ").alias("chain"))
    rows = R._nodes(part).select("id").join(near.join(chain, "id").join(_names(g).select(F.col("id").alias("seed"), F.col("name").alias("seed_name")), "seed", "left"), "id", "left")
    against, more = ~F.col("downstream"), F.col("reachable") - 1
    label = F.concat(_plural(F.col("hops"), "hop"), F.lit(" from "), F.coalesce("seed_name", "seed"), F.when(against, " (against the flow of supply)").otherwise(""))
    detail = F.concat(F.col("chain"), F.when(more > 0, F.concat(F.lit(" · "), more.cast("string"), F.lit(" more within reach"))).otherwise(""))
    none = F.lit(f"No designated party within {R.HOPS} hops")
    return rows.select("id", F.coalesce(label, none).alias("label"), detail.alias("detail"), F.lit("graph").alias("source"), F.coalesce(F.concat("node_ids", "rel_ids"), F.array("id")).alias("element_ids"))


def _places(g: Graph, ids: DataFrame) -> DataFrame:
    """id, code, why, via, country, class, opaque, conflict, hazard of the places that ids are tied to."""
    kinds = {"INCORPORATED_IN": "incorporated in", "PARENT_SEATED_IN": "parent seated in", "MANUFACTURES_IN": "manufactures in", "OPERATES_IN": "operates in"}
    rows, none = None, F.lit(None).cast("string").alias("via")
    for type_, why in kinds.items():
        one = R._of(g.edges[type_].select(F.col("src").alias("id"), "code", F.lit(why).alias("why"), none), ids)
        rows = one if rows is None else rows.unionByName(one)
    home = g.edges["INCORPORATED_IN"].groupBy(F.col("src").alias("via")).agg(F.min("code").alias("code"))
    from .templates import ultimate_parents

    up = ultimate_parents(g, ids).select("id", F.col("parent_id").alias("via")).join(home, "via").select("id", "code", F.lit("ultimate parent incorporated in").alias("why"), "via")
    return placed(rows.unionByName(up).distinct())


def foreign(part: Graph, places: DataFrame) -> DataFrame:
    """places: of _places()."""
    known = places.where(F.col("class").isNotNull()).withColumn("r", R._class_rank())
    order = F.struct(-F.col("r"), "code", "why")
    of = known.groupBy("id").agg(
        F.min_by(F.struct("code", "why", "class", "r", "via"), order).alias("w"), F.min_by(F.struct("code", "via"), F.when(F.coalesce("opaque", F.lit(False)), order)).alias("o"), F.array_sort(F.collect_set("code")).alias("codes")
    )
    hidden = (F.col("w.r") < 2) & F.col("o").isNotNull()
    code = F.when(hidden, F.col("o.code")).otherwise(F.col("w.code"))
    label = F.when(hidden, F.concat(F.lit("Control passes through "), code, F.lit(", whose registry publishes no owners"))).otherwise(F.concat(F.col("w.why"), F.lit(" "), code, F.lit(" ("), F.col("w.class"), F.lit(")")))
    others = F.array_join(F.filter("codes", lambda x: x != code), ", ")
    via = F.when(hidden, F.col("o.via")).otherwise(F.col("w.via"))
    rows = R._nodes(part).where("label = 'Entity'").select("id").join(of, "id", "left")
    return rows.select("id", F.coalesce(label, F.lit("No known jurisdiction")).alias("label"), F.when(others != "", F.concat(F.lit("also "), others)).alias("detail"), F.lit("jurisdictions").alias("source"), F.array_compact(F.array("id", via)).alias("element_ids"))


def person_foreign(g: Graph, part: Graph) -> DataFrame:
    current = F.coalesce("current", F.col("to").isNull())
    roles = part.edges["HELD_ROLE"].select(F.col("src").alias("person"), F.col("dst").alias("seat"), current.alias("now"))
    chosen = roles.join(roles.groupBy("person").agg(F.bool_or("now").alias("any")), "person").where("now or not any").select("person", "seat", "any").distinct()
    seats = settle(chosen.select(F.col("seat").alias("id")).distinct())
    at = placed(R._seats(g, seats)).where(F.col("class").isNotNull()).withColumn("r", R._class_rank())
    met = chosen.join(at.withColumnRenamed("id", "seat"), "seat").join(g.entity.select(F.col("id").alias("seat"), F.coalesce("name", "id").alias("where")), "seat")
    of = met.groupBy(F.col("person").alias("id")).agg(F.min_by(F.struct("code", "class", "where", "seat", "any"), F.struct(-F.col("r"), "code", "seat")).alias("w"))
    label = F.concat(F.when(F.col("w.any"), "holds").otherwise("held"), F.lit(" a seat at "), F.col("w.where"), F.lit(" — "), F.col("w.code"), F.lit(" ("), F.col("w.class"), F.lit(")"))
    rows = R._nodes(part).where("label = 'Person'").select("id").join(of, "id", "left")
    return rows.select("id", F.coalesce(label, F.lit("No seat in a known jurisdiction")).alias("label"), F.lit(None).cast("string").alias("detail"), F.lit("jurisdictions").alias("source"), F.array_compact(F.array("id", "w.seat")).alias("element_ids"))


def regional(part: Graph, places: DataFrame) -> DataFrame:
    at = places.where(F.col("why").isin("manufactures in", "operates in")).withColumn("made", F.col("why") == "manufactures in")
    conflict = F.when(F.col("conflict") == "high", F.when(F.col("made"), 3).otherwise(2)).when(F.col("conflict").isNotNull(), 1)
    hazard = F.when(F.col("hazard") == "low", F.when(F.col("conflict").isNull(), 0)).when(F.col("hazard") == "high", F.when(F.col("made"), 2).otherwise(1)).when(F.col("hazard").isNotNull(), 1)
    each = at.withColumns({"c": conflict, "h": hazard}).withColumn("r", F.greatest("c", "h"))
    what = F.when(F.col("r") == 0, "calm").when(F.coalesce(F.col("c") == F.col("r"), F.lit(False)), "armed conflict").otherwise("natural hazard")
    of = each.groupBy("id").agg(F.min_by(F.struct("code", "why", what.alias("what")), F.when(F.col("r").isNotNull(), F.struct(-F.col("r"), "code", "why"))).alias("w"), _joined(F.when(F.col("r") > 0, F.col("code")), ", ").alias("codes"), _joined("code", ", ").alias("all"))
    label = F.when(F.col("w").isNotNull(), F.concat(F.col("w.why"), F.lit(" "), F.col("w.code"), F.lit(" — "), F.col("w.what"))).when(F.col("all").isNotNull(), F.concat(F.lit("No reference for "), F.col("all"))).otherwise("No place of work on record")
    rows = R._nodes(part).where("label = 'Entity'").select("id").join(of, "id", "left")
    return rows.select("id", label.alias("label"), F.when(F.col("codes").isNotNull(), F.concat(F.lit("exposed in "), F.col("codes"))).alias("detail"), F.lit("regions").alias("source"), F.array("id").alias("element_ids"))


def financial(part: Graph, today: datetime.date) -> DataFrame:
    e, signs, well = R.financial_signs(part, today)
    found = F.filter(F.array(*[F.struct(rank.alias("rank"), text.alias("text")) for rank, text in signs]), lambda x: x["rank"].isNotNull())
    label = F.when(F.size("f") == 1, F.get("f", F.lit(0))["text"]).when(F.size("f") > 1, F.concat(F.size("f").cast("string"), F.lit(" signs of distress"))).when(F.col("well") == 0, "No sign of distress").otherwise("No filings, registration or screen")
    return e.select("id", found.alias("f"), well.alias("well")).select("id", label.alias("label"), F.nullif(F.array_join(F.transform("f", lambda x: x["text"]), "; "), F.lit("")).alias("detail"), F.lit("registrations and filings").alias("source"), F.array("id").alias("element_ids"))


def media(part: Graph) -> DataFrame:
    last = W.top(_said(part).where("predicate = 'adverse_media_screen'"), ["id"], [F.desc_nulls_first("retrieved_at"), F.asc("claim_id")], 1)
    rows = R._nodes(part).select("id").join(last, "id", "left")
    return rows.select("id", F.when(F.col("claim_id").isNull(), "No press screen").otherwise(F.concat(F.lit("Press: "), F.coalesce("value", F.lit("unknown")))).alias("label"), "detail", "source", F.array("id").alias("element_ids"))


def dependency(g: Graph, part: Graph, weighted: DataFrame, scores: DataFrame) -> DataFrame:
    """weighted: of weights(); scores: (id, score)."""
    names = g.entity.select("id", F.coalesce("name", "id").alias("name"))
    lead = drivers(weighted, scores).join(names, "id", "left").withColumn("s", F.struct("rank", "id", "edge_id", "name", "sole", "weight", "score"))
    tops = lead.groupBy(F.col("consumer").alias("id")).agg(F.array_sort(F.collect_list("s")).alias("t"))
    met = weighted.join(scores.where("score is not null"), "id", "left")
    part_of = F.col("weight") * F.col("score")
    of = met.groupBy(F.col("consumer").alias("id")).agg(
        F.count("*").alias("n"), F.count_if("sole").alias("n_sole"), F.count_if(F.col("score").isNull()).alias("n_unscored"), F.max(F.when(F.col("sole"), F.col("score"))).alias("worst"), F.sum(F.when(~F.col("sole"), part_of)).alias("spread")
    ).withColumn("x", F.bround(F.least(F.lit(100.0), F.greatest("worst", "spread")), 0).cast("int"))
    rows = R._nodes(part).where("label = 'Entity'").select("id").join(of, "id", "left").join(tops, "id", "left")
    first = F.get("t", F.lit(0))
    risk = F.concat(F.lit(" (risk "), first["score"].cast("string"), F.lit(")"))
    label = (
        F.when(F.col("n").isNull(), "No suppliers on record").when(F.col("t").isNull(), F.concat(_plural(F.col("n"), "supplier"), F.lit(", none scored")))
        .when(first["sole"], F.concat(F.lit("Only source "), first["name"], risk)).when(F.col("n") == 1, F.concat(F.lit("One supplier, "), first["name"], risk))
        .otherwise(F.concat(F.lit("Supply base carries "), F.col("x").cast("string"), F.lit(", most of it "), first["name"], risk))
    )
    shares = F.array_join(F.transform("t", lambda s: F.concat(s["name"], F.lit(" "), F.bround(100 * s["weight"], 0).cast("int").cast("string"), F.lit(" % of "), s["score"].cast("string"))), "; ")
    detail = F.concat_ws(" · ", F.concat(F.lit("exposure "), F.col("x").cast("string"), F.lit(" of 100 by "), _plural(F.col("n"), "supplier")), F.when(F.col("n_sole") > 0, F.concat(F.col("n_sole").cast("string"), F.lit(" only sources"))), F.when(F.col("n_unscored") > 0, F.concat(F.col("n_unscored").cast("string"), F.lit(" unscored"))), shares)
    ids = F.concat(F.array("id"), F.flatten(F.transform("t", lambda s: F.array(s["id"], s["edge_id"]))))
    return rows.select("id", label.alias("label"), F.when(F.col("t").isNotNull(), detail).alias("detail"), F.lit("awards").alias("source"), F.coalesce(ids, F.array("id")).alias("element_ids"))


def explained(g: Graph, ids: DataFrame, today: datetime.date = R.TODAY) -> DataFrame:
    """EXPLAINED: a row for each node of ids (id) and dimension that it is asked about."""
    ids = settle(ids.select("id").where("id is not null").distinct())
    part = R.within(g, ids)
    part = part.with_(entity=settle(part.entity), person=settle(part.person), claim=settle(part.claim))
    near, places = settle(R.proximity_of(g, ids)), settle(_places(g, ids))
    scored = settle(R.rescore(g, ids, today, near))
    weighted = settle(R.weights(g, ids))
    fresh = scored.where("label = 'Entity'").select("id", "score")
    scores = g.entity.select("id", F.col("risk_score").alias("score")).join(ids, "id", "left_anti").unionByName(fresh)
    texts = {
        "designation": designation(part), "proximity": proximity(g, part, near), "dependency": dependency(g, part, weighted, scores), "foreign": foreign(part, places).unionByName(person_foreign(g, part)),
        "financial": financial(part, today), "regional": regional(part, places), "media": media(part),
    }
    out = None
    for d, df in texts.items():
        asked = scored if d in PERSON_DIMENSIONS else scored.where("label = 'Entity'")
        one = asked.select("id", F.lit(d).alias("dimension"), F.col(d).alias("severity"), F.lit(WEIGHTS[d]).alias("weight")).join(df.withColumn("element_ids", F.array_distinct("element_ids")), "id", "left").select(*EXPLAINED)
        one = settle(one)  # a plan for each: one of all of them is more than a driver should hold
        out = one if out is None else out.unionByName(one)
    return out
