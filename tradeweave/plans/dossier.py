"""Profiles of all entities at once: core facts, ties, supply, documents, and nine families of indicators with their mean.

A family is a DataFrame (id, rank): 0 clear to 3 high; an entity that a family has no data on isn't in it, or has a null rank. Branches
are aggregated by entity before they meet, so no join multiplies rows. What people do elsewhere is not found from pairs of their
seats: of each kind of seat a person's least and greatest organisation are kept, and one of them differs from the organisation
at hand exactly when any does.

Missing optional columns (lei, ticker, lda_registrant_id, public_official) count as null. An empty graph gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import SEVERITIES, rank_of, severity_of
from ..model import Graph
from ..operators import walks as W
from . import profiles as P
from . import templates as T

#: Home, the ties beyond supply, the families and which of them a composite score replaces, hops to a root.
HOME = "US"
TIES = ("MEMBER_OF", "TRANSACTS_WITH", "LOBBIES", "DONATED_TO")
FAMILIES = ("ownership", "concentration", "people", "government", "affiliations", "political", "sanctions", "financial", "media")
REPLACED = ("ownership", "sanctions", "financial", "media")
ROOT_HOPS = 6
#: Words in a name that suggest a foreign party where no jurisdiction is known.
HINTS = (
    "russia russian china chinese hong_kong iran iranian north_korea saudi emirates uae qatar turkey turkish israel israeli jordan jordanian "
    "egypt egyptian india indian pakistan korea korean japan japanese taiwan german germany france french british united_kingdom italy italian "
    "spain spanish brazil mexico canada canadian australia australian singapore malaysia indonesia vietnam philippines kuwait bahrain oman iraq "
    "afghanistan ukraine poland polish sweden swedish norway norwegian dutch netherlands belgium swiss switzerland austria greece greek royal"
).split()
HINT = r"\b(" + "|".join(w.replace("_", " ") for w in HINTS) + r")\b"


def _optional(df: DataFrame, name: str, type_: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(type_).alias(name)


def _places(g: Graph, type_: str, name: str) -> DataFrame:
    return g.edges[type_].groupBy(F.col("src").alias("id")).agg(F.min("code").alias(name))


def _current() -> Column:
    return F.coalesce("current", F.col("to").isNull())


def entity_core(g: Graph) -> DataFrame:
    """id, name, incorporated, parent_seat, manufactures, operates, direct_parents (id and percent), categories of every entity."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    made = lambda t, n: g.edges[t].groupBy(F.col("src").alias("id")).agg(listed("code").alias(n))
    owner = F.concat_ws(":", "src", F.col("pct").cast("int"))
    parents = g.edges["OWNS"].groupBy(F.col("dst").alias("id")).agg(listed(owner).alias("direct_parents"))
    goods = g.edges["PROVIDES"].groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("categories"))
    out = g.entity.select("id", "name")
    for branch in (_places(g, "INCORPORATED_IN", "incorporated"), _places(g, "PARENT_SEATED_IN", "parent_seat"), made("MANUFACTURES_IN", "manufactures"), made("OPERATES_IN", "operates"), parents, goods):
        out = out.join(branch, "id", "left")
    return out.withColumn("categories", F.coalesce("categories", F.lit(0)))


def supply_summary(g: Graph, root: str) -> DataFrame:
    """id, supplies, sole_source_edges, suppliers, awards, tier_from_root of every entity; root's own tier is null."""
    s = g.edges["SUPPLIES"]
    sold = s.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("supplies"), F.count_if(F.coalesce("sole_source", F.lit(False))).alias("sole_source_edges"))
    bought = s.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("suppliers"))
    awards = g.edges["ABOUT"].join(g.artifact.where("kind = 'award'").select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("awards"))
    tier = W.reach(W.reverse(s), T._one(g, root), ROOT_HOPS).where(F.col("id") != root).select("id", F.col("hops").alias("tier_from_root"))
    out = g.entity.select("id").join(sold, "id", "left").join(bought, "id", "left").join(awards, "id", "left").join(tier, "id", "left")
    return out.fillna(0, ["supplies", "sole_source_edges", "suppliers", "awards"])


def seats(g: Graph) -> DataFrame:
    """person, id, current of each tenure, and whether the person has, at another organisation (not one with the same lei), a seat now or
    then at a flagged party (flagged_now, flagged_then), at a supplier (seat_now, seat_then) or at an agency (post_now, post_then)."""
    sells = g.edges["SUPPLIES"].select(F.col("src").alias("id")).distinct().withColumn("sells", F.lit(True))
    key = F.coalesce(_optional(g.entity, "lei"), F.concat(F.lit("id:"), "id"))
    orgs = g.entity.select("id", key.alias("key"), F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce(F.col("kind") == "agency", F.lit(False)).alias("agency"))
    orgs = orgs.join(sells, "id", "left").withColumn("seller", F.coalesce("sells", F.lit(False)) & ~F.col("agency"))
    rows = g.edges["HELD_ROLE"].select(F.col("src").alias("person"), F.col("dst").alias("id"), _current().alias("current")).join(orgs, "id")
    kinds = {f"{name}_{when}": F.col(c) & (F.col("current") if when == "now" else ~F.col("current")) for name, c in (("flagged", "flagged"), ("seat", "seller"), ("post", "agency")) for when in ("now", "then")}
    ends = [f(F.when(hit, F.col("key"))).alias(f"{end}_{k}") for k, hit in kinds.items() for end, f in (("lo", F.min), ("hi", F.max))]
    per = rows.groupBy("person").agg(*ends)
    other = lambda k: F.coalesce((F.col(f"lo_{k}") != F.col("key")) | (F.col(f"hi_{k}") != F.col("key")), F.lit(False)).alias(k)
    return rows.join(per, "person").select("person", "id", "current", *map(other, kinds))


def affiliations(g: Graph) -> DataFrame:
    """id, type, outbound, other, name, kind, flagged, foreign, foreign_hint, current: ties beyond supply, either way, and companies owned.
    foreign is null where the other's jurisdiction is unknown; then its name may be a hint."""
    tie = None
    for t in (*TIES, "OWNS"):
        if t not in g.edges:
            continue
        e = g.edges[t]
        one = e.select("src", "dst", F.lit(t).alias("type"), F.coalesce(_optional(e, "current", "boolean"), _optional(e, "to").isNull()).alias("current"))
        one = W.both_ways(one) if t != "OWNS" else one.withColumn("outbound", F.lit(True))
        tie = one if tie is None else tie.unionByName(one)
    orgs = g.entity.select(F.col("id").alias("dst"), "name", "kind", F.coalesce("flagged", F.lit(False)).alias("flagged"))
    at = _places(g, "INCORPORATED_IN", "home").join(_places(g, "PARENT_SEATED_IN", "seat"), "id", "full").withColumnRenamed("id", "dst")
    code = F.coalesce("home", F.when(F.col("type") != "OWNS", F.col("seat")))
    rows = tie.join(orgs, "dst").join(at, "dst", "left").withColumn("foreign", ~F.upper(code).startswith(HOME))
    hint = F.col("foreign").isNull() & F.coalesce(F.lower("name").rlike(HINT), F.lit(False))
    return rows.select(F.col("src").alias("id"), "type", "outbound", F.col("dst").alias("other"), "name", "kind", "flagged", "foreign", hint.alias("foreign_hint"), "current")


def documents_of(g: Graph, limit: int = 50) -> DataFrame:
    """id, artifact_id, published_at, rank: the latest artifacts that are about a party or bear out a claim on it, each once."""
    direct = g.edges["ABOUT"].select(F.col("src").alias("artifact_id"), F.col("dst").alias("id"))
    borne = g.edge("EVIDENCES").select(F.col("src").alias("artifact_id"), F.col("dst").alias("claim")).join(g.claim.select(F.col("id").alias("claim"), F.col("subject_id").alias("id")), "claim")
    every = direct.unionByName(borne.select("artifact_id", "id")).distinct()
    dated = every.join(g.artifact.select(F.col("id").alias("artifact_id"), "published_at"), "artifact_id")
    return W.top(dated, ["id"], [F.desc_nulls_first("published_at"), F.asc("artifact_id")], limit).select("id", "artifact_id", "published_at", "rank")


def news(g: Graph, limit: int = 10) -> DataFrame:
    """id, artifact_id, published_at, rank: the latest news about each entity."""
    return P.artifacts_of(g.with_(artifact=g.artifact.where("kind = 'news'")), limit).select("id", "artifact_id", "published_at", "rank")


def ownership(g: Graph) -> DataFrame:
    """High where the parent is seated abroad, clear where at home, low where an owner is known but not its seat."""
    owned = T._owning(g).select(F.col("dst").alias("id")).distinct().withColumn("owned", F.lit(True))
    rank = F.when(F.col("seat").isNotNull(), F.when(F.upper("seat").startswith(HOME), 0).otherwise(3)).when(F.col("owned"), 1)
    return _places(g, "PARENT_SEATED_IN", "seat").join(owned, "id", "full").select("id", rank.alias("rank"))


def concentration(g: Graph) -> DataFrame:
    """Medium for a sole source in any award, not only the largest: a condition of its customers, so it is no finding."""
    return g.edges["SUPPLIES"].groupBy(F.col("src").alias("id")).agg(F.when(F.bool_or(F.coalesce("sole_source", F.lit(False))), 2).otherwise(0).alias("rank"))


def people(seats_: DataFrame) -> DataFrame:
    """High for someone here and at a flagged party at once, unless another left for one; medium for who came from or went to one, or from
    another supplier; low for a seat at another supplier."""
    now, said = F.col("current"), F.bool_or
    flags = seats_.groupBy("id").agg(
        said(~now & F.col("flagged_now")).alias("moved"), said(now & F.col("flagged_now")).alias("both"), said(now & F.col("flagged_then")).alias("came"),
        said(now & F.col("seat_then")).alias("formerly"), said(now & F.col("seat_now")).alias("interlock"),
    )
    rank = F.when(F.col("moved"), 2).when(F.col("both"), 3).when(F.col("came") | F.col("formerly"), 2).when(F.col("interlock"), 1).otherwise(0)
    return flags.select("id", rank.alias("rank"))


def government(g: Graph, seats_: DataFrame) -> DataFrame:
    """Medium for a public post at the same time, low for one before or for a public official, of those who hold a seat now."""
    official = g.person.select(F.col("id").alias("person"), F.coalesce(_optional(g.person, "public_official", "boolean"), F.lit(False)).alias("official"))
    mine = seats_.where("current").join(official, "person", "left")
    flags = mine.groupBy("id").agg(F.bool_or("post_now").alias("both"), F.bool_or(F.col("post_then") | F.coalesce("official", F.lit(False))).alias("before"))
    return flags.select("id", F.when(F.col("both"), 2).when(F.col("before"), 1).otherwise(0).alias("rank"))


def tied(affiliations_: DataFrame) -> DataFrame:
    """The worst of memberships, dealings and companies owned: flagged, foreign, or foreign by name."""
    worth = F.when(F.col("flagged"), 3).when(F.col("foreign"), 2).when(F.col("foreign_hint"), 1).otherwise(0)
    return affiliations_.where(F.col("type").isin("MEMBER_OF", "TRANSACTS_WITH", "OWNS")).groupBy("id").agg(F.max(worth).alias("rank"))


def political(g: Graph, affiliations_: DataFrame) -> DataFrame:
    """Low where it lobbies, or is registered to and no gifts are known; clear where there are gifts alone."""
    kinds = affiliations_.groupBy("id").agg(F.bool_or(F.col("type") == "LOBBIES").alias("lobbies"), F.bool_or(F.col("type") == "DONATED_TO").alias("gives"))
    rows = g.entity.select("id", _optional(g.entity, "lda_registrant_id").alias("lda")).join(kinds, "id", "left")
    return rows.select("id", F.when(F.col("lobbies"), 1).when(F.col("gives"), 0).when(F.col("lda").isNotNull(), 1).alias("rank"))


def screened(g: Graph) -> DataFrame:
    """id, sanctions, financial, media: of the latest screen of each predicate; an unknown verdict of the last two is low."""
    rows, p = P.latest_screens(g, by_source=False), F.col("predicate")
    graded = F.coalesce(rank_of(F.col("value")), F.lit(1))
    return rows.groupBy("id").agg(
        F.max(F.when(p.isin(*P.DESIGNATING), F.when(F.col("value") == "hit", 3).otherwise(0))).alias("sanctions"),
        F.max(F.when(p == "financial_screen", graded)).alias("financial"), F.max(F.when(p == "adverse_media_screen", graded)).alias("media"),
    )


def indicators(g: Graph) -> DataFrame:
    """id and the rank of each of FAMILIES, for every entity."""
    held, ties = seats(g), affiliations(g)
    out = g.entity.select("id", (F.coalesce("public", F.lit(False)) & _optional(g.entity, "ticker").isNotNull()).alias("listed"))
    found = {"ownership": ownership(g), "concentration": concentration(g), "people": people(held), "government": government(g, held), "affiliations": tied(ties), "political": political(g, ties)}
    for name, df in found.items():
        out = out.join(df.select("id", F.col("rank").alias(name)), "id", "left")
    out = out.join(screened(g), "id", "left").withColumn("financial", F.coalesce("financial", F.when(F.col("listed"), 0)))
    return out.select("id", *FAMILIES)


def indicator_mean(indicators_: DataFrame) -> DataFrame:
    """id, composite (0 to 100, null without data), families_with_data: a clear family counts a third of one that found something."""
    parts = [F.when(F.col(f) == 0, 1).when(F.col(f).isNotNull(), 3).otherwise(0) for f in FAMILIES]
    total = sum((3 * F.coalesce(F.col(f), F.lit(0)) for f in FAMILIES), F.lit(0))
    ceiling = (len(SEVERITIES) - 1) * sum(parts, F.lit(0))
    have = sum((F.col(f).isNotNull().cast("int") for f in FAMILIES), F.lit(0))
    return indicators_.select("id", F.when(ceiling > 0, F.bround(100 * total / ceiling, 0).cast("int")).alias("composite"), have.alias("families_with_data"))


def risk_tab(indicators_: DataFrame, explained: DataFrame) -> DataFrame:
    """id, signal, severity, scored: the scored dimensions of explained (id, dimension, severity) and, as context, the families that they don't
    replace. Entities without a score show all families."""
    has = explained.select("id").distinct().withColumn("has", F.lit(True))
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("signal"), severity_of(F.col(f)).alias("severity"), F.lit(f in REPLACED).alias("replaced")) for f in FAMILIES])).alias("r")
    context = indicators_.join(has, "id", "left").select("id", "has", rows).where("has is null or not r.replaced").select("id", "r.signal", "r.severity", F.lit(False).alias("scored"))
    return explained.select("id", F.col("dimension").alias("signal"), "severity", F.lit(True).alias("scored")).unionByName(context)
