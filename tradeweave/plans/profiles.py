"""Lists, counts, screens, dependence and grades over a graph: (graph, parameters) to a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import CLASS_SEVERITY, placed, rank_of, severity_of
from ..functions.text import fold_text, folded
from ..model import EDGE_TYPES, Graph
from ..operators import walks as W
from . import templates as T

#: Fixed values. Screens whose hit designates a party; predicates that observe and commit by themselves.
DESIGNATING = ("sanctions_screen", "exclusion_screen", "restricted_list_screen")
FUZZY_FROM = 4
TRUSTED_CONFIDENCE, SOURCES = 0.8, 2
#: Exposure from which a dependence is graded so.
EXPOSURE = ((50, "high"), (25, "medium"), (10, "low"))


def graph_stats(g: Graph) -> DataFrame:
    """what (label, type), name, n: counts of nodes by label and of edges by type."""
    labels = g.nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("label"))
    types = g.all_edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("type"))
    return labels.unionByName(types).select("what", "name", "n")


def degree(g: Graph, id_: str) -> DataFrame:
    """type, n: edges of a node, either way."""
    return g.all_edges.where((F.col("src") == id_) | (F.col("dst") == id_)).groupBy("type").agg(F.count("*").alias("n"))


def people_list(g: Graph) -> DataFrame:
    """id, name, flagged, seats (organisations), current (tenures), titles: people with roles."""
    roles = g.edges["HELD_ROLE"].groupBy(F.col("src").alias("id")).agg(
        F.count_distinct("dst").alias("seats"), F.count_if("current").alias("current"), F.array_join(F.array_sort(F.collect_set("title")), ",").alias("titles")
    )
    return g.person.join(roles, "id").select("id", "name", "flagged", "seats", "current", "titles")


def entities_list(g: Graph) -> DataFrame:
    """id, name, buyers, categories, any_sole, min_tier, parent_id: each branch is counted before it is joined."""
    s = g.edges["SUPPLIES"].groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("buyers"), F.bool_or("sole_source").alias("any_sole"), F.min("tier").alias("min_tier"))
    c = g.edges["PROVIDES"].groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("categories"))
    up = T.ultimate_parents(g).where("rank = 1").select("id", "parent_id")
    none = F.lit(0)
    return g.entity.select("id", "name").join(s, "id", "left").join(c, "id", "left").join(up, "id", "left").select(
        "id", "name", F.coalesce("buyers", none).alias("buyers"), F.coalesce("categories", none).alias("categories"), F.coalesce("any_sole", F.lit(False)).alias("any_sole"), "min_tier", "parent_id"
    )


def locations(g: Graph) -> DataFrame:
    """code, incorporated, operates, manufactures, parent_seats: one pass over the four kinds of edges."""
    kinds = {"INCORPORATED_IN": "incorporated", "OPERATES_IN": "operates", "MANUFACTURES_IN": "manufactures", "PARENT_SEATED_IN": "parent_seats"}
    rows = None
    for type_ in kinds:
        one = g.edges[type_].select("code", F.lit(type_).alias("type"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("code").agg(*[F.count_if(F.col("type") == t).alias(n) for t, n in kinds.items()])


def latest_screens(g: Graph, by_source: bool = True) -> DataFrame:
    """The latest committed screen of each subject and predicate, and source where asked: id, predicate, source, value, retrieved_at."""
    rows = g.claim.where(F.col("predicate").endswith("_screen") & (F.col("status") == "committed"))
    by = ["subject_id", "predicate", *(["source"] if by_source else [])]
    first = W.top(rows.withColumn("source", F.coalesce("source", F.lit(""))), by, [F.desc_nulls_first("retrieved_at"), F.asc("id")], 1)
    return first.select(F.col("subject_id").alias("id"), "predicate", "source", F.col("object_value").alias("value"), "retrieved_at")


def designated(g: Graph) -> DataFrame:
    """id: parties that are flagged, or that a committed screen of the designating ones hit. A hit stays whatever comes later."""
    hits = g.claim.where(F.col("predicate").isin(*DESIGNATING) & (F.col("object_value") == "hit") & (F.col("status") == "committed")).select(F.col("subject_id").alias("id"))
    return g.entity.where("flagged").select("id").unionByName(g.person.where("flagged").select("id")).unionByName(hits).distinct()


def risk_bands(g: Graph) -> DataFrame:
    return g.entity.groupBy(F.coalesce("risk_band", F.lit("unscored")).alias("band")).agg(F.count("*").alias("n"))


def dependence_weights(g: Graph) -> DataFrame:
    """id (supplier), consumer, weight: 1 where it is the only source, else its share of what the consumer's competed awards amount to."""
    cents = F.round(F.col("amount") * 100).cast("long")  # whole numbers add up to the same in any order
    e = g.edges["SUPPLIES"].groupBy("src", "dst").agg(F.bool_or("sole_source").alias("sole"), F.sum(cents).alias("amount"))
    w = Window.partitionBy("dst", "sole")
    total = F.sum("amount").over(w)
    share = F.when(F.col("sole"), 1.0).when(total > 0, F.col("amount") / total).otherwise(1 / F.count("*").over(w))
    return e.select(F.col("src").alias("id"), F.col("dst").alias("consumer"), "sole", share.alias("weight"))


def dependency(g: Graph) -> DataFrame:
    """id (consumer), exposure, severity: the worst of its only sources, or the weighted score of competed ones, of suppliers with a score."""
    scored = dependence_weights(g).join(g.entity.where("risk_score is not null").select("id", "risk_score"), "id")
    worst = F.max(F.when(F.col("sole"), F.col("risk_score")))
    spread = F.sum(F.when(~F.col("sole"), F.col("weight") * F.col("risk_score")))
    out = scored.groupBy(F.col("consumer").alias("id")).agg(F.least(F.lit(100.0), F.greatest(F.coalesce(worst, F.lit(0)), F.coalesce(spread, F.lit(0.0)))).alias("exposure"))
    severity = F.lit("clear")
    for floor, name in sorted(EXPOSURE):
        severity = F.when(F.round("exposure", 6) >= floor, name).otherwise(severity)
    return out.select("id", F.round("exposure", 4).alias("exposure"), severity.alias("severity"))


def foreign_severity(g: Graph) -> DataFrame:
    """id, severity: the worst class of the countries that an entity is tied to; an opaque registry makes a mild one medium. Unknown codes say nothing."""
    ties = None
    for t in ("INCORPORATED_IN", "PARENT_SEATED_IN", "MANUFACTURES_IN", "OPERATES_IN"):
        one = g.edges[t].select(F.col("src").alias("id"), "code")
        ties = one if ties is None else ties.unionByName(one)
    by_class = F.lit(None).cast("string")
    for cls, sev in CLASS_SEVERITY.items():
        by_class = F.when(F.col("class") == cls, sev).otherwise(by_class)
    at = placed(ties.distinct()).select("id", rank_of(by_class).alias("rank"), F.coalesce("opaque", F.lit(False)).alias("opaque")).where("rank is not null")
    worst = at.groupBy("id").agg(F.max("rank").alias("rank"), F.bool_or("opaque").alias("opaque"))
    return worst.select("id", severity_of(F.when(F.col("opaque"), F.greatest("rank", F.lit(2))).otherwise(F.col("rank"))).alias("severity"))


def supply_position(g: Graph, entity_id: str, limit: int = 50) -> DataFrame:
    """rank, id, name, amount, awards of the largest suppliers of an entity."""
    rows = g.edges["SUPPLIES"].where(F.col("dst") == entity_id).groupBy(F.col("src").alias("id")).agg(F.round(F.sum("amount"), 2).alias("amount"), F.sum("award_count").alias("awards"))
    order = [F.desc("amount"), F.asc("id")]
    kept = rows.join(g.entity.select("id", "name"), "id").orderBy(*order).limit(limit)
    return kept.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "id", "name", "amount", "awards")  # limit rows


def interlocks(g: Graph) -> DataFrame:
    """id, other, people: pairs of organisations with current roles of the same people."""
    seats = g.edges["HELD_ROLE"].where("current").select("src", "dst").distinct()
    a, b = seats.withColumnRenamed("dst", "id"), seats.withColumnRenamed("dst", "other")
    return a.join(b, "src").where("id < other").groupBy("id", "other").agg(F.count("*").alias("people"))


def artifacts_of(g: Graph, limit: int = 5) -> DataFrame:
    """id (entity), artifact_id, title, published_at, rank: the latest artifacts about each."""
    rows = g.edges["ABOUT"].select(F.col("src").alias("artifact_id"), F.col("dst").alias("id")).join(g.artifact.select(F.col("id").alias("artifact_id"), "title", "published_at"), "artifact_id")
    return W.top(rows, ["id"], [F.desc_nulls_first("published_at"), F.asc("artifact_id")], limit).select("id", "artifact_id", "title", "published_at", "rank")


def decide(claims: DataFrame) -> DataFrame:
    """claims with their decision (committed, staged, rejected): a relation of a party to itself is rejected; observations commit; so do
    authoritative claims of TRUSTED_CONFIDENCE; others commit when SOURCES distinct sources say the same in claims that aren't rejected."""
    own = (F.col("predicate").isin(*EDGE_TYPES) & (F.col("subject_id") == F.col("object_id"))) | (F.col("status") == "rejected")
    observed = F.col("predicate").endswith("_screen") | (F.col("predicate") == "mention")
    said = claims.where("status in ('staged', 'committed')").groupBy("subject_id", "predicate", F.coalesce("object_id", F.lit("")).alias("o"), F.coalesce("object_value", F.lit("")).alias("v")).agg(F.count_distinct("source").alias("n_sources"))
    at = claims.withColumns({"o": F.coalesce("object_id", F.lit("")), "v": F.coalesce("object_value", F.lit(""))}).join(said, ["subject_id", "predicate", "o", "v"], "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
    trusted = (F.col("trust") == "authoritative") & (F.col("confidence") >= TRUSTED_CONFIDENCE)
    how = F.when(own, "rejected").when(observed | trusted | (F.col("n_sources") >= SOURCES), "committed").otherwise("staged")
    return at.select("id", "subject_id", "predicate", "object_value", "n_sources", F.coalesce(how, F.lit("staged")).alias("decision"))


def search(g: Graph, query: str) -> DataFrame:
    """id, name of entities and people of whose words each word of the query begins one, or, with FUZZY_FROM letters or more, is one
    edit away from one. Accents, case and punctuation don't count."""
    words = folded(query).split()
    have = F.split(fold_text(F.col("name")), " ")

    def like(w: str) -> Column:
        near = lambda x: F.levenshtein(x, F.lit(w), 1) >= 0
        return F.exists(have, (lambda x: x.startswith(w) | near(x)) if len(w) >= FUZZY_FROM else (lambda x: x.startswith(w)))

    fits = T.all_of([F.lit(bool(words)), *map(like, words)])
    both = g.entity.select("id", "name").unionByName(g.person.select("id", "name"))
    return both.where(fits)
