"""Claims committed to the graph: edges, attributes and designations that committed claims write, and lists of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_TYPES, Graph
from ..operators.upsert import folded, merge_edges, overwrite

#: Attributes that a claim may set; screens that mark a party.
ATTRIBUTES = (
    "uei cage lei registration_status public ticker cik legal_name employees website board_size flagged littlesis_id opencorporates_id duns business_types "
    "naics_codes sam_registered incorporation_date entity_status market_cap last_price price_change_12m registration_expires organization_structure revenue "
    "lda_registrant_id fedspending_id aliases_text blurb org_types littlesis_tags public_official"
).split()
MARKERS = {"sanctions_screen": "sanctioned", "exclusion_screen": "debarred", "restricted_list_screen": "restricted"}


def _committed(claims: DataFrame) -> DataFrame:
    return claims.where("status = 'committed'").withColumn("seq", F.concat_ws("|", "retrieved_at", "id"))


def relations(claims: DataFrame) -> DataFrame:
    """src, type, dst, source, detail, confidence, seq: what committed relation claims say, a row a claim."""
    rows = _committed(claims).where(F.col("predicate").isin(*EDGE_TYPES) & F.col("object_id").isNotNull())
    return rows.select(F.col("subject_id").alias("src"), F.col("predicate").alias("type"), F.col("object_id").alias("dst"), "source", "detail", "confidence", "seq")


def edges_after(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """edges (id, src, type, dst, source, detail, confidence) with the committed relations merged in."""
    return merge_edges(edges, relations(claims), ["src", "type", "dst"])


def attributes(claims: DataFrame) -> DataFrame:
    """id, attribute, value, claim_id: the last committed value of each attribute that may be set. Truth values are true and false."""
    rows = _committed(claims).where(F.col("predicate").startswith("attr:")).withColumn("attribute", F.substring("predicate", 6, 100)).where(F.col("attribute").isin(*ATTRIBUTES))
    return folded(rows.select(F.col("subject_id").alias("id"), "attribute", F.col("object_value").alias("value"), F.col("id").alias("claim_id"), "seq"), ["id", "attribute"], "seq")


def marks(claims: DataFrame) -> DataFrame:
    """id, flag_reason and a column for each marker: parties that committed screens of the designating ones hit."""
    hits = _committed(claims).where(F.col("predicate").isin(*MARKERS) & (F.col("object_value") == "hit"))
    reason = F.concat(F.col("predicate"), F.lit(": "), F.coalesce("detail", F.lit("hit")))
    flags = [F.bool_or(F.col("predicate") == p).alias(m) for p, m in MARKERS.items()]
    return hits.groupBy(F.col("subject_id").alias("id")).agg(F.max(F.struct("seq", reason.alias("why")))["why"].alias("flag_reason"), *flags)


def entities_after(g: Graph, claims: DataFrame) -> DataFrame:
    """id, flagged, flag_reason of entities with the marks written over."""
    return overwrite(g.entity.select("id", "flagged"), marks(claims).select("id", F.lit(True).alias("flagged"), "flag_reason"), ["id"]).join(g.entity.select("id"), "id", "left_semi")


def endpoints(claims: DataFrame) -> DataFrame:
    """claim_id, id: the nodes that a claim speaks about, and itself."""
    ids = F.array_compact(F.array("subject_id", "object_id", "id"))
    return claims.select(F.col("id").alias("claim_id"), F.explode(F.array_distinct(ids)).alias("id"))


def rejected(claims: DataFrame, ids: DataFrame, note: str | None = None) -> DataFrame:
    """claims with those among ids (id) rejected."""
    gone = ids.select("id").distinct().withColumn("gone", F.lit(True))
    status = F.when(F.col("gone"), "rejected").otherwise(F.col("status"))
    return claims.join(gone, "id", "left").withColumns({"status": status, "decision_note": F.when(F.col("gone"), F.lit(note))}).drop("gone")


def claims_list(g: Graph, status: str | None = None, entity_id: str | None = None, limit: int = 200) -> DataFrame:
    """rank, id, subject, object, predicate, object_value, status, retrieved_at: latest first."""
    rows = g.claim
    if status:
        rows = rows.where(F.col("status") == status)
    if entity_id:
        rows = rows.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))
    names = g.entity.select("id", "name").unionByName(g.person.select("id", "name"))
    kept = rows.orderBy(F.desc_nulls_first("retrieved_at"), "id").limit(limit).withColumnRenamed("id", "claim_id")
    kept = kept.join(names.toDF("subject_id", "subject"), "subject_id", "left").join(names.toDF("object_id", "object"), "object_id", "left")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc_nulls_first("retrieved_at"), "claim_id"))  # limit rows
    return kept.select(rank.alias("rank"), F.col("claim_id").alias("id"), "subject", "object", "predicate", "object_value", "status", "retrieved_at")
