"""Staging of facts with their evidence: references resolved against the graph and against each other in one pass, ids rewritten, then merged.

A fact names its subject and object by references (label, id, name, uei, lei, cage): ids that a source proposes. A reference to an
organisation that the graph doesn't have by id is looked for by identifier, exact name, alias and likeness. What isn't found is grouped with other
new references that share an identifier or a normalised name, as connected components; a group becomes the node that any of
them was found to be, else the least id among them. So facts of one batch meet at one node whatever their order.

Rows without a subject's id or a predicate are left out; equal facts are one claim. Null names never match. A relation that turns out to
tie a node to itself is staged as rejected. Existing nodes keep what they have; of artifacts with one url new properties win.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name, stable_id
from ..model import EDGE_TYPES, Graph
from ..operators import walks as W
from ..operators.rounds import settle
from ..operators.upsert import overwrite
from .resolve import find_entity

#: Confidence from which a found node is the one meant; characters of a title; types that aren't relations between parties.
SURE, TITLE, EVIDENCE = 0.85, 300, ("EVIDENCES", "ASSERTS", "TARGETS", "ABOUT")
REF = "struct<label: string, id: string, name: string, uei: string, lei: string, cage: string>"
FACT = f"subject {REF}, predicate string, object {REF}, object_value string, source string, trust string, confidence double, method string, detail string, retrieved_at string, artifact struct<url: string, title: string, kind: string, published_at: string>"
NOTE = "ties a node to itself after resolution"


@dataclass(frozen=True)
class Staged:
    """claims (id, predicate, subject_id, object_id, object_value, source, trust, confidence, method, detail, retrieved_at, status, note), nodes (id,
    label, name, uei, lei, cage: new ones), artifacts (id, url, title, kind, source, published_at), edges (src, type, dst), refs (id, node, method, confidence)."""

    claims: DataFrame
    nodes: DataFrame
    artifacts: DataFrame
    edges: DataFrame
    refs: DataFrame


def resolved(g: Graph, refs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """id, node, method, confidence for references to organisations (id, name, uei, lei, cage; one row each)."""
    there = refs.join(g.entity.select("id"), "id", "left_semi").select("id", F.col("id").alias("node"), F.lit("id").alias("method"), F.lit(1.0).alias("confidence"))
    new = settle(refs.join(g.entity.select("id"), "id", "left_anti"))
    found = find_entity(g.entity, new.withColumnRenamed("id", "key"), fuzzy).where(F.col("confidence") >= SURE).select(F.col("key").alias("id"), F.col("id").alias("hit"), "method", "confidence")
    keys = None
    for kind, c in (("uei", F.upper("uei")), ("lei", F.upper("lei")), ("cage", F.upper("cage")), ("name", normalize_name(F.col("name")))):
        one = new.select("id", F.concat(F.lit(f"{kind}:"), F.nullif(c, F.lit(""))).alias("key")).where("key is not null")
        keys = one if keys is None else keys.unionByName(one)
    least = keys.groupBy("key").agg(F.min("id").alias("dst"))
    groups = W.components(new, keys.join(least, "key").select(F.col("id").alias("src"), "dst"))
    met = settle(groups.join(found, "id", "left"))
    of = met.groupBy("component").agg(F.min("hit").alias("known"))
    same = met.join(of, "component").select("id", F.coalesce("hit", "known", "component").alias("node"), F.coalesce("method", F.when(F.col("known").isNotNull() | (F.col("component") != F.col("id")), "group").otherwise("new")).alias("method"), "confidence")
    return there.unionByName(same)


def stage(g: Graph, facts: DataFrame, fuzzy: bool = True) -> Staged:
    """facts: columns of FACT."""
    f = settle(facts.where(F.col("subject.id").isNotNull() & F.col("predicate").isNotNull()))
    named = f.select("subject.*").unionByName(f.where("object.id is not null").select("object.*"))
    refs = settle(named.groupBy("id", "label").agg(*[F.min(F.nullif(c, F.lit(""))).alias(c) for c in ("name", "uei", "lei", "cage")]))
    orgs = resolved(g, refs.where("label = 'Entity'").drop("label"), fuzzy)
    others = refs.where("label <> 'Entity'").select("id", F.col("id").alias("node"), F.lit("id").alias("method"), F.lit(1.0).alias("confidence"))
    nodes_of = settle(orgs.unionByName(others))

    at = lambda side: nodes_of.select(F.col("id").alias(f"{side}_ref"), F.col("node").alias(f"{side}_id"))
    met = f.withColumns({"subject_ref": F.col("subject.id"), "object_ref": F.col("object.id")}).join(at("subject"), "subject_ref").join(at("object"), "object_ref", "left")
    said = ("subject_id", "predicate", "object_id", "object_value", "source", "detail", "retrieved_at")
    itself = F.coalesce(F.col("predicate").isin(*[t for t in EDGE_TYPES if t not in EVIDENCE]) & (F.col("subject_id") == F.col("object_id")), F.lit(False))
    rows = met.withColumns({"id": stable_id("clm", *[F.col(c) for c in said]), "artifact_id": F.when(F.col("artifact.url").isNotNull(), stable_id("art", F.col("artifact.url")))})
    rows = settle(rows.withColumns({"status": F.when(itself, "rejected").otherwise("staged"), "note": F.when(itself, NOTE)}))
    own = ["predicate", "subject_id", "object_id", "object_value", "source", "trust", "confidence", "method", "detail", "retrieved_at", "status", "note"]
    claims = rows.groupBy("id").agg(F.min(F.struct(*own)).alias("c")).select("id", "c.*")

    have = g.entity.select("id").unionByName(g.person.select("id"))
    born = refs.join(nodes_of.select("id", "node"), "id").groupBy(F.col("node").alias("id"), "label").agg(*[F.min(c).alias(c) for c in ("name", "uei", "lei", "cage")]).where(F.col("label").isin("Entity", "Person")).join(have, "id", "left_anti")
    fresh = rows.where("artifact_id is not null").groupBy(F.col("artifact_id").alias("id")).agg(F.min("artifact.url").alias("url"), F.min(F.substring("artifact.title", 1, TITLE)).alias("title"), F.min("artifact.kind").alias("kind"), F.min("source").alias("source"), F.min("artifact.published_at").alias("published_at"))
    tie = lambda src, type_, dst: rows.select(F.col(src).alias("src"), F.lit(type_).alias("type"), F.col(dst).alias("dst"))
    edges = tie("id", "ASSERTS", "subject_id").unionByName(tie("id", "TARGETS", "object_id")).unionByName(tie("artifact_id", "EVIDENCES", "id")).unionByName(tie("artifact_id", "ABOUT", "subject_id"))
    return Staged(claims, born.select("id", "label", "name", "uei", "lei", "cage"), fresh, edges.where("src is not null and dst is not null").distinct(), nodes_of)


def artifacts_after(old: DataFrame, staged: Staged) -> DataFrame:
    """old (id, url, title, kind, source, published_at) with the staged ones: a row for each url, new properties over old ones."""
    return overwrite(old, staged.artifacts, ["id"])
