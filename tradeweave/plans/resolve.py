"""Resolution of names and identifiers to nodes, and screening of names against lists.

Every step is an equi-join: an identifier, a normalised name, an alias, or a block of names. Only pairs that share a block are
scored, in Arrow batches. The block of a name is its first four letters, which is the candidates' rule; where one block is hot, pairs
are further held to lengths that can reach the score at all. A list to screen against is a stated query set: each name meets the
list's rows that share the first three letters of one of their words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_score, normalize_name, normalize_person, person_score

#: Scores from which names are the same, or candidates; scores of the lists; confidence of each way to match.
ACCEPT, CANDIDATE, LISTED, LISTED_PERSON = 93.0, 80.0, 92.0, 90.0
CONFIDENCE = {"uei": 1.0, "lei": 1.0, "cage": 0.98, "name_exact": 0.9, "alias_exact": 0.85, "source_ref": 0.98, "person_name": 0.7}


def _first(asked: DataFrame, found: DataFrame, method: str, rank: int) -> DataFrame:
    """key, id, method, confidence, score: the least id for each key."""
    one = found.groupBy("key").agg(F.min("id").alias("id"))
    return one.select("key", "id", F.lit(method).alias("method"), F.lit(CONFIDENCE[method]).alias("confidence"), F.lit(None).cast("double").alias("score"), F.lit(rank).alias("step"))


def find_entity(entity: DataFrame, asked: DataFrame, fuzzy: bool = True) -> DataFrame:
    """key, id, method, confidence, score for each of asked (key, and any of uei, lei, cage, name) that is found: by the first of uei,
    lei, cage, exact name, alias and likeness that finds anything. entity: id, name, and any of uei, lei, cage, aliases."""
    steps: list[DataFrame] = []
    for ident in ("uei", "lei", "cage"):
        if ident in asked.columns and ident in entity.columns:
            want = asked.where(F.col(ident).isNotNull() & (F.col(ident) != "")).select("key", F.upper(ident).alias("v"))
            steps.append(_first(asked, want.join(entity.select("id", F.col(ident).alias("v")), "v"), ident, len(steps)))
    named = asked.select("key", normalize_name(F.col("name")).alias("v"), "name").where("v <> ''")
    norm = entity.select("id", normalize_name(F.col("name")).alias("v"), "name").where("v <> ''")
    steps.append(_first(asked, named.select("key", "v").join(norm.select("id", "v"), "v"), "name_exact", len(steps)))
    if "aliases" in entity.columns:
        alias = entity.select("id", F.explode("aliases").alias("a")).select("id", normalize_name(F.col("a")).alias("v")).where("v <> ''")
        steps.append(_first(asked, named.select("key", "v").join(alias, "v"), "alias_exact", len(steps)))
    found = steps[0]
    for s in steps[1:]:
        found = found.unionByName(s)
    best = Window.partitionBy("key").orderBy("step")
    found = found.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "step")
    if not fuzzy:
        return found
    left = named.join(found.select("key"), "key", "left_anti")
    scored = alike(left.select("key", "v"), norm.select("id", "v"), ACCEPT, prefix=True)
    near = scored.groupBy("key").agg(F.max(F.struct("score", (-F.xxhash64("id")).alias("h"), "id")).alias("m")).select("key", "m.id", "m.score")
    confidence = F.round(0.6 + 0.4 * (F.col("score") - ACCEPT) / (100 - ACCEPT), 2)
    return found.unionByName(near.select("key", "id", F.lit("name_fuzzy").alias("method"), confidence.alias("confidence"), "score"))


def alike(asked: DataFrame, norm: DataFrame, least: float, prefix: bool) -> DataFrame:
    """key, id, score of names (key, v; id, v) that share a block and score `least` or more."""
    word = F.split("v", " ")[0]
    if prefix:
        a, b = asked.withColumn("block", F.substring(word, 1, 4)), norm.withColumn("block", F.substring("v", 1, 4))
    else:
        a, b = asked.withColumn("block", F.substring(word, 1, 5)), norm.withColumn("block", F.explode(F.array_distinct(F.transform(F.split("v", " "), lambda w: F.substring(w, 1, 5)))))
    longer, shorter = F.greatest(F.length("av"), F.length("v")), F.least(F.length("av"), F.length("v"))
    pairs = a.withColumnRenamed("v", "av").join(b, "block").where(shorter >= longer * 0.5 if least < ACCEPT else shorter * 200 >= (longer + shorter) * least)
    return pairs.select("key", "id", "av", "v").distinct().withColumn("score", name_score("av", "v")).where(F.col("score") >= least).select("key", "id", "score")


def fuzzy_candidates(entity: DataFrame, asked: DataFrame, limit: int = 5) -> DataFrame:
    """key, id, score, rank: the likest entities of each asked name (key, name), of those with a word that begins as its first does."""
    named = asked.select("key", normalize_name(F.col("name")).alias("v")).where("v <> ''")
    scored = alike(named, entity.select("id", normalize_name(F.col("name")).alias("v")).where("v <> ''"), CANDIDATE, prefix=False)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= limit)


def find_person(person: DataFrame, asked: DataFrame) -> DataFrame:
    """key, id, method, confidence of people by the reference of their source, else by their exact name. asked: key, name, source_ref."""
    by_ref = asked.where("source_ref is not null").join(person.select("id", "source_ref"), "source_ref").select("key", "id") if "source_ref" in person.columns else None
    want = asked.select("key", normalize_person(F.col("name")).alias("v")).where("v <> ''")
    found = _first(asked, want.join(person.select("id", normalize_person(F.col("name")).alias("v")), "v"), "name_exact", 1).withColumn("confidence", F.lit(CONFIDENCE["person_name"]))
    if by_ref is not None:
        first = _first(asked, by_ref, "source_ref", 0)
        found = first.unionByName(found.join(first.select("key"), "key", "left_anti"))
    return found.select("key", "id", "method", "confidence")


def screened(nodes: DataFrame, listed: DataFrame, people: bool = False) -> DataFrame:
    """id, result (hit, clear), n_hits, best, hits (names of the list, likest first, ten at most): nodes (id, name, and aliases if there
    are any) against a list (name, program). Organisations need six letters and like lengths, people two words."""
    norm, score, least = (normalize_person, person_score, LISTED_PERSON) if people else (normalize_name, name_score, LISTED)
    names = nodes.select("id", F.explode(F.array_append(F.col("aliases"), F.col("name")) if "aliases" in nodes.columns else F.array("name")).alias("n"))
    blocks = lambda c: F.explode(F.array_distinct(F.transform(F.split(c, " "), lambda w: F.substring(w, 1, 3))))
    a = names.select("id", norm(F.col("n")).alias("a")).where("a <> ''").distinct().withColumn("block", blocks("a"))
    b = listed.select(F.col("name").alias("listed"), norm(F.col("name")).alias("b")).where("b <> ''").distinct().withColumn("block", blocks("b"))
    pairs = a.join(b, "block").select("id", "a", "listed", "b").distinct()
    if not people:
        pairs = pairs.where((F.length("b") > 5) & (F.abs(F.length("a") - F.length("b")) <= F.greatest(F.lit(4), F.floor(F.length("b") / 3))))
    hits = pairs.withColumn("score", score("a", "b")).where(F.col("score") >= least).groupBy("id", "listed").agg(F.max("score").alias("score"))
    of = hits.groupBy("id").agg(F.count("*").alias("n_hits"), F.max("score").alias("best"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "listed"))), 1, 10)["listed"].alias("hits"))
    return nodes.select("id").distinct().join(of, "id", "left").select("id", F.when(F.col("n_hits") > 0, "hit").otherwise("clear").alias("result"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "best", "hits")
