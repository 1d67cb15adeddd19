"""Search by typed words over an index that is landed once: identifiers, then words (whole, begun, or one edit away), then substrings.

The index has a row for each word of a name, sorted by word, so that a prefix is a range of it; and for each distinct word the words
that one deletion makes of it, sorted, so that what is one edit away (a letter more, less, other, or two swapped) shares one of a
few keys with the query's word. Only what shares a key is compared. Names are folded once, when the index is landed.

Empty queries find nothing. Names without words are found by identifier alone. Ties are ordered by name, then id.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_text, folded
from ..model import Graph, landed
from ..operators.rounds import shared

#: Letters from which on a word may be one edit away; rows that an identifier finds; the most rows of an answer.
FUZZY_FROM, BY_IDENTIFIER, MOST = 4, 5, 50
IDENTIFIERS = ("uei", "cage", "lei")
WHOLE, BEGUN, NEAR = 3, 2, 1


@dataclass(frozen=True)
class Index:
    """names (id, label, name, uei, cage, lei, text), words (word, id), edits (key, word)."""

    names: DataFrame
    words: DataFrame
    edits: DataFrame


def less_one(word: Column) -> Column:
    """The word, and what is left of it without each of its letters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def names_of(g: Graph) -> DataFrame:
    has = lambda df, c: (F.upper(F.col(c)) if c in df.columns else F.lit(None).cast("string")).alias(c)
    more = lambda df: F.concat_ws(" ", "name", F.col("aliases_text")) if "aliases_text" in df.columns else F.coalesce("name", F.lit(""))
    rows = None
    for label, df in (("Entity", g.entity), ("Person", g.person)):
        one = df.select("id", F.lit(label).alias("label"), "name", *[has(df, c) for c in IDENTIFIERS], more(df).alias("text"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def words_of(names: DataFrame) -> DataFrame:
    return names.select("id", F.explode(F.split(fold_text("text"), " ")).alias("word")).where("word <> ''").distinct().select("word", "id")


def edits_of(words: DataFrame) -> DataFrame:
    return words.select("word").distinct().where(F.length("word") >= FUZZY_FROM - 1).select(F.explode(less_one(F.col("word"))).alias("key"), "word")


def index_of(names: DataFrame) -> Index:
    words = words_of(names)
    return Index(names, words, edits_of(words))


_landed: dict[tuple[str, str], str] = {}


def landed_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the projected graph, written once a session beside it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landed:
        path = f"{shared(spark)}/search-{uuid.uuid4().hex[:12]}"
        names_of(landed(spark, sf_dir)).write.parquet(f"{path}/names")
        for name, source, build, by in (("words", "names", words_of, "word"), ("edits", "words", edits_of, "key")):
            build(spark.read.parquet(f"{path}/{source}")).repartitionByRange(by).sortWithinPartitions(by).write.parquet(f"{path}/{name}")
        _landed[key] = path
    return Index(*[spark.read.parquet(f"{_landed[key]}/{n}") for n in ("names", "words", "edits")])


def _swaps(word: str) -> list[str]:
    return [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]


def _found(index: Index, at: int, word: str) -> DataFrame:
    """(at, id, how) of the names with a word like this one."""
    begun = index.words.where(F.col("word").startswith(word)).select("id", F.when(F.col("word") == word, WHOLE).otherwise(BEGUN).alias("how"))
    if len(word) >= FUZZY_FROM:
        keys = sorted({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})
        one = (F.levenshtein("word", F.lit(word), 1) >= 0) | F.col("word").isin(*_swaps(word))
        near = index.edits.where(F.col("key").isin(*keys)).select("word").distinct().where(one)
        begun = begun.unionByName(index.words.join(near, "word").select("id", F.lit(NEAR).alias("how")))
    return begun.select(F.lit(at).alias("at"), "id", "how")


def search_entities(index: Index, query: str, kind: str = "any", limit: int = 10) -> DataFrame:
    """rank, id, name, label, score, step (identifier, words, substring): the first step that finds something answers. kind (any, entity,
    person) is asked for after the limit. score: 1 for identifiers, the mean of how well each word fits, or a half."""
    words, limit = folded(query).split(), max(1, min(MOST, limit))
    rows = index.names.limit(0).withColumns({"score": F.lit(0.0), "step": F.lit("")})
    if words:
        ident = re.sub("[^A-Za-z0-9]", "", query).upper()
        same = F.lit(False)
        for c in IDENTIFIERS:
            same = same | F.coalesce(F.col(c) == ident, F.lit(False))
        rows = index.names.where(same).withColumns({"score": F.lit(1.0), "step": F.lit("identifier")})
        most = BY_IDENTIFIER
        if not rows.take(1):
            each, most = None, limit
            for at, w in enumerate(dict.fromkeys(words)):
                one = _found(index, at, w)
                each = one if each is None else each.unionByName(one)
            n = len(dict.fromkeys(words))
            best = each.groupBy("id", "at").agg(F.max("how").alias("how")).groupBy("id").agg(F.count("*").alias("n"), F.sum("how").alias("sum")).where(F.col("n") == n)
            rows = index.names.join(best.select("id", F.round(F.col("sum") / (WHOLE * n), 4).alias("score")), "id").withColumn("step", F.lit("words"))
            if not rows.take(1):
                inside = F.lit(True)
                for w in words:
                    inside = inside & F.lower("text").contains(w)
                rows = index.names.where(inside).withColumns({"score": F.lit(0.5), "step": F.lit("substring")})
        rows = rows.orderBy(F.desc("score"), F.asc_nulls_last("name"), "id").limit(min(most, limit))
    from pyspark.sql import Window

    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc_nulls_last("name"), "id")))  # limit rows
    asked = {"entity": "Entity", "person": "Person"}.get(kind)
    return (ranked.where(F.col("label") == asked) if asked else ranked).select("rank", "id", "name", "label", "score", "step")
