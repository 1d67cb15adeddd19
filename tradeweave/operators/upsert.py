"""Sinks as DataFrames: what a table is after rows are merged into it, replaced or deleted; and what would change.

A result is a plan over the old table and the new rows, so it can be counted (a dry run) or written beside the old table. Rows without
a key are never merged. Of new rows with one key, the last by `seq` with a value gives each property; ties by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row a key: each property's last value that isn't null."""
    props = [c for c in new.columns if c not in (*key, seq)]
    rows = new.where(_has(key))
    if not props:
        return rows.select(*key).distinct()
    return rows.groupBy(*key).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(seq), F.col(c)))).getField(c).alias(c) for c in props])


def _has(key: list[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & F.col(k).isNotNull()
    return out


def keep_existing(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of old as they are, and rows of new whose key old hasn't."""
    fresh = new.where(F.col(key).isNotNull()).dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def overwrite(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Properties of new over those of old, where new has a value; rows that only one of them has stay."""
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    a, b = old.alias("a"), new.where(_has(key)).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    has = lambda side, df, c: F.col(f"{side}.{c}") if c in df.columns else F.lit(None)
    return a.join(b, on, "full_outer").select(*[F.coalesce(has("b", new, c), has("a", old, c)).alias(c) for c in columns])


def merge_edges(old: DataFrame, arrivals: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """Edges by key: new properties over old ones; an edge keeps the id it was first given, made from its key."""
    new = folded(arrivals, key, seq).withColumn("new_id", F.concat(F.lit("rel_"), F.substring(F.sha1(F.concat_ws("|", *key)), 1, 12)))
    both = overwrite(old, new, key)
    return both.withColumn("id", F.coalesce("id", "new_id")).drop("new_id")


def replace_where(old: DataFrame, new: DataFrame, condition: Column) -> DataFrame:
    """old without the rows that meet the condition, and new."""
    return old.where(~F.coalesce(condition, F.lit(False))).unionByName(new, allowMissingColumns=True)


def detach(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes gone (id) and their edges."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left


def change_set(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """created, updated, deleted, same: a dry run's counts of what writing new in place of old would do."""
    shared = [c for c in new.columns if c in old.columns and c != key]
    digest = lambda df, name: df.select(key, F.struct(*[F.col(c) for c in shared]).alias(name))
    both = digest(old, "was").join(digest(new, "now"), key, "full_outer")
    what = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("updated")
    return both.groupBy(what.alias("change")).agg(F.count("*").alias("n"))
