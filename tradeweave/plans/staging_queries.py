"""Facts that all events stand for, staged against the graph, and their SQL, which knows what each reference means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GRAPH_SQL, landed
from . import staging as S
from .registry import ORACLES, QUERIES


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event says who supplies whom, by an id that is known, by a written name, by an identifier, or by names that nobody knows yet."""
    e, u = F.col("event_id"), F.col("user_id")
    n = F.lit(max(1, spark.read.parquet(f"{sf_dir}/supplier.parquet").count()))
    none = F.lit(None).cast("string")
    s, kind = u % n, e % 4
    id_ = F.when(kind == 0, F.concat(F.lit("ent_s"), s)).when(kind == 1, F.concat(F.lit("ref_a"), s)).when(kind == 2, F.concat(F.lit("ref_b"), s)).otherwise(F.concat(F.lit("ref_c"), u))
    name = F.when(kind == 1, F.concat(F.lit("SUPPLIER #"), F.lpad(s.cast("string"), 9, "0"), F.lit(", Inc."))).when(kind == 3, F.concat(F.lit("Newcomer no "), u % 7))
    lei = F.when(kind == 2, F.concat(F.lit("lei"), F.floor(s / 2)))
    uei = F.when((kind == 3) & (u % 2 == 0), F.concat(F.lit("u"), u % 14))
    ref = lambda i, m, a, b: F.struct(F.lit("Entity").alias("label"), i.alias("id"), m.alias("name"), a.alias("uei"), b.alias("lei"), none.alias("cage"))
    artifact = F.when(e % 5 < 3, F.struct(F.concat(F.lit("https://example.org/e/"), e % 50).alias("url"), F.concat(F.lit("Event "), e % 50).alias("title"), F.lit("record").alias("kind"), none.alias("published_at")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        ref(id_, name, uei, lei).alias("subject"), F.when(e % 3 == 0, "OWNS").otherwise("SUPPLIES").alias("predicate"), ref(F.concat(F.lit("ent_s"), (u * 7 + 1) % n), none, none, none).alias("object"), none.alias("object_value"), F.concat(F.lit("src_"), e % 3).alias("source"), F.lit("open").alias("trust"), F.lit(0.8).alias("confidence"),
        F.lit("connector").alias("method"), F.col("event_type").alias("detail"), none.alias("retrieved_at"), artifact.alias("artifact"),
    )


def _staged(spark: SparkSession, sf_dir: str) -> S.Staged:
    return S.stage(landed(spark, sf_dir), facts(spark, sf_dir))


QUERIES["staged_claims"] = lambda spark, sf_dir: _staged(spark, sf_dir).claims.select("id", "subject_id", "predicate", "object_id", "source", "detail", "status")
QUERIES["staged_refs"] = lambda spark, sf_dir: _staged(spark, sf_dir).refs.select("id", "node", "method")
QUERIES["staged_edges"] = lambda spark, sf_dir: _staged(spark, sf_dir).edges.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("ends"))
_SAID = f"""with recursive {GRAPH_SQL},
w as (select *, user_id % n s, event_id % 4 kind from events, nsup),
r as (select *, case kind when 0 then 'ent_s' || s when 1 then 'ref_a' || s when 2 then 'ref_b' || s else 'ref_c' || user_id end ref, 'ent_s' || ((user_id * 7 + 1) % n) oid from w),
leis as (select lei, min(id) id from entity where lei is not null group by lei),
refs as (select ref id, case any_value(kind) when 0 then ref when 1 then 'ent_s' || any_value(s) when 2 then coalesce(any_value(leis.id), min(min(ref)) over (partition by any_value(kind), case any_value(kind) when 2 then any_value(s) // 2 else any_value(user_id) % 7 end))
      else min(ref) over (partition by any_value(kind), case any_value(kind) when 2 then any_value(s) // 2 else any_value(user_id) % 7 end) end node,
    any_value(kind) kind, any_value(leis.id) hit from r left join leis on kind = 2 and leis.lei = 'LEI' || (s // 2) group by ref),
m as (select r.*, node, 'clm_' || substr(sha1(concat_ws('|', node, p, oid, '', 'src_' || (event_id % 3), event_type, '')), 1, 12) cid, case when event_id % 5 < 3 then 'art_' || substr(sha1('https://example.org/e/' || (event_id % 50)), 1, 12) end aid
  from (select *, case when event_id % 3 = 0 then 'OWNS' else 'SUPPLIES' end p from r) r join refs on refs.id = ref)
"""
ORACLES["staged_claims"] = f"{_SAID} select distinct cid id, node subject_id, p predicate, oid object_id, 'src_' || (event_id % 3) source, event_type detail, case when node = oid then 'rejected' else 'staged' end status from m"
ORACLES["staged_refs"] = f"""{_SAID} select id, node, case when kind = 0 then 'id' when kind = 1 then 'name_exact' when hit is not null then 'lei' when id = node and count(*) over (partition by node) >= 1 then 'new' else 'group' end method from refs
  union select distinct oid, oid, 'id' from r"""
ORACLES["staged_edges"] = f"""{_SAID}, e as (select distinct cid src, 'ASSERTS' "type", node dst from m union select cid, 'TARGETS', oid from m union select aid, 'EVIDENCES', cid from m where aid is not null union select aid, 'ABOUT', node from m where aid is not null)
select "type", count(*) n, count(distinct src) sources, count(distinct dst) ends from e group by 1"""
