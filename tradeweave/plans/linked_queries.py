"""Linked resources over suppliers and the users of all events: each supplier and user is a landed record, each user's first event of a
type a position, each supplier's owner and head a tie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import linked as L
from .registry import ORACLES, QUERIES


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, body): a document for each supplier and user, and one for each list of relationships."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    s, u, e = F.col("s_suppkey"), F.col("user_id"), F.col("event_id")
    record = lambda kind, number, **a: F.struct(F.lit(kind).alias("type"), number.alias("id"), F.struct(number.alias("id"), *[c.alias(n) for n, c in a.items()]).alias("attributes"))
    body = lambda c: F.to_json(F.struct(c.alias("data")))
    kinds = F.when(s % 3 == 0, F.array(F.lit("Business"))).when(s % 3 == 1, F.array(F.lit("School"), F.lit("Law Firm"))).otherwise(F.array(F.lit("School")))
    orgs = t("supplier").select(F.lit(0).cast("long").alias("page"), body(record("entities", s * 2 + 2, name=F.col("s_name"), primary_ext=F.lit("Org"), types=kinds)).alias("body"))
    users = t("events").select("user_id").distinct()
    people = users.select(F.lit(0).cast("long").alias("page"), body(record("entities", u * 2 + 1, name=F.concat(F.lit("Person "), u), primary_ext=F.lit("Person"), types=F.when(u % 5 == 0, F.array(F.lit("Lobbyist"))).otherwise(F.array().cast("array<string>")))).alias("body"))
    n = max(1, t("supplier").count())
    first = t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.date_format(F.min("ts"), "yyyy-MM").alias("month"))
    flags = F.struct((F.length("event_type") % 2 == 0).alias("is_board"), (e % 3 == 0).alias("is_executive"))
    position = record("relationships", e * 3 + 1, category_id=F.lit(L.POSITION), entity1_id=u * 2 + 1, entity2_id=((e * 31 + u) % n) * 2 + 2, start_date=F.col("month"), is_current=F.when(e % 4 == 0, F.lit(False)), category_attributes=flags)
    seats = first.select(e.alias("page"), F.to_json(F.struct(F.array(position).alias("data"))).alias("body"))
    owned = record("relationships", s * 3 + 2, category_id=F.lit(L.OWNERSHIP), entity1_id=F.floor(s / 4) * 2 + 2, entity2_id=s * 2 + 2, category_attributes=F.struct((50 + s % 51).alias("percent_stake")))
    headed = record("relationships", s * 3 + 3, category_id=F.lit(L.HIERARCHY), entity1_id=s * 2 + 2, entity2_id=F.floor(s / 3) * 2 + 2)
    up = t("supplier").select((s + 1).cast("long").alias("page"), F.to_json(F.struct(F.array(owned).alias("data"), F.array(headed).alias("included"))).alias("body"))
    return orgs.unionByName(people).unionByName(seats).unionByName(up)


def linked_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = L.records(pages(spark, sf_dir))
    ents, rels = L.entities(recs), L.relationships(recs)
    s = F.col("s_suppkey")
    subjects = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("ent_s"), s).alias("id"), (s * 2 + 2).cast("long").alias("number"), F.col("s_name").alias("name"))
    return L.roles(subjects, ents, rels).unionByName(L.ties(subjects, ents, rels)).select("subject", "src", "type", "dst", "title", "role_type", "from", "current", "pct", "via", "confidence", "url")


QUERIES["linked_ties"] = linked_ties
_norm = "trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g'))"
_url = lambda n: f"'{L.SITE}/relationships/' || ({n})"
_seat = """case when board then 'Director' when executive then 'Executive' else 'Position' end title, case when board and executive then 'both' when board then 'board' when executive then 'executive' else 'position' end role_type, month || '-01' "from", current"""
ORACLES["linked_ties"] = f"""
with n as (select count(*) n from supplier),
o as (select s_suppkey s, 'ent_s' || s_suppkey id, 'ent_' || substr(sha1('name|' || {_norm}), 1, 12) node from supplier),
p as (select distinct user_id u, 'per_' || substr(sha1('person ' || user_id || '|littlesis:' || (user_id * 2 + 1)), 1, 12) node from events),
f as (select user_id u, event_type, min(event_id) e, strftime(min(ts), '%Y-%m') as month from events group by all),
r as (select u, e, (e * 31 + u) % n s, month, length(event_type) % 2 = 0 board, e % 3 = 0 executive, e % 4 <> 0 as current from f, n),
led as (select * from r where board or executive qualify row_number() over (partition by s order by e) <= {L.PEOPLE}),
own as (select o.id subject, p.node src, 'HELD_ROLE' "type", o.id dst, {_seat}, null::double pct, null via, 0.85 confidence, {_url("e * 3 + 1")} url from led join o using (s) join p using (u)),
who as (select distinct s here, u from led),
far as (select o.id subject, p.node src, 'HELD_ROLE' "type", x.node dst, {_seat}, null::double pct, null via, 0.8 confidence, {_url("e * 3 + 1")} url
  from who join r using (u) join o x on x.s = r.s join o on o.s = here join p using (u) where r.s <> here and r.s % 3 < 2 qualify row_number() over (partition by here, u order by e) <= {L.SEATS}),
tie as (select s mine, true me_first, s // 4 a, s b, 'own' kind from o union all select s // 4, false, s // 4, s, 'own' from o union all select s, true, s, s // 3, 'head' from o union all select s // 3, false, s, s // 3, 'head' from o),
t as (select *, row_number() over (partition by mine, kind order by case kind when 'own' then b else a end) k from (select distinct mine, a, b, kind from tie where a <> b) qualify k <= 15),
up as (select 'ent_s' || mine subject, case when mine = x then 'ent_s' || mine else ox.node end src, 'OWNS' "type", case when mine = y then 'ent_s' || mine else oy.node end dst, null title, null role_type, null "from", true as current, pct, via, confidence, url from (
    select mine, a x, b y, (50 + b % 51)::double pct, null via, 0.8 confidence, {_url("b * 3 + 2")} url from t where kind = 'own'
    union all select mine, b, a, null, 'hierarchy', 0.7, {_url("a * 3 + 3")} from t where kind = 'head') join o ox on ox.s = x join o oy on oy.s = y)
select subject, src, "type", dst, title, role_type, "from", current, pct, via, confidence::double confidence, url from (from own union all from far union all from up)"""
