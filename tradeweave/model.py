"""The graph: one DataFrame for each kind of node and edge, and its projection from the TPC-H-like tables.

A Graph is a frozen set of lazy DataFrames. Edges are kept by type, which is what partitioning one edge table by type gives:
a query names the types it walks and reads no others.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.rounds import shared

#: Fixed values. Codes of the nations by number, chosen to cover all classes of jurisdictions.
CODES = "US CA GB DE FR JP KR IN MX BR CN RU TR IL AE SG AU UA HK VN ZA PL IT TW IR".split()
#: Kinds of categories by part type.
GOODS = ("ECONOMY", "SMALL", "MEDIUM", "LARGE")
#: Edge types: what may be asked for.
EDGE_TYPES = (
    "SUPPLIES OWNS ULTIMATE_PARENT_OF HELD_ROLE BENEFICIAL_OWNER_OF MEMBER_OF TRANSACTS_WITH LOBBIES DONATED_TO PROVIDES SUBCATEGORY_OF "
    "INCORPORATED_IN OPERATES_IN MANUFACTURES_IN PARENT_SEATED_IN EVIDENCES ASSERTS TARGETS ABOUT REPORTS_ON CITES"
).split()
NODE_LABELS = "Entity Person Category Location Artifact Claim Report".split()
#: Edges of control and personnel, walked both ways by exposure.
CONTROL = ("OWNS", "ULTIMATE_PARENT_OF", "BENEFICIAL_OWNER_OF", "HELD_ROLE", "TRANSACTS_WITH", "MEMBER_OF")


#: Types of edges that the projection has.
PROJECTED = ("SUPPLIES", "OWNS", "HELD_ROLE", "PROVIDES", "SUBCATEGORY_OF", "ABOUT", "INCORPORATED_IN", "MANUFACTURES_IN", "OPERATES_IN", "PARENT_SEATED_IN")


@dataclass(frozen=True)
class Graph:
    """entity (id, name, kind, flagged, registration_status, registration_expires, entity_status, public, risk_score, risk_band, risk_confidence,
    lei, price_change_12m), person (id, name, flagged), category (id, name, kind, parent), location (id, code, name, kind), artifact (id, url,
    title, kind, form, source, published_at), claim (id, predicate, subject_id, object_id, object_value, source, trust, confidence, status, retrieved_at, detail),
    edges: by type, each with src and dst and properties of its own."""

    spark: SparkSession
    entity: DataFrame
    person: DataFrame
    category: DataFrame
    location: DataFrame
    artifact: DataFrame
    claim: DataFrame
    edges: dict[str, DataFrame]

    def edge(self, *types: str) -> DataFrame:
        """id, src, dst, type of the edges of these types."""
        out = None
        for t in types:
            if t in self.edges:
                one = self.edges[t].select("id", "src", "dst", F.lit(t).alias("type"))
                out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "id string, src string, dst string, type string")

    @cached_property
    def all_edges(self) -> DataFrame:
        return self.edge(*self.edges)

    @cached_property
    def nodes(self) -> DataFrame:
        """id, label, kind, name, risk_score, flagged of every node."""
        none, no = F.lit(None).cast("int"), F.lit(None).cast("boolean")
        parts = [
            self.entity.select("id", F.lit("Entity").alias("label"), "kind", "name", F.col("risk_score").cast("int").alias("risk_score"), "flagged"),
            self.person.select("id", F.lit("Person").alias("label"), F.lit("person").alias("kind"), "name", none.alias("risk_score"), "flagged"),
            self.category.select("id", F.lit("Category").alias("label"), "kind", "name", none.alias("risk_score"), no.alias("flagged")),
            self.location.select("id", F.lit("Location").alias("label"), "kind", "name", none.alias("risk_score"), no.alias("flagged")),
            self.artifact.select("id", F.lit("Artifact").alias("label"), "kind", F.col("title").alias("name"), none.alias("risk_score"), no.alias("flagged")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)


def _edge_id(type_: str, *more: str):
    return F.concat(F.lit("rel_"), F.substring(F.sha1(F.concat_ws("|", F.lit(type_), "src", "dst", *more)), 1, 12))


def _code(number):
    return F.element_at(F.array(*map(F.lit, CODES)), (number % len(CODES)).cast("int") + 1)


def project(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers and customers become entities, orders their supply, users of events the people who hold roles."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sup, cust = t("supplier"), t("customer")
    s = F.col("s_suppkey")
    score = F.when(s % 7 == 3, F.lit(None)).otherwise((s * 37) % 101).cast("int")
    from .functions.dims import band_of

    suppliers = sup.select(
        F.concat(F.lit("ent_s"), s).alias("id"), F.col("s_name").alias("name"), F.lit("organization").alias("kind"), F.col("s_nationkey").cast("long").alias("nation"),
        (s % 23 == 5).alias("flagged"), F.when(s % 5 == 1, "Active").when(s % 5 == 2, "Expired").alias("registration_status"),
        F.when(s % 5 < 3, F.concat(F.lit("20"), F.lpad((24 + s % 4).cast("string"), 2, "0"), F.lit("-06-15"))).alias("registration_expires"),
        F.when(s % 19 == 7, "Dissolved").alias("entity_status"), (s % 3 == 0).alias("public"), score.alias("risk_score"), band_of(score).alias("risk_band"),
        F.when(score.isNotNull(), 20 + (s * 13) % 81).cast("int").alias("risk_confidence"), F.when(s % 3 == 0, F.concat(F.lit("LEI"), F.floor(s / 2))).alias("lei"),
        F.when(s % 17 == 3, -60.0).when(s % 17 == 5, -30.0).when(s % 17 == 7, 5.0).alias("price_change_12m"),
    )
    c = F.col("c_custkey")
    customers = cust.select(
        F.concat(F.lit("ent_c"), c).alias("id"), F.col("c_name").alias("name"), F.when(c % 50 == 0, "program").otherwise("organization").alias("kind"), F.col("c_nationkey").cast("long").alias("nation"),
        F.lit(False).alias("flagged"), *(F.lit(None).cast("string").alias(n) for n in ("registration_status", "registration_expires", "entity_status")), F.lit(False).alias("public"),
        F.lit(None).cast("int").alias("risk_score"), F.lit(None).cast("string").alias("risk_band"), F.lit(None).cast("int").alias("risk_confidence"),
        F.lit(None).cast("string").alias("lei"), F.lit(None).cast("double").alias("price_change_12m"),
    )
    entity = suppliers.unionByName(customers)

    line = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = line.groupBy("l_suppkey", "o_custkey").agg(
        (F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) * 100) / 100).alias("amount"), F.count_distinct("l_orderkey").alias("award_count"), F.min("l_orderkey").alias("first_order")
    )
    tier1 = pairs.select(
        F.concat(F.lit("ent_s"), "l_suppkey").alias("src"), F.concat(F.lit("ent_c"), "o_custkey").alias("dst"), F.lit(1).alias("tier"),
        ((F.col("l_suppkey") + F.col("o_custkey")) % 11 == 0).alias("sole_source"), "amount", "award_count", F.concat(F.lit("ord_"), "first_order").alias("contract_ref"),
    )
    # the second source of each part, by quantity, supplies its lead source
    sums = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    ranked = sums.withColumn("k", F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("q"), "l_suppkey")))
    lead = ranked.where("k = 1").select("l_partkey", F.col("l_suppkey").alias("above"))
    tier2 = ranked.where("k = 2").join(lead, "l_partkey").groupBy("l_suppkey", "above").agg(F.sum("q").alias("amount"), F.count("*").alias("award_count"), F.min("l_partkey").alias("part")).select(
        F.concat(F.lit("ent_s"), "l_suppkey").alias("src"), F.concat(F.lit("ent_s"), "above").alias("dst"), F.lit(2).alias("tier"),
        ((F.col("l_suppkey") + F.col("above")) % 5 == 0).alias("sole_source"), "amount", "award_count", F.concat(F.lit("part_"), "part").alias("contract_ref"),
    )
    supplies = tier1.unionByName(tier2).withColumn("id", _edge_id("SUPPLIES"))
    owns = sup.where("s_suppkey >= 4").select(
        F.concat(F.lit("ent_s"), F.floor(s / 4)).alias("src"), F.concat(F.lit("ent_s"), s).alias("dst"), (50 + s % 51).cast("double").alias("pct")
    ).withColumn("id", _edge_id("OWNS"))

    def place(df: DataFrame, type_: str, number) -> DataFrame:
        code = _code(number)
        return df.select(F.col("id").alias("src"), F.concat(F.lit("loc_"), code).alias("dst"), code.alias("code")).withColumn("id", _edge_id(type_))

    key = suppliers.withColumn("k", F.substring("id", 6, 20).cast("long"))
    event = t("events")
    u = F.col("user_id")
    n = F.lit(max(1, sup.count()))  # from the footers of the files
    seats = event.groupBy("user_id", "event_type").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("from"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("until"))
    seats = seats.withColumn("seat", F.explode(F.when(u % 3 == 0, F.array(u % n, (u * 7 + 1) % n)).otherwise(F.array(u % n))))
    role = seats.select(
        F.concat(F.lit("per_u"), u).alias("src"), F.concat(F.lit("ent_s"), "seat").alias("dst"), F.col("event_type").alias("title"), "from",
        F.when(F.col("until") < "2024-01-30", F.col("until")).alias("to"),
    ).withColumns({"current": F.col("to").isNull(), "id": _edge_id("HELD_ROLE", "title")})
    person = event.select("user_id").distinct().select(F.concat(F.lit("per_u"), u).alias("id"), F.concat(F.lit("Person "), u).alias("name"), (u % 29 == 4).alias("flagged"))
    e = F.col("event_id")
    screens = F.array(*map(F.lit, ("sanctions_screen", "exclusion_screen", "restricted_list_screen", "financial_screen", "adverse_media_screen")))
    claim = event.select(
        F.concat(F.lit("clm_"), e).alias("id"), F.element_at(screens, (e % 5 + 1).cast("int")).alias("predicate"), F.concat(F.lit("ent_s"), (e * 31 + u) % n).alias("subject_id"),
        F.when(e % 29 == 0, F.concat(F.lit("ent_s"), (e * 31 + e % 2) % n)).alias("object_id"),
        F.when(e % 5 < 3, F.when(e % 97 == 0, "hit").otherwise("clear")).otherwise(F.element_at(F.array(*map(F.lit, ("clear", "low", "medium", "high"))), (F.floor(F.col("value")) % 4 + 1).cast("int"))).alias("object_value"),
        F.concat(F.lit("src_"), e % 3).alias("source"), F.when(e % 2 == 0, "authoritative").otherwise("open").alias("trust"), F.round(0.5 + (e % 50) / 100, 2).alias("confidence"),
        F.when(e % 11 == 10, "staged").when(e % 13 == 12, "rejected").otherwise("committed").alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("retrieved_at"), F.concat(F.lit("detail "), e % 7).alias("detail"),
    )
    doc = t("documents")
    d = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("award", "filing", "news", "web", "document", "registry", "record")))
    artifact = doc.select(
        F.concat(F.lit("art_d"), d).alias("id"), F.concat(F.lit("https://example.org/d/"), d).alias("url"), F.concat(F.lit("Document "), d).alias("title"), F.element_at(kinds, (d % 7 + 1).cast("int")).alias("kind"),
        F.when((d % 7 == 1) & (d % 31 < 5), "NT 10-K").when(d % 7 == 1, "10-K").alias("form"),
        "source", F.concat(F.lit("20"), F.lpad((20 + d % 5).cast("string"), 2, "0"), F.lit("-0"), d % 9 + 1, F.lit("-11")).alias("published_at"),
    )
    about = doc.select(F.concat(F.lit("art_d"), d).alias("src"), F.concat(F.lit("ent_s"), (d * 3 + 1) % n).alias("dst")).withColumn("id", _edge_id("ABOUT"))
    types = t("part").select("p_type").distinct()
    tops = spark.createDataFrame([("cat_goods", "Goods", "goods", None), ("cat_services", "Services", "services", None)], "id string, name string, kind string, parent string")
    below = types.select(F.concat(F.lit("cat_"), F.lower("p_type")).alias("id"), F.col("p_type").alias("name"), F.lit("type").alias("kind"), F.when(F.col("p_type").isin(*GOODS), "cat_goods").otherwise("cat_services").alias("parent"))
    category = tops.unionByName(below)
    subcategory = below.select(F.col("id").alias("src"), F.col("parent").alias("dst")).withColumn("id", _edge_id("SUBCATEGORY_OF"))
    provides = t("lineitem").select("l_partkey", "l_suppkey").distinct().join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("ent_s"), "l_suppkey").alias("src"), F.concat(F.lit("cat_"), F.lower("p_type")).alias("dst")
    ).distinct().withColumn("id", _edge_id("PROVIDES"))
    location = spark.createDataFrame([(f"loc_{x}", x, x, "country") for x in CODES], "id string, code string, name string, kind string")
    edges = {
        "SUPPLIES": supplies, "OWNS": owns, "HELD_ROLE": role, "PROVIDES": provides, "SUBCATEGORY_OF": subcategory, "ABOUT": about,
        "INCORPORATED_IN": place(entity, "INCORPORATED_IN", F.col("nation")), "MANUFACTURES_IN": place(key, "MANUFACTURES_IN", F.col("k") * 7),
        "OPERATES_IN": place(key.where("k % 3 = 0"), "OPERATES_IN", F.col("k") * 11), "PARENT_SEATED_IN": place(key.where("k % 4 = 1"), "PARENT_SEATED_IN", F.col("k") * 5),
    }
    return Graph(spark, entity.drop("nation"), person, category, location, artifact, claim, edges)


_landed: dict[tuple[str, str], str] = {}
#: Bytes of the input files for which a shuffle has one partition more; adaptive execution puts small ones together.
PART_BYTES = 4 << 20


def deal_out(spark: SparkSession, sf_dir: str) -> None:
    """Shuffles of this session have as many partitions as the tables ask for, if that is more than it has: a task's share, and its memory,
    then don't grow with the input. Sizes are those of the files."""
    size = sum(int(str(spark.read.parquet(f"{sf_dir}/{t}.parquet")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in ("lineitem", "orders", "events"))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)))


def landed(spark: SparkSession, sf_dir: str) -> Graph:
    """The projected graph, written once a session to the shared folder: a table for each kind of node, one for each type of edge,
    sorted by its far end. Queries then read the types and columns they need, with statistics, and walks join plain scans."""
    key = (spark.sparkContext.applicationId, sf_dir)
    tables = ("entity", "person", "category", "location", "artifact", "claim")
    deal_out(spark, sf_dir)
    if key not in _landed:
        g, path = project(spark, sf_dir), f"{shared(spark)}/graph-{uuid.uuid4().hex[:12]}"
        for name in tables:
            getattr(g, name).write.parquet(f"{path}/{name}")
        for type_, df in g.edges.items():
            df.sortWithinPartitions("dst").write.parquet(f"{path}/edge/{type_}")
        _landed[key] = path
    read = lambda name: spark.read.parquet(f"{_landed[key]}/{name}")
    return Graph(spark, **{n: read(n) for n in tables}, edges={t: read(f"edge/{t}") for t in PROJECTED})


#: The same projection in DuckDB's SQL, for the oracles: a chain of common table expressions.
_codes = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
GRAPH_SQL = f"""
sups as (select s_suppkey k, s_nationkey nation, case when s_suppkey % 7 = 3 then null else (s_suppkey * 37) % 101 end sc, * from supplier),
entity as (select 'ent_s' || k id, s_name as name, 'organization' kind, k % 23 = 5 flagged, case k % 5 when 1 then 'Active' when 2 then 'Expired' end registration_status,
    case when k % 5 < 3 then '20' || (24 + k % 4) || '-06-15' end registration_expires, case when k % 19 = 7 then 'Dissolved' end entity_status, k % 3 = 0 as public, sc risk_score,
    case when sc is null then null when sc >= 75 then 'severe' when sc >= 50 then 'high' when sc >= 25 then 'elevated' else 'low' end risk_band,
    case when sc is not null then 20 + (k * 13) % 81 end risk_confidence, case when k % 3 = 0 then 'LEI' || (k // 2) end lei,
    case k % 17 when 3 then -60.0 when 5 then -30.0 when 7 then 5.0 end::double price_change_12m, nation from sups
  union all select 'ent_c' || c_custkey, c_name, case when c_custkey % 50 = 0 then 'program' else 'organization' end, false, null, null, null, false, null, null, null, null, null, c_nationkey from customer),
ranked as (select l_partkey, l_suppkey, sum(l_quantity) q, row_number() over (partition by l_partkey order by sum(l_quantity) desc, l_suppkey) k
    from lineitem group by l_partkey, l_suppkey),
supplies as (select 'rel_' || substr(sha1('SUPPLIES|' || src || '|' || dst), 1, 12) id, * from (
  select 'ent_s' || l_suppkey src, 'ent_c' || o_custkey dst, 1 tier, (l_suppkey + o_custkey) % 11 = 0 sole_source, round(sum(l_extendedprice * (1 - l_discount)), 2) amount,
    count(distinct l_orderkey) award_count, 'ord_' || min(l_orderkey) contract_ref from lineitem join orders on l_orderkey = o_orderkey group by l_suppkey, o_custkey
  union all
  select 'ent_s' || l_suppkey, 'ent_s' || above, 2, (l_suppkey + above) % 5 = 0, sum(q), count(*), 'part_' || min(l_partkey) from (
    select a.l_partkey, a.l_suppkey, b.l_suppkey above, a.q from ranked a join ranked b on a.l_partkey = b.l_partkey and a.k = 2 and b.k = 1) group by l_suppkey, above)),
owns as (select 'rel_' || substr(sha1('OWNS|ent_s' || (k // 4) || '|ent_s' || k), 1, 12) id, 'ent_s' || (k // 4) src, 'ent_s' || k dst, (50 + k % 51)::double pct from sups where k >= 4),
place as (select 'INCORPORATED_IN' as type, id src, ({_codes})[(nation % 25) + 1] code from entity
  union all select 'MANUFACTURES_IN', 'ent_s' || k, ({_codes})[(k * 7) % 25 + 1] from sups
  union all select 'OPERATES_IN', 'ent_s' || k, ({_codes})[(k * 11) % 25 + 1] from sups where k % 3 = 0
  union all select 'PARENT_SEATED_IN', 'ent_s' || k, ({_codes})[(k * 5) % 25 + 1] from sups where k % 4 = 1),
nsup as (select count(*) n from supplier),
role as (select 'rel_' || substr(sha1('HELD_ROLE|' || src || '|' || dst || '|' || title), 1, 12) id, *, "to" is null as current from (
  select 'per_u' || user_id src, 'ent_s' || seat dst, event_type title, f as "from", case when u < '2024-01-30' then u end as "to" from (
    select user_id, event_type, f, u, unnest(case when user_id % 3 = 0 then [user_id % n, (user_id * 7 + 1) % n] else [user_id % n] end) seat from (
      select user_id, event_type, strftime(min(ts), '%Y-%m-%d') f, strftime(max(ts), '%Y-%m-%d') u from events group by all), nsup))),
person as (select distinct 'per_u' || user_id id, 'Person ' || user_id as name, user_id % 29 = 4 flagged from events),
claim as (select 'clm_' || event_id id, (['sanctions_screen', 'exclusion_screen', 'restricted_list_screen', 'financial_screen', 'adverse_media_screen'])[event_id % 5 + 1] predicate,
    'ent_s' || ((event_id * 31 + user_id) % n) subject_id, case when event_id % 29 = 0 then 'ent_s' || ((event_id * 31 + event_id % 2) % n) end object_id,
    case when event_id % 11 = 10 then 'staged' when event_id % 13 = 12 then 'rejected' else 'committed' end status, case when event_id % 5 < 3 then case when event_id % 97 = 0 then 'hit' else 'clear' end
      else (['clear', 'low', 'medium', 'high'])[floor(value)::int % 4 + 1] end object_value, 'src_' || (event_id % 3) source, case when event_id % 2 = 0 then 'authoritative' else 'open' end trust,
    round(0.5 + (event_id % 50) / 100, 2) confidence, strftime(ts, '%Y-%m-%dT%H:%M:%S') retrieved_at, 'detail ' || (event_id % 7) detail, event_id from events, nsup),
artifact as (select 'art_d' || doc_id id, 'Document ' || doc_id title, (['award', 'filing', 'news', 'web', 'document', 'registry', 'record'])[doc_id % 7 + 1] kind, source, case when doc_id % 7 = 1 then case when doc_id % 31 < 5 then 'NT 10-K' else '10-K' end end form,
    '20' || (20 + doc_id % 5) || '-0' || (doc_id % 9 + 1) || '-11' published_at from documents),
about as (select 'art_d' || doc_id src, 'ent_s' || ((doc_id * 3 + 1) % n) dst from documents, nsup),
category as (select distinct 'cat_' || lower(p_type) id, p_type as name, 'type' kind, case when p_type in {GOODS} then 'cat_goods' else 'cat_services' end parent from part
  union all select 'cat_goods', 'Goods', 'goods', null union all select 'cat_services', 'Services', 'services', null),
provides as (select distinct 'ent_s' || l_suppkey src, 'cat_' || lower(p_type) dst from lineitem join part on l_partkey = p_partkey)
"""
