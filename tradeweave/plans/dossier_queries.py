"""Queries of profiles, and their SQL in the terms of the graph's common table expressions.

The projection has no ties beyond supply, no agencies and no unknown seats; told() adds some of each, and TOLD does so in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Graph
from . import dossier as D
from . import profiles as P
from .registry import ROOT, add, reach_sql, up


def told(g: Graph) -> Graph:
    """g with agencies, tickers, lobbyists, officials, ties, evidence, and some entities that no register places."""
    number = lambda c: F.when(F.col(c).startswith("ent_s"), F.substring(c, 6, 20).cast("long"))
    k = number("id")
    entity = g.entity.withColumns(
        {
            "kind": F.when(k % 31 == 9, "agency").otherwise(F.col("kind")), "name": F.when(k % 16 == 3, F.concat(F.lit("Royal "), "name")).otherwise(F.col("name")),
            "ticker": F.when(k % 6 == 0, F.concat(F.lit("T"), k)), "lda_registrant_id": F.when(k % 37 == 2, F.concat(F.lit("L"), k)),
        }
    )
    person = g.person.withColumn("public_official", F.substring("id", 6, 20).cast("long") % 41 == 7)
    a, b = number("src"), number("dst")
    tier2 = g.edges["SUPPLIES"].where("tier = 2").where((a * 7 + b) % 9 == 0)
    ties = {t: tier2.where((a + b) % 4 == i).select("id", "src", "dst") for i, t in enumerate(D.TIES)}
    proof = g.artifact.select(F.concat(F.lit("ev_"), "id").alias("id"), F.col("id").alias("src"), F.concat(F.lit("clm_"), F.substring("id", 6, 20)).alias("dst"))
    home = g.edges["INCORPORATED_IN"].where(a.isNull() | (a % 8 != 3))
    return g.with_(entity=entity, person=person, edges={**g.edges, **ties, "EVIDENCES": proof, "INCORPORATED_IN": home})


TOLD = f"""ent2 as (select id, case when ks % 31 = 9 then 'agency' else kind end kind, case when ks % 16 = 3 then 'Royal ' || name else name end as name, flagged, public, lei,
    case when ks % 6 = 0 then 'T' || ks end ticker, case when ks % 37 = 2 then 'L' || ks end lda from (select *, case when starts_with(id, 'ent_s') then substr(id, 6)::int end ks from entity)),
per2 as (select id, substr(id, 6)::int % 41 = 7 official from person),
inc as (select src id, min(code) code from place where type = 'INCORPORATED_IN' and not (starts_with(src, 'ent_s') and substr(src, 6)::int % 8 = 3) group by src),
sat as (select src id, min(code) code from place where type = 'PARENT_SEATED_IN' group by src),
tie as (select src, dst, ({list(D.TIES)})[(a + b) % 4 + 1] t from (select src, dst, substr(src, 6)::int a, substr(dst, 6)::int b from supplies where tier = 2) where (a * 7 + b) % 9 = 0),
aff as (select w.id, t, outbound, o, e.name, e.kind, e.flagged, not starts_with(coalesce(inc.code, case when t <> 'OWNS' then sat.code end), 'US') "foreign" from (
    select src id, dst o, t, true outbound from tie union all select dst, src, t, false from tie union all select src, dst, 'OWNS', true from owns) w
  join ent2 e on e.id = o left join inc on inc.id = o left join sat on sat.id = o),
aff2 as (select *, "foreign" is null and regexp_matches(lower(name), '{D.HINT}') hint from aff),
late as (select subject_id id, predicate p, object_value v from claim where ends_with(predicate, '_screen') and status = 'committed'
  qualify row_number() over (partition by subject_id, predicate order by retrieved_at desc nulls first, claim.id) = 1)"""
_SEATS = """held as (select r.src p, r.dst id, r.current cur, e.kind, e.lei, e.flagged, r.dst in (select src from supplies) sells from role r join ent2 e on e.id = r.dst),
pair as (select a.p, a.id, a.cur, bool_or(b.flagged and b.cur) f_now, bool_or(b.flagged and not b.cur) f_then, bool_or(b.sells and b.kind <> 'agency' and b.cur) s_now,
    bool_or(b.sells and b.kind <> 'agency' and not b.cur) s_then, bool_or(b.kind = 'agency' and b.cur) g_now, bool_or(b.kind = 'agency' and not b.cur) g_then
  from (select distinct p, id, cur, lei from held) a left join (select distinct p, id, cur, kind, lei, flagged, sells from held) b on a.p = b.p and a.id <> b.id and (a.lei is null or b.lei is null or a.lei <> b.lei) group by all),
i_people as (select id, case when bool_or(not cur and f_now) then 2 when bool_or(cur and f_now) then 3 when bool_or(cur and f_then) or bool_or(cur and s_then) then 2 when bool_or(cur and s_now) then 1 else 0 end r from pair group by id),
i_gov as (select pair.id, case when bool_or(g_now) then 2 when bool_or(g_then) or bool_or(official) then 1 else 0 end r from pair join per2 on per2.id = p where cur group by pair.id)"""
_graded = "case v when 'clear' then 0 when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 1 end"
IND = f"""ind9 as (select e.id,
    case when sat.code is not null then case when starts_with(sat.code, 'US') then 0 else 3 end when e.id in (select dst from owns) then 1 end ownership,
    (select case when bool_or(sole_source) then 2 else 0 end from supplies where src = e.id having count(*) > 0) concentration, i_people.r people, i_gov.r government,
    (select max(case when flagged then 3 when "foreign" then 2 when hint then 1 else 0 end) from aff2 where aff2.id = e.id and t in ('MEMBER_OF', 'TRANSACTS_WITH', 'OWNS')) affiliations,
    case when exists (from aff2 where aff2.id = e.id and t = 'LOBBIES') then 1 when exists (from aff2 where aff2.id = e.id and t = 'DONATED_TO') then 0 when lda is not null then 1 end political,
    (select max(case when v = 'hit' then 3 else 0 end) from late where late.id = e.id and p in {P.DESIGNATING}) sanctions,
    coalesce((select max({_graded}) from late where late.id = e.id and p = 'financial_screen'), case when public and ticker is not null then 0 end) financial,
    (select max({_graded}) from late where late.id = e.id and p = 'adverse_media_screen') media
  from ent2 e left join sat using (id) left join i_people using (id) left join i_gov using (id))"""
_ALL = ", ".join((TOLD, _SEATS, IND))
_has = " + ".join(f"({f} is not null)::int" for f in D.FAMILIES)
_sum = " + ".join(f"3 * coalesce({f}, 0)" for f in D.FAMILIES)
_top = " + ".join(f"case when {f} = 0 then 1 when {f} is not null then 3 else 0 end" for f in D.FAMILIES)

add("entity_core", D.entity_core, """select id, name, i.code incorporated, p.code parent_seat, manufactures, operates, direct_parents, coalesce(categories, 0) categories from entity
  left join (select src id, min(code) code from place where type = 'INCORPORATED_IN' group by src) i using (id) left join (select src id, min(code) code from place where type = 'PARENT_SEATED_IN' group by src) p using (id)
  left join (select src id, string_agg(distinct code, ',' order by code) manufactures from place where type = 'MANUFACTURES_IN' group by src) using (id)
  left join (select src id, string_agg(distinct code, ',' order by code) operates from place where type = 'OPERATES_IN' group by src) using (id)
  left join (select dst id, string_agg(distinct src || ':' || pct::int, ',' order by src || ':' || pct::int) direct_parents from owns group by dst) using (id)
  left join (select src id, count(distinct dst) categories from provides group by src) using (id)""")  # fmt: skip
add("supply_summary", lambda g: D.supply_summary(g, ROOT), f"""select e.id, coalesce(supplies, 0) supplies, coalesce(sole_source_edges, 0) sole_source_edges, coalesce(suppliers, 0) suppliers, coalesce(awards, 0) awards, tier_from_root from entity e
  left join (select src id, count(*) supplies, count(*) filter (sole_source) sole_source_edges from supplies group by src) using (id) left join (select dst id, count(*) suppliers from supplies group by dst) using (id)
  left join (select dst id, count(*) awards from about join artifact a on a.id = about.src where kind = 'award' group by dst) using (id)
  left join (select id, hops tier_from_root from six where hops > 0 and id <> '{ROOT}') using (id)""", reach_sql("six", f"select '{ROOT}' id", up, D.ROOT_HOPS))  # fmt: skip
add("affiliations", lambda g: D.affiliations(told(g)), """select id, t as "type", outbound, o other, name, kind, flagged, "foreign", hint foreign_hint, true as current from aff2""", TOLD)
add("documents_of", lambda g: D.documents_of(told(g)), """select id, artifact_id, published_at, row_number() over (partition by id order by published_at desc nulls first, artifact_id) as rank from (
    select dst id, src artifact_id from about union select subject_id, a.id from artifact a join claim c on c.id = 'clm_' || substr(a.id, 6)) x join artifact on artifact.id = artifact_id qualify rank <= 50""".replace("select id, artifact_id", "select x.id, artifact_id", 1).replace("partition by id", "partition by x.id"))  # fmt: skip
add("news_of", D.news, "select dst id, src artifact_id, published_at, row_number() over (partition by dst order by published_at desc nulls first, src) as rank from about join artifact a on a.id = src where kind = 'news' qualify rank <= 10")
add("risk_indicators", lambda g: D.indicators(told(g)), "from ind9", _ALL)
add("risk_indicator_mean", lambda g: D.indicator_mean(D.indicators(told(g))), f"select id, case when ({_top}) > 0 then round_even(100 * ({_sum}) / (3 * ({_top})), 0)::int end composite, {_has} families_with_data from ind9", _ALL)
add("risk_tab", lambda g: D.risk_tab(D.indicators(told(g)), P.latest_screens(told(g), False).where("predicate = 'financial_screen'").select("id", F.lit("financial").alias("dimension"), F.col("value").alias("severity"))),
    "select id, 'financial' signal, v severity, true scored from late where p = 'financial_screen' union all " + " union all ".join(
        f"select id, '{f}', (['clear', 'low', 'medium', 'high'])[{f} + 1], false from ind9" + (" where id not in (select id from late where p = 'financial_screen')" if f in D.REPLACED else "") for f in D.FAMILIES), _ALL)
