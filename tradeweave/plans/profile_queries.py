"""The profile queries and their SQL, in the terms of the graph's common table expressions."""

from __future__ import annotations

from ..functions.dims import CLASS_SEVERITY, CLASSES, OPAQUE
from . import profiles as P
from .registry import SUPPLIER, add, tops

add("graph_stats", lambda g: P.graph_stats(g).where("name not in ('Location', 'INCORPORATED_IN', 'MANUFACTURES_IN', 'OPERATES_IN', 'PARENT_SEATED_IN')"), """
select 'label' what, 'Entity' as name, count(*) n from entity union all select 'label', 'Person', count(*) from person union all select 'label', 'Category', count(*) from category
union all select 'label', 'Artifact', count(*) from artifact union all select 'type', 'SUPPLIES', count(*) from supplies union all select 'type', 'OWNS', count(*) from owns
union all select 'type', 'HELD_ROLE', count(*) from role union all select 'type', 'SUBCATEGORY_OF', count(*) from category where parent is not null union all select 'type', 'PROVIDES', count(*) from provides union all select 'type', 'ABOUT', count(*) from about""")  # fmt: skip
add("node_degree", lambda g: P.degree(g, SUPPLIER), f"""select t as "type", count(*) n from (select 'SUPPLIES' t, src, dst from supplies union all select 'OWNS', src, dst from owns union all select 'HELD_ROLE', src, dst from role
  union all select 'PROVIDES', src, dst from provides union all select 'ABOUT', src, dst from about union all select "type", src, 'loc_' || code from place) where '{SUPPLIER}' in (src, dst) group by t""")  # fmt: skip
add("people_list", P.people_list, """select person.id, name, flagged, count(distinct dst) seats, count(*) filter (current) as current, string_agg(distinct title, ',' order by title) titles from person join role on src = person.id group by all""")
add("entities_list", P.entities_list, """select e.id, e.name, coalesce(buyers, 0) buyers, coalesce(categories, 0) categories, coalesce(any_sole, false) any_sole, min_tier, parent_id from entity e
  left join (select src id, count(distinct dst) buyers, bool_or(sole_source) any_sole, min(tier) min_tier from supplies group by src) using (id)
  left join (select src id, count(distinct dst) categories from provides group by src) using (id) left join (select id, parent_id from parents where rank = 1) using (id)""", tops)  # fmt: skip
_n = lambda t: f"count(*) filter (\"type\" = '{t}')"
add("locations", P.locations, f"select code, {_n('INCORPORATED_IN')} incorporated, {_n('OPERATES_IN')} operates, {_n('MANUFACTURES_IN')} manufactures, {_n('PARENT_SEATED_IN')} parent_seats from place group by code")
_screen = lambda by: f"select id, predicate, source, value, retrieved_at from (select subject_id id, predicate, source, object_value as value, retrieved_at, row_number() over (partition by {by} order by retrieved_at desc nulls first, id) k from claim where status = 'committed') where k = 1"
add("latest_screens_by_source", lambda g: P.latest_screens(g), _screen("subject_id, predicate, source"))
add("latest_screens", lambda g: P.latest_screens(g, False), _screen("subject_id, predicate"))
add("designated", P.designated, f"select id from entity where flagged union select id from person where flagged union select subject_id from claim where predicate in {P.DESIGNATING} and object_value = 'hit' and status = 'committed'")
add("risk_bands", P.risk_bands, "select coalesce(risk_band, 'unscored') band, count(*) n from entity group by 1")
_weights = """pairs as (select src, dst, bool_or(sole_source) sole, sum(amount) amount from supplies group by src, dst),
weights as (select src id, dst consumer, sole, case when sole then 1 when sum(amount) over w > 0 then amount / sum(amount) over w else 1 / count(*) over w end weight from pairs window w as (partition by dst, sole))"""
add("dependence_weights", lambda g: P.dependence_weights(g).selectExpr("id", "consumer", "sole", "round(weight * 1e8) / 1e8 weight"), "select id, consumer, sole, round(weight, 8) weight from weights", _weights)
add("dependency", P.dependency, """select id, round(x, 4) exposure, case when round(x, 6) >= 50 then 'high' when round(x, 6) >= 25 then 'medium' when round(x, 6) >= 10 then 'low' else 'clear' end severity from (
  select consumer id, least(100.0, greatest(coalesce(max(risk_score) filter (sole), 0), coalesce(sum(weight * risk_score) filter (not sole), 0))) x
  from weights join entity using (id) where risk_score is not null group by consumer)""", _weights)  # fmt: skip
_rank = {"clear": 0, "low": 1, "medium": 2, "high": 3}
_dims = ", ".join(f"('{c}', {_rank[CLASS_SEVERITY[k]]}, {str(c in OPAQUE).lower()})" for k, codes in CLASSES.items() for c in codes.split())
add("foreign_severity", P.foreign_severity, f"""select src id, (['clear', 'low', 'medium', 'high'])[case when bool_or(opaque) then greatest(max(r), 2) else max(r) end + 1] severity
  from place join (values {_dims}) d(code, r, opaque) using (code) group by src""")  # fmt: skip
add("supply_position", lambda g: P.supply_position(g, "ent_c1"), """select row_number() over (order by amount desc, id) as rank, id, name, amount, awards from (
  select src id, round(sum(amount), 2) amount, sum(award_count)::bigint awards from supplies where dst = 'ent_c1' group by src) join entity using (id) qualify rank <= 50""")  # fmt: skip
add("interlocks", P.interlocks, "select a.dst id, b.dst other, count(*) people from seat_now a join seat_now b on a.src = b.src and a.dst < b.dst group by all", "seat_now as (select distinct src, dst from role where current)")
add("artifacts_of", P.artifacts_of, """select dst id, src artifact_id, title, published_at, row_number() over (partition by dst order by published_at desc nulls first, src) as rank from about join artifact a on a.id = src qualify rank <= 5""")
_said = lambda c: c.replace({"adverse_media_screen": "SUPPLIES", "financial_screen": "OWNS"}, subset=["predicate"])
add("claims_decided", lambda g: P.decide(_said(g.claim)), """select id, subject_id, predicate, object_value, coalesce(n_sources, 0) n_sources, case when status = 'rejected' or (subject_id = object_id and predicate in ('SUPPLIES', 'OWNS')) then 'rejected' when ends_with(predicate, '_screen') or (trust = 'authoritative' and confidence >= 0.8) or n_sources >= 2
  then 'committed' else 'staged' end decision from said left join (select subject_id, predicate, o, object_value, count(distinct source) n_sources from said where status <> 'rejected' group by all) using (subject_id, predicate, object_value, o)""",
    "said as (select id, subject_id, case predicate when 'adverse_media_screen' then 'SUPPLIES' when 'financial_screen' then 'OWNS' else predicate end predicate, object_value, object_id, coalesce(object_id, '') o, status, source, trust, confidence from claim)")
_words = "string_split(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')), ' ')"
add("search_names", lambda g: P.search(g, "Pérson 12"), f"""select id, name from (select id, name from entity union all select id, name from person)
  where list_bool_or([starts_with(x, 'person') or levenshtein(x, 'person') <= 1 for x in {_words}]) and list_bool_or([starts_with(x, '12') for x in {_words}])""")  # fmt: skip
