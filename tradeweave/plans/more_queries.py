"""Queries of claims, sinks, resolution, layers and reports, and their SQL in the terms of the graph's common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import SUFFIXES
from ..operators import upsert as U
from . import claims as C
from . import layers as L
from . import report_store as K
from . import reports as R
from . import resolve as S
from .registry import ROOT, SUPPLIER, add, reach_sql, up

# claims and sinks
_said = lambda c: c.replace({"adverse_media_screen": "SUPPLIES", "financial_screen": "OWNS", "exclusion_screen": "attr:registration_status"}, subset=["predicate"])
_SAID = """said as (select * replace (case predicate when 'adverse_media_screen' then 'SUPPLIES' when 'financial_screen' then 'OWNS' when 'exclusion_screen' then 'attr:registration_status' else predicate end as predicate),
    retrieved_at || '|' || id seq from claim where status = 'committed'),
rel as (select subject_id src, predicate "type", object_id dst, arg_max(source, seq) source, arg_max(detail, seq) detail, arg_max(confidence, seq) confidence from said
  where predicate in ('SUPPLIES', 'OWNS') and object_id is not null group by all)"""
_old = lambda g: g.edge("OWNS").withColumns({"source": F.lit("registry"), "detail": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
add("claims_commit_edges", lambda g: C.edges_after(_old(g), _said(g.claim)), """select coalesce(o.id, 'rel_' || substr(sha1(src || '|' || "type" || '|' || dst), 1, 12)) id, src, "type", dst, coalesce(r.source, o.source) source, r.detail, r.confidence
  from (select id, src, dst, 'OWNS' "type", 'registry' source from owns) o full join rel r using (src, "type", dst)""", _SAID)  # fmt: skip
add("claims_commit_attributes", lambda g: C.attributes(_said(g.claim)), """select subject_id id, 'registration_status' attribute, arg_max(object_value, seq) as value, arg_max(id, seq) claim_id from said
  where predicate = 'attr:registration_status' group by subject_id""", _SAID)  # fmt: skip
_marks = """marks as (select subject_id id, arg_max(predicate || ': ' || coalesce(detail, 'hit'), retrieved_at || '|' || id) flag_reason, bool_or(predicate = 'sanctions_screen') sanctioned,
    bool_or(predicate = 'exclusion_screen') debarred, bool_or(predicate = 'restricted_list_screen') restricted
  from claim where status = 'committed' and object_value = 'hit' and predicate in ('sanctions_screen', 'exclusion_screen', 'restricted_list_screen') group by subject_id)"""
add("claims_commit_marks", lambda g: C.marks(g.claim), "from marks", _marks)
add("claims_commit_entities", lambda g: C.entities_after(g, g.claim), "select e.id, coalesce(flag_reason is not null or null, e.flagged) flagged, flag_reason from entity e left join marks using (id)", _marks)
add("claims_endpoints", lambda g: C.endpoints(g.claim), "select distinct id claim_id, unnest([subject_id, id] || case when object_id is null then [] else [object_id] end) id from claim")
add("claims_list", lambda g: C.claims_list(g, "staged", None, 50), """select rank, c.id, s.name subject, o.name object, predicate, object_value, status, retrieved_at from (
    select *, row_number() over (order by retrieved_at desc, id) as rank from claim where status = 'staged' qualify rank <= 50) c left join entity s on s.id = subject_id left join entity o on o.id = object_id""")  # fmt: skip
_olds = lambda g: g.entity.where("risk_score is not null").select("id", "name", "risk_score")
_news = lambda g: g.entity.select("id", F.upper("name").alias("name"), F.when(F.col("flagged"), 1).alias("risk_score"))
_ON = "o as (select id, name, risk_score from entity where risk_score is not null), n as (select id, upper(name) as name, case when flagged then 1 end risk_score from entity)"
add("upsert_existing_wins", lambda g: U.keep_existing(_olds(g), _news(g)), "select id, coalesce(o.name, n.name) as name, case when o.id is null then n.risk_score else o.risk_score end risk_score from n left join o using (id)", _ON)
add("upsert_new_wins", lambda g: U.overwrite(_olds(g), _news(g), ["id"]), "select id, n.name, coalesce(n.risk_score, o.risk_score) risk_score from n left join o using (id)", _ON)
add("upsert_change_set", lambda g: U.change_set(_olds(g), _news(g).where("not flagged")), """select case when o.id is null then 'created' when n.id is null then 'deleted' when o.name = n.name and o.risk_score is not distinct from n.risk_score then 'same' else 'updated' end change,
  count(*) n from o full join (select n.* from n join entity using (id) where not flagged) n using (id) group by 1""", _ON)  # fmt: skip
add("detach_flagged", lambda g: U.detach(g.entity, g.edge("SUPPLIES", "OWNS"), g.entity.where("flagged"))[1].groupBy("type").agg(F.count("*").alias("n")), """select t as "type", count(*) n from (select 'SUPPLIES' t, src, dst from supplies union all select 'OWNS', src, dst from owns)
  where src not in (select id from entity where flagged) and dst not in (select id from entity where flagged) group by t""")  # fmt: skip

# resolution
_norm = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9_ ]', ' ', 'g'), '\\b({'|'.join(SUFFIXES)})\\b', ' ', 'g'), ' +', ' ', 'g'))"


def _asked(g):
    k = F.substring("id", 6, 20).cast("long")
    mine = g.entity.where("startswith(id, 'ent_s')")
    name = F.when(k % 4 == 1, F.concat(F.upper("name"), F.lit(" Holdings, Inc."))).when(k % 4 == 2, F.lit("Nobody & Co")).otherwise(F.col("name"))
    return mine.select(F.concat(F.lit("q"), k).alias("key"), F.when(k % 4 == 0, F.lower("lei")).alias("lei"), name.alias("name"))


add("resolve_exact", lambda g: S.find_entity(g.entity, _asked(g), fuzzy=False).select("key", "id", "method", "confidence"), f"""select key, id, method, case method when 'lei' then 1.0 else 0.9 end::double confidence from (
    select key, min(e.id) id, 'lei' as method, 0 step from asked join entity e on e.lei = upper(asked.lei) group by key
    union all select key, min(e.id), 'name_exact', 1 from asked join entity e on {_norm('e.name')} = {_norm('asked.name')} group by key) qualify row_number() over (partition by key order by step) = 1""",
    """asked as (select 'q' || k as key, case when k % 4 = 0 then lower(lei) end lei, case k % 4 when 1 then upper(name) || ' Holdings, Inc.' when 2 then 'Nobody & Co' else name end as name
      from (select *, substr(id, 6)::int k from entity where starts_with(id, 'ent_s')))""")  # fmt: skip

# layers
_kinds = f"""all_e as (select src, dst, 'SUPPLIES' t from supplies union all select src, dst, 'OWNS' from owns union all select src, dst, 'HELD_ROLE' from role union all select src, dst, 'PROVIDES' from provides
  union all select id, parent, 'SUBCATEGORY_OF' from category where parent is not null union all select src, dst, 'ABOUT' from about union all select src, 'loc_' || code, 'PLACE' from place),
lay as (select id, 'Entity' label, kind, risk_score, null layer from entity union all select id, 'Person', 'person', null, 'people' from person union all select id, 'Category', kind, null, 'categories' from category
  union all select distinct 'loc_' || code, 'Location', 'country', null, 'countries' from place union all select id, 'Artifact', kind, null, case when kind in {L.SOURCE_KINDS} then 'sources' else 'artifacts' end from artifact),
h0 as (select id from lay where layer is not null), drawn as (select * from lay where id not in (from h0)),
pin_w as (select distinct src id from supplies where src in (select id from drawn where label = 'Entity') union
  select e.dst from pin_w w join (select src, dst from all_e union select dst, src from all_e) e on e.src = w.id where e.dst in (select id from drawn where label = 'Entity')),
pins as (select id from drawn where label = 'Entity' and kind <> 'program' and coalesce(risk_score, 0) > {L.PIN_FLOOR} and id in (from pin_w)),
chain_e as (select dst src, src dst from supplies union select src, dst from supplies union select dst, src from owns),
chain_w as (select id from drawn where kind = 'program' union select e.dst from chain_w w join chain_e e on e.src = w.id where e.dst in (select id from drawn where label = 'Entity')),
ind as (select id from drawn where label = 'Entity' and kind <> 'program' and id not in (from chain_w) and exists (from drawn where kind = 'program')),
h1 as (select id from h0 union select id from ind),
nb as (select src id, dst o from all_e where src <> dst union select dst, src from all_e where src <> dst),
orph as (select l.id from lay l join nb using (id) where label = 'Entity' and kind <> 'program' and l.id not in (from h1) and o in (select id from lay) group by l.id having bool_and(o in (from h1)))"""
add("layers_pinned", lambda g: L.pinned(g.nodes, g.all_edges, L.off(g.nodes, ())), "from pins", _kinds)
add("layers_indirect", lambda g: L.indirect(g.nodes, g.all_edges, L.off(g.nodes, ())), "from ind", _kinds)
add("layers_hidden", lambda g: L.hidden_nodes(g).where("not startswith(id, 'loc_')"), "select id from (select id from h1 union select id from orph) where id not in (from pins) and not starts_with(id, 'loc_')", _kinds)

# reports and pages
_near = reach_sql("sup", f"select '{ROOT}' id", up, R.DEPTH)
_path = f"""pth as (select '{ROOT}' id, 0 hops, ['{ROOT}'] nodes, []::varchar[] rels union all select * from (
    select s.src, p.hops + 1, list_append(p.nodes, s.src) nn, list_append(p.rels, s.id) rr from pth p join supplies s on s.dst = p.id join sup on sup.id = s.src and sup.hops = p.hops + 1
    qualify row_number() over (partition by s.src order by nn, rr) = 1))"""
add("supply_findings", lambda g: R.supply_findings(g, ROOT), f"""select row_number() over (order by coalesce(risk_score, 0) desc, hops, k.name, k.id) as rank, k.id, k.name, risk_score score, flagged, hops tier, array_to_string(nodes, '>') as path,
    (select bool_or(sole_source) from supplies where list_contains(rels, supplies.id)) sole_source,
    (select string_agg(contract_ref, ',' order by list_position(rels, supplies.id)) from supplies where list_contains(rels, supplies.id)) contracts,
    (select count(distinct dst) from provides where src = k.id) categories
  from (select e.* from entity e join sup using (id) where hops > 0 and (coalesce(risk_score, -1) >= {R.FLOOR} or flagged) order by coalesce(risk_score, 0) desc, e.name, e.id limit {R.FINDINGS}) k join pth using (id)""", f"{_near}, {_path}")  # fmt: skip
add("report_citations", lambda g: K.citations(K.assembled(g, ROOT, "2025-03-01T00:00:00Z")), f"""select 'rep_' || substr(sha1('{K.KIND}|{ROOT}'), 1, 12) src, 'REPORTS_ON' "type", '{ROOT}' dst union
  select 'rep_' || substr(sha1('{K.KIND}|{ROOT}'), 1, 12), 'CITES', id from (select unnest(nodes) id from (select id from entity e join sup using (id) where hops > 0 and (coalesce(risk_score, -1) >= {R.FLOOR} or flagged) order by coalesce(risk_score, 0) desc, e.name, e.id limit {R.FINDINGS}) join pth using (id)
    union select id from (select e.id, row_number() over (order by tier, e.name, c.name, contract_ref) as rank from sup join entity e using (id) join supplies s on s.src = e.id and sole_source join entity c on c.id = s.dst where hops > 0 and e.risk_score is null qualify rank <= {R.GAPS})) where id <> '{ROOT}'""", f"{_near}, {_path}")  # fmt: skip
add("report_coverage", lambda g: R.coverage(g, ROOT), f"""select count(*) suppliers, count(risk_score) scored, count(*) - count(risk_score) unscored, count(*) filter (risk_score is not null and coalesce(risk_confidence, 0) < {R.THIN}) thin,
  count(*) filter (flagged) flagged from sup join entity using (id) where hops > 0""", _near)  # fmt: skip
add("unscreened_sole_sources", lambda g: R.unscreened_sole_sources(g, ROOT), f"""select row_number() over (order by tier, e.name, c.name, contract_ref) as rank, e.id, e.name, c.name consumer, contract_ref, tier from sup join entity e using (id)
  join supplies s on s.src = e.id and sole_source join entity c on c.id = s.dst where hops > 0 and e.risk_score is null qualify rank <= {R.GAPS}""", _near)  # fmt: skip
_page = "select rank, id, name, kind, risk_score, tier, total from (select *, row_number() over (order by {}) as rank, count(*) over () total from entity left join (select src id, min(tier) tier from supplies group by src) using (id) where {}) where rank > {} and rank <= {}"
add("entities_page", lambda g: R.entities_page(g, q="SUPPLIER#0", kind="organization", flagged=False, limit=20, offset=10), _page.format("tier nulls last, name, id", "contains(lower(name), 'supplier#0') and kind = 'organization' and not flagged", 10, 30))
add("entities_page_by_risk", lambda g: R.entities_page(g, sort="risk", limit=30), _page.format("risk_score is null, risk_score desc, name, id", "true", 0, 30))
add("whole_graph", lambda g: R.whole_graph(g, ("people", "categories"), 600), """select id, label, name from (select id, 'Entity' label, name, 0 p from entity union all select id, 'Person', name, 2 from person union all select id, 'Category', name, 4 from category)
  order by p, coalesce(name, id), id limit 600""")  # fmt: skip
add("person_page", lambda g: R.person_page(g, "per_u3"), """select dst entity_id, e.name entity, title, "from", "to", current, (select count(distinct o.src) from role o where o.dst = r.dst and o.src <> r.src) colleagues
  from role r join entity e on e.id = dst where src = 'per_u3'""")  # fmt: skip
