"""The queries of the risk score, and their SQL in the terms of the graph's common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import CLASS_SEVERITY, CLASSES, CONFLICT, HAZARD, OPAQUE, WEIGHTS, flat
from . import profiles as P
from . import risk as R
from . import templates as T
from ..model import GRAPH_SQL
from .registry import ORACLES, ROOT, add, tops

_rank = {"clear": 0, "low": 1, "medium": 2, "high": 3}
_cls, _con, _haz = flat(CLASSES), flat(CONFLICT), flat(HAZARD)
_n = lambda v: "null" if v is None else str(v)
_q = lambda v: "null" if v is None else f"'{v}'"
_places = ", ".join(
    f"('{c}', {_n(_rank.get(CLASS_SEVERITY.get(_cls.get(c))))}, {str(c in OPAQUE).lower()}, {_q(_con.get(c))}, {_q(_haz.get(c))})" for c in sorted({*_cls, *_con, *_haz})
)
_c = lambda d: '"' + d + '"'  # noqa: E731  (one is a key word)
_sev = lambda c: f"(['clear', 'low', 'medium', 'high'])[{c} + 1]"

SCREENS = f"""nodes as (select id, 'Entity' label, coalesce(flagged, false) flagged from entity union all select id, 'Person', coalesce(flagged, false) from person),
latest as (select subject_id id, predicate, source, object_value v, retrieved_at, claim.id cid from claim where ends_with(predicate, '_screen') and status = 'committed'
  qualify row_number() over (partition by subject_id, predicate, source order by retrieved_at desc nulls first, claim.id) = 1),
latest1 as (select subject_id id, predicate, object_value v from claim where ends_with(predicate, '_screen') and status = 'committed'
  qualify row_number() over (partition by subject_id, predicate order by retrieved_at desc nulls first, claim.id) = 1),
g_designation as (select n.id, case when bool_or(v = 'hit') or any_value(n.flagged) then 3 when count(v) > 0 then 0 end r
  from nodes n left join latest l on l.id = n.id and predicate in {P.DESIGNATING} group by n.id),
g_media as (select id, case v when 'clear' then 0 when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 1 end r from latest1 where predicate = 'adverse_media_screen'),
d(code, cls, opaque, conflict, hazard) as (values {_places})"""
FOREIGN = f"""home as (select src id, code from place where type = 'INCORPORATED_IN'),
seats as (select id, code from home union select src, code from place where type = 'PARENT_SEATED_IN' union select p.id, (select min(code) from home h where h.id = p.parent_id) from parents p),
g_foreign as (select id, case when bool_or(opaque) then greatest(max(cls), 2) else max(cls) end r from (
  select id, code from seats union select src, code from place where type in ('MANUFACTURES_IN', 'OPERATES_IN')) join d using (code) where cls is not null group by id),
g_person as (select p id, max(cls) r from (select src p, dst id, bool_or(current) over (partition by src) anynow, current from role) join seats using (id) join d using (code)
  where cls is not null and (current or not anynow) group by p),
g_regional as (select src id, max(greatest(case conflict when 'high' then case when made then 3 else 2 end when 'medium' then 1 end,
    case hazard when 'low' then case when conflict is null then 0 end when 'high' then case when made then 2 else 1 end when 'medium' then 1 end)) r
  from (select src, code, type = 'MANUFACTURES_IN' made from place where type in ('MANUFACTURES_IN', 'OPERATES_IN')) join d using (code) group by src)"""
_gone = " or ".join(f"contains(lower(coalesce(entity_status, '')), '{w}')" for w in R.DEFUNCT)
FINANCIAL = f"""docs as (select dst id, bool_or(form in {R.LATE_FORMS}) late, max(case when kind = 'filing' then published_at::date end) filed
  from about join artifact a on a.id = about.src where kind in ('award', 'filing') group by dst),
g_financial as (select e.id, coalesce(greatest(
    case when lower(trim(coalesce(registration_status, ''))) not in ('', 'active', 'registered') then 2 end,
    case when registration_expires::date < date '{R.TODAY}' then 3 when registration_expires::date - date '{R.TODAY}' < {R.WARN_DAYS} then 1 end,
    case when {_gone} then 3 end, case when late then 2 end,
    case when public and date '{R.TODAY}' - filed > {R.STALE_DAYS} then 2 end,
    case when price_change_12m <= -50 then 3 when price_change_12m <= -25 then 2 end,
    case v when 'low' then 1 when 'medium' then 2 when 'high' then 3 end),
    case when v = 'clear' or (public and filed is not null) or lower(trim(coalesce(registration_status, ''))) in ('active', 'registered') then 0 end) r
  from entity e left join docs using (id) left join (select id, v from latest1 where predicate = 'financial_screen') using (id))"""
NEAR = f"""seeds as (select id from nodes where flagged union select subject_id from claim where predicate in {P.DESIGNATING} and object_value = 'hit' and status = 'committed'),
ctl2 as (select src, dst from owns union select dst, src from owns union select src, dst from role union select dst, src from role),
down_e as (select src, dst from ctl2 union select src, dst from supplies), any_e as (select src, dst from down_e union select dst, src from supplies),
near1 as (select id as seed, id, 0 hops from seeds union select w.seed, e.dst, w.hops + 1 from near1 w join down_e e on e.src = w.id where w.hops < {R.HOPS}),
near2 as (select id as seed, id, 0 hops from seeds union select w.seed, e.dst, w.hops + 1 from near2 w join any_e e on e.src = w.id where w.hops < {R.HOPS}),
near as (select id, seed, hops, downstream, 4 - hops - (not downstream)::int as r from (
    select id, seed, min(hops) hops, true downstream from near1 where seed <> id group by all union all select id, seed, min(hops), false from near2 where seed <> id group by all)
  where id in (select id from nodes) qualify row_number() over (partition by id order by r desc, downstream desc, hops, seed) = 1),
g_proximity as (select n.id, coalesce(r, 0) r from nodes n left join near using (id))"""
_all = ("designation", "proximity", "foreign", "financial", "regional", "media")
GRADES = "grades as (select n.id, label, " + ", ".join(f"case when label = 'Entity' then {a}.r else {b}.r end {_c(d)}" if b else f"case when label = 'Entity' then {a}.r end {_c(d)}" for d, a, b in (
    ("designation", "g_designation", "g_designation"), ("proximity", "g_proximity", "g_proximity"), ("foreign", "g_foreign", "g_person"), ("financial", "g_financial", ""), ("regional", "g_regional", ""), ("media", "g_media", "g_media"))
) + " from nodes n " + " ".join(f"left join {t} on {t}.id = n.id" for t in ("g_designation", "g_proximity", "g_foreign", "g_person", "g_financial", "g_regional", "g_media")) + ")"


def _composite(dims: tuple[str, ...]) -> str:
    total = " + ".join(f"{R.PARTS[d]} * coalesce({_c(d)}, 0)" for d in dims)
    ceiling = " + ".join(f"case when {_c(d)} = 0 then {R.PARTS[d] // 3} when {_c(d)} is not null then {R.PARTS[d]} else 0 end" for d in dims)
    return f"(case when ({ceiling}) > 0 then round_even(100 * ({total}) / (3 * ({ceiling})), 0)::int end)"


_whole = (*_all, "dependency")
_dep = lambda k: f"""x{k} as (select consumer id, case when x >= 50 then 3 when x >= 25 then 2 when x >= 10 then 1 else 0 end dependency from (
  select consumer, round(least(100.0, greatest(max(score) filter (sole), sum(weight * score) filter (not sole))), 6) x from awards a join p{k} s on s.id = a.id where score is not null group by consumer)),
p{k + 1} as materialized (select g.id, {_composite(_whole)} score from grades g left join x{k} using (id) where label = 'Entity')"""  # noqa: E731
SCORES = f"""awards as (select src id, dst consumer, sole_source sole, case when sole_source then 1.0 when sum(amount) filter (not sole_source) over w > 0 then amount / sum(amount) filter (not sole_source) over w
    else 1.0 / count(*) filter (not sole_source) over w end weight from supplies where src <> dst window w as (partition by dst)),
p0 as materialized (select id, {_composite(_all)} score from grades where label = 'Entity'), """ + ", ".join(_dep(k) for k in range(R.PASSES))
EVERY = ", ".join((tops, SCREENS, FOREIGN, FINANCIAL, NEAR, GRADES.replace("grades as (", "grades as materialized (", 1)))
_person = tuple(d for d in _all if d in ("designation", "proximity", "foreign", "media"))
_sure = lambda dims: f"round_even(100 * ({' + '.join(f'({_c(d)} is not null)::int * {R.PARTS[d]}' for d in dims)}) / {sum(R.PARTS[d] for d in dims)}, 0)::int"
_best = f"greatest({', '.join(f'{R.PARTS[d]} * coalesce({_c(d)}, 0)' for d in _whole)})"
SCORED = f"""scored as (select id, label, score, case when score >= 75 then 'severe' when score >= 50 then 'high' when score >= 25 then 'elevated' when score is not null then 'low' end band, confidence, n_scored,
    case {' '.join(f"when best > 0 and {R.PARTS[d]} * coalesce({_c(d)}, 0) = best then '{d}'" for d in _whole)} end top_factor, {', '.join(f'{_sev(_c(d))} {_c(d)}' for d in _whole)}
  from (select *, case when label = 'Person' then {_composite(_person)} else {_composite(_whole)} end score, case when label = 'Person' then {_sure(_person)} else {_sure(_whole)} end confidence,
    {' + '.join(f'({_c(d)} is not null)::int' for d in _whole)} n_scored, {_best} best from grades left join x{R.PASSES - 1} using (id)))"""

_graded = lambda f: lambda g: f(g).select("id", F.col("rank").alias("grade"))
add("risk_designation", _graded(R.designation), "select id, r grade from g_designation", SCREENS)
add("risk_media", _graded(R.media), "select id, r grade from g_media", SCREENS)
add("risk_foreign", _graded(R.foreign), "select id, r grade from g_foreign", ", ".join((tops, SCREENS, FOREIGN)))
add("risk_person_foreign", _graded(R.person_foreign), "select id, r grade from g_person", ", ".join((tops, SCREENS, FOREIGN)))
add("risk_regional", _graded(R.regional), "select id, r grade from g_regional", ", ".join((tops, SCREENS, FOREIGN)))
add("risk_financial", _graded(R.financial), "select id, r grade from g_financial", ", ".join((SCREENS, FINANCIAL)))
add("risk_proximity", lambda g: R.proximity(g).select("id", "seed", "hops", "downstream", F.col("rank").alias("grade")), "select id, seed, hops, downstream, r grade from near", ", ".join((SCREENS, NEAR)))
add("risk_scores", R.risk_scores, "from scored", ", ".join((EVERY, SCORES, SCORED)))
add("risk_explain", lambda g: R.risk_explain(g, R.risk_scores(g).where(F.col("id").isin(ROOT, "ent_s4", "per_u4"))),
    " union all ".join(f"select id, '{d}' dimension, {_c(d)} severity, {WEIGHTS[d]}::double weight from scored where id in ('{ROOT}', 'ent_s4', 'per_u4')" + ("" if d in _person else " and label = 'Entity'") for d in _whole), ", ".join((EVERY, SCORES, SCORED)))
add("risk_rescored", lambda g: R.rescored(g, g.entity.where("kind = 'organization' and risk_score is null").select("id"), R.risk_scores(g)).select("id", "risk_score", "risk_band", "risk_confidence"),
    """select e.id, case when e.kind = 'organization' and e.risk_score is null then s.score else e.risk_score end risk_score, case when e.kind = 'organization' and e.risk_score is null then s.band else e.risk_band end risk_band,
    case when e.kind = 'organization' and e.risk_score is null then s.confidence else e.risk_confidence end risk_confidence from entity e left join scored s using (id)""", ", ".join((EVERY, SCORES, SCORED)))  # fmt: skip

# chains to designated parties, and rescoring of some nodes while all others keep what they have stored
from .registry import tiers  # noqa: E402

_asked = lambda g: T._suppliers(g, ROOT, 2).select("id").unionByName(T._one(g, ROOT))
_asked_sql = tiers(2) + f", asked as (select id from tiers union select '{ROOT}')"
_ways = """ctl3 as (select id, src, dst from owns union all select id, src, dst from role), ctl4 as (select * from ctl3 union all select id, dst, src from ctl3),
way_{0} as materialized (select src, dst, min(id) rel from ({1}) group by src, dst),
w0_{0} as (select id asked, id, [id] nodes, []::varchar[] rels from asked),
w1_{0} as materialized (select asked, dst id, min(list_prepend(dst, nodes)) nodes, arg_min(list_prepend(rel, rels), list_prepend(dst, nodes)) rels from w0_{0} w join way_{0} e on e.src = w.id where dst <> asked group by all),
w2_{0} as materialized (select asked, dst id, min(list_prepend(dst, nodes)) nodes, arg_min(list_prepend(rel, rels), list_prepend(dst, nodes)) rels from w1_{0} w join way_{0} e on e.src = w.id where dst <> asked and not exists (from w1_{0} x where x.asked = w.asked and x.id = e.dst) group by all),
w3_{0} as materialized (select asked, dst id, min(list_prepend(dst, nodes)) nodes, arg_min(list_prepend(rel, rels), list_prepend(dst, nodes)) rels from w2_{0} w join way_{0} e on e.src = w.id join seeds on seeds.id = dst where dst <> asked
  and not exists (from w1_{0} x where x.asked = w.asked and x.id = e.dst) and not exists (from w2_{0} x where x.asked = w.asked and x.id = e.dst) group by all),
met_{0} as (select *, count(*) over (partition by asked) reachable from (from w1_{0} union all from w2_{0} union all from w3_{0}) join seeds using (id) qualify row_number() over (partition by asked order by len(rels), id) = 1)"""
_down, _any = _ways.format("d", "from ctl4 union all select id, dst, src from supplies"), _ways.format("a", "from ctl4 union all select id, dst, src from supplies union all select id, src, dst from supplies").split("\n", 1)[1]
add("risk_near_chains", lambda g: R.proximity_of(g, _asked(g)).select("id", "seed", "hops", "downstream", F.col("rank").alias("grade"), "reachable", F.array_join("node_ids", ">").alias("chain"), F.array_join("rel_ids", ",").alias("rels")),
    """select asked id, id seed, len(rels)::int hops, downstream, 4 - len(rels)::int - (not downstream)::int grade, reachable, array_to_string(nodes, '>') as chain, array_to_string(rels, ',') rels
      from (select *, true downstream from met_d union all select *, false from met_a) where asked in (select id from nodes)
      qualify row_number() over (partition by asked order by 4 - len(rels)::int - (not downstream)::int desc, downstream desc) = 1""", ", ".join((SCREENS, NEAR, _asked_sql, _down, _any)))  # fmt: skip
_changed = lambda g: g.entity.where("kind = 'program' or (risk_score is null and startswith(id, 'ent_s'))").select("id").unionByName(g.person.where("flagged").select("id"))
_redo = lambda k: f"""rx{k} as materialized (select consumer id, case when x >= 50 then 3 when x >= 25 then 2 when x >= 10 then 1 else 0 end dependency from (
  select consumer, round(least(100.0, greatest(max(score) filter (sole), sum(weight * score) filter (not sole))), 6) x from awards a join r{k} s on s.id = a.id where score is not null and consumer in (from changed) group by consumer)),
r{k + 1} as materialized (select g.id, {_composite(_whole)} score from grades g left join rx{k} using (id) where label = 'Entity' and g.id in (from changed) union all from kept_)"""  # noqa: E731
_RESCORE = f"""changed as (select id from entity where kind = 'program' or (risk_score is null and starts_with(id, 'ent_s')) union all select id from person where flagged),
kept_ as (select id, risk_score score from entity where risk_score is not null and id not in (from changed)),
r0 as materialized (select id, {_composite(_all)} score from grades where label = 'Entity' and id in (from changed) union all from kept_), """ + ", ".join(map(_redo, range(R.PASSES)))
add("risk_rescore", lambda g: R.rescore(g, _changed(g)), "from rescored", ", ".join((EVERY, SCORES.split(", p0 as")[0].split("p0 as")[0].rstrip().rstrip(","), _RESCORE, SCORED.replace("scored as (", "rescored as (", 1).replace(f"left join x{R.PASSES - 1} using (id)", f"left join rx{R.PASSES - 1} using (id) where id in (from changed)"))))
add("risk_rescored_stored", lambda g: R.rescored(g, _changed(g), R.rescore(g, _changed(g))).select("id", "risk_score", "risk_band", "risk_confidence"),
    """select e.id, case when c.id is null then e.risk_score else s.score end risk_score, case when c.id is null then e.risk_band else s.band end risk_band, case when c.id is null then e.risk_confidence else s.confidence end risk_confidence
      from entity e left join changed c using (id) left join rescored s using (id)""", ORACLES["risk_rescore"].split("with recursive " + GRAPH_SQL + ", ", 1)[1].rsplit("\n", 1)[0])  # fmt: skip

# why: the suppliers that carry a consumer's exposure, and every dimension in words
from . import explain as X  # noqa: E402

add("risk_drivers", lambda g: X.drivers(R.weights(g), g.entity.select("id", F.col("risk_score").alias("score"))).select("consumer", "rank", "id", "sole", F.round(100 * F.col("weight"), 0).cast("int").alias("percent"), "score"),
    f"""select consumer, row_number() over (partition by consumer order by part desc, id, edge_id) as rank, id, sole, round(100 * weight, 0)::int percent, score
      from (select a.*, risk_score score, round(weight * risk_score, 3) part, s.id edge_id from awards a join supplies s on s.src = a.id and s.dst = a.consumer join entity e on e.id = a.id where risk_score is not null) qualify rank <= {X.TOP}""",
    SCORES.split(", p0 as")[0].split("p0 as")[0].rstrip().rstrip(","))
add("risk_explained", lambda g: X.explained(g, _asked(g).unionByName(g.person.where("flagged").select("id"))).withColumn("element_ids", F.array_join("element_ids", ",")))
