"""What is drawn around a node, and its SQL: each level of the walk is a table of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import focus as C
from .registry import ROOT, SUPPLIER, add

_TYPES = {"SUPPLIES": "supplies", "OWNS": "owns", "HELD_ROLE": "role"}
_ALL = "all_e as materialized (" + " union all ".join(f"""select id, src, dst, '{t}' "type" from {n}""" for t, n in _TYPES.items()) + """
  union all select 'rel_' || substr(sha1("type" || '|' || src || '|loc_' || code), 1, 12), src, 'loc_' || code, "type" from place
  union all select 'rel_' || substr(sha1('PROVIDES|' || src || '|' || dst), 1, 12), src, dst, 'PROVIDES' from provides
  union all select 'rel_' || substr(sha1('SUBCATEGORY_OF|' || id || '|' || parent), 1, 12), id, parent, 'SUBCATEGORY_OF' from category where parent is not null
  union all select 'rel_' || substr(sha1('ABOUT|' || src || '|' || dst), 1, 12), src, dst, 'ABOUT' from about)"""
_hot = f"hot as (select id from entity where risk_score > {C.PIN_FLOOR} union select id from person where flagged)"
_tie = """select id, src, dst from all_e where "type" in ('SUPPLIES', 'OWNS', 'HELD_ROLE')"""


def _levels(name: str, edges: str, root: str, depth: int) -> str:
    """name (id, hops, parent, rel): level by level, each node where it is first met, from its least neighbour of the level before."""
    out = [f"{name}0 as (select '{root}' id, 0 hops, null::varchar parent, null::varchar rel)"]
    for k in range(1, depth + 1):
        out.append(f"""{name}{k} as materialized (select dst id, {k} hops, min(src) parent, arg_min(e.id, [src, e.id]) rel from {name}{k - 1} w join ({edges}) e on e.src = w.id
  where not exists (from {name}_to{k - 1} s where s.id = e.dst) group by dst)""")
        out.append(f"{name}_to{k} as materialized (" + " union all ".join(f"from {name}{j}" for j in range(k + 1)) + ")")
        if k == 1:
            out.insert(1, f"{name}_to0 as (from {name}0)")
    return ",\n".join(out)


def _sql(root: str, depth: int, program: bool, people: bool, limit: int) -> str:
    either = f"{_tie} union all select id, dst, src from ({_tie})"
    if program:
        other = f"select id from entity where kind = 'program' and id <> '{root}'"
        walk = f"""select * from (select id, src, dst from all_e where "type" in ('SUPPLIES', 'HELD_ROLE') union all select id, dst, src from ({_tie})) where dst not in ({other})"""
        free = f"select * from ({either}) where dst not in ({other})"
    else:
        walk, free = either, ""
    ctes = [_ALL, _hot, _levels("w", walk, root, depth), f"base as materialized (select id, hops from w_to{depth} order by hops, id limit {limit})"]
    ctes.append("base_e as (select * from all_e where src in (select id from base) and dst in (select id from base))")
    if program:
        ctes.append(_levels("f", free, root, 6))
        ctes.append("back as (select id, parent, rel from f_to6 where id in (from hot) and id not in (select id from base) union select f.id, f.parent, f.rel from back b join f_to6 f on f.id = b.parent)")
        ctes.append("n as (from base union all select distinct id, null from back where id not in (select id from base)), e as (from base_e union select * from all_e where id in (select rel from back where rel is not null))")
    else:
        ctes.append("n as (from base), e as (from base_e)")
    if people:
        ctes.append("kept as (from n), kept_e as (from e)")
    else:
        ctes.append(f"""kn as (from n where id not in (select id from person where id not in (from hot)) or id = '{root}'), kept_e as (from e where src in (select id from kn) and dst in (select id from kn)),
kept as (from kn where id = '{root}' or id in (select src from kept_e) or id in (select dst from kept_e))""")
    return ",\n".join(ctes)


_NODES, _EDGES = "select id, hops from kept", 'select distinct id, src, dst, "type" from kept_e'
for _name, _root, _depth, _program, _people, _limit in (("program", ROOT, 1, True, False, 400), ("program_wide", ROOT, 2, True, True, 5000), ("supplier", SUPPLIER, 2, False, False, 400), ("supplier_people", SUPPLIER, 1, False, True, 60)):
    _call = lambda g, r=_root, d=_depth, p=_program, w=_people, n=_limit: C.focus(g, r, d, ("people",) if w else (), r if p else None, n)
    add(f"focus_{_name}_nodes", lambda g, f=_call: f(g)[0].select("id", F.col("hops").cast("int").alias("hops")), _NODES, _sql(_root, _depth, _program, _people, _limit))
    add(f"focus_{_name}_edges", lambda g, f=_call: f(g)[1].select("id", "src", "dst", "type"), _EDGES, _sql(_root, _depth, _program, _people, _limit))
