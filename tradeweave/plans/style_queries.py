"""Styles of the whole graph after a list of operations, and their SQL, which replays them one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import styles as S
from .registry import ROOT, add

#: (op, scope, style, label, who: SQL over the graph, by name) in their order.
_LIST = (
    ("dim", "all", {}, None, None), ("set", None, {"fill": "red", "badge": "flag"}, "Flagged", "flagged"), ("set", None, {"fill": "blue", "size": "lg"}, None, "programs"), ("dim", None, {}, None, "programs"), ("clear", "edges", {}, None, None), ("hide", "edges", {}, None, None),
    ("highlight", None, {"stroke": "Chartreuse", "dashed": True}, None, "suppliers"), ("set", None, {"fill": "PINK"}, "People", "people"), ("set", None, {"fill": " teal ", "shape": "star"}, None, "flagged"), ("dim", None, {}, None, "people"), ("hide", None, {}, None, "nobody"), ("set", None, {"fill": "green"}, "Edges", "owning"),
)
_WHO = {
    "flagged": "select id from entity where flagged", "programs": "select id from entity where kind = 'program'", "suppliers": f"select distinct src from supplies where dst = '{ROOT}'", "people": "select id from person", "nobody": "select 'nobody' id where false", "owning": "select id from owns",
}


def _ops(g):
    rows = [(k, op, scope, *(style.get(p) for p in S.PROPERTIES), style.get("dashed"), label) for k, (op, scope, style, label, _) in enumerate(_LIST)]
    who = {
        "flagged": g.entity.where("flagged").select("id"), "programs": g.entity.where("kind = 'program'").select("id"), "suppliers": g.edges["SUPPLIES"].where(F.col("dst") == ROOT).select(F.col("src").alias("id")).distinct(), "people": g.person.select("id"),
        "nobody": g.person.where("false").select("id"), "owning": g.edges["OWNS"].select("id"),
    }
    targets = None
    for k, (*_, name) in enumerate(_LIST):
        if name:
            one = who[name].select(F.lit(k).alias("seq"), "id")
            targets = one if targets is None else targets.unionByName(one)
    return g.spark.createDataFrame(rows, S.OPS), targets


def _state(g):
    elements = g.entity.select("id", F.lit("nodes").alias("kind")).unionByName(g.person.select("id", F.lit("nodes").alias("kind"))).unionByName(g.edge("SUPPLIES", "OWNS").select("id", F.lit("edges").alias("kind")))
    return S.style_state(elements, *_ops(g))


_swatch = lambda v: None if not v or not v.strip() else v.strip().lower() if v.strip().lower() in S.PALETTE else "neutral"
_lit = lambda v: "null" if v is None else f"'{v}'"


def _replay() -> str:
    """Tables s0, s1, ..: the state after each operation."""
    out = ["s0 as (select id, kind, null::varchar fill, null::varchar stroke, null::varchar badge, null::varchar size, null::varchar shape, false dashed, false highlight, false dim, false hide from (select id, 'nodes' kind from entity union all select id, 'nodes' from person union all select id, 'edges' from supplies union all select id, 'edges' from owns))"]
    for k, (op, scope, style, _, who) in enumerate(_LIST):
        at = f"id in ({_WHO[who]})" if who and who != "nobody" else "true" if scope == "all" else f"kind = '{scope}'" if scope else "false"
        if who == "nobody":
            at = "true"  # an operation without any id addresses everything
        if op == "clear":
            new = {p: "null" for p in S.PROPERTIES} | {p: "false" for p in ("dashed", "highlight", "dim", "hide")}
        elif op in ("dim", "hide"):
            new = {op: "true"}
        else:
            new = {p: _lit(_swatch(style[p]) if p in ("fill", "stroke") else style[p]) for p in S.PROPERTIES if style.get(p)} | {"dim": "false"} | ({"dashed": "true"} if style.get("dashed") else {}) | ({"highlight": "true"} if op == "highlight" else {})
        out.append(f"s{k + 1} as materialized (select * replace ({', '.join(f'case when {at} then {v} else {c} end as {c}' for c, v in new.items())}) from s{k})")
    return ",\n".join(out)


add("style_state", _state, f"select id, fill, stroke, badge, size, shape, dashed, highlight, dim, hide from s{len(_LIST)}", _replay())
_painted = [(k, _swatch(style.get("fill") or style.get("stroke")), label or style.get("badge"), who) for k, (op, _, style, label, who) in enumerate(_LIST) if op in ("set", "highlight") and k > max(i for i, x in enumerate(_LIST) if x[0] == "clear")]
add("style_legend", lambda g: S.legend(*_ops(g)), "select row_number() over (order by k) as place, swatch, label, n count from (" + " union all ".join(f"select {k} k, '{s}' swatch, '{label or s.capitalize()}' label, (select count(*) from ({_WHO[who]})) n" for k, s, label, who in _painted) + ")")
add("style_risk_scheme", lambda g: (lambda o, t: t.join(o, "seq").select("seq", "id", F.coalesce("fill", "stroke").alias("swatch"), F.coalesce("dashed", F.lit(False)).alias("dashed"), "label"))(*S.risk_scheme(g)),
    f"""select case risk_band {" ".join(f"when '{b}' then {k}" for k, (b, _, _) in enumerate(S.RAMP))} else 4 end seq, id, case risk_band {" ".join(f"when '{b}' then '{c}'" for b, c, _ in S.RAMP)} else 'neutral' end swatch, risk_band is null dashed,
      case risk_band {" ".join(f"when '{b}' then '{t}'" for b, _, t in S.RAMP)} else '{S.UNSCORED}' end label from (select id, risk_score, risk_band from entity union all select id, null, null from person order by risk_score is null, risk_score desc, id limit {S.PAINTED})""")  # fmt: skip
