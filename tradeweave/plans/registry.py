"""Queries over the projected graph, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GRAPH_SQL, Graph, landed
from . import templates as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROOT, SUPPLIER, BOARD_DATE = "ent_c0", "ent_s4", "2024-01-15"


def add(name: str, build: Callable[[Graph], DataFrame], sql: str | None = None, more: str = "") -> None:
    """sql may use the graph's tables and the common table expressions of more."""
    QUERIES[name] = lambda spark, sf_dir: build(landed(spark, sf_dir))
    if sql:
        ORACLES[name] = f"with recursive {GRAPH_SQL}{', ' + more if more else ''}\n{sql}"


def reach_sql(name: str, start: str, edges: str, depth: int) -> str:
    """Common table expressions: name (id, hops) of what is reached from the ids that start selects. edges: src, dst."""
    return f"""{name}_e as (select distinct src, dst from ({edges})),
{name}_w as (select id, 0 hops from ({start}) union select e.dst, w.hops + 1 from {name}_w w join {name}_e e on e.src = w.id where w.hops < {depth}),
{name} as (select id, min(hops) hops from {name}_w group by id)"""


up = "select dst src, src dst from supplies"


def tiers(depth: int, root: str = ROOT) -> str:
    return reach_sql("t", f"select '{root}' id", up, depth) + ", tiers as (select id, hops tier from t where hops > 0)"


add("vendors_of", lambda g: T.vendors_of(g, ROOT, 3), "select id, name, tier from tiers join entity using (id)", tiers(3))
add("vendors_of_paths", lambda g: T.vendors_of_paths(g, ROOT, 3), """select w.id, e.name, len(rels) tier, array_to_string(nodes, '>') as path from w join entity e using (id) where len(rels) > 0""",
    f"""w as (select '{ROOT}' id, ['{ROOT}'] nodes, []::varchar[] rels union all
      select s.src, list_append(nodes, s.src), list_append(rels, s.id) from w join supplies s on s.dst = w.id where len(rels) < 3 and not list_contains(rels, s.id))""")  # fmt: skip
add("color_by_category", lambda g: T.color_by_category(g, ROOT, 2), """select id, case when bool_or(kind = 'goods') and bool_or(kind = 'services') then 'both' when bool_or(kind = 'goods') then 'goods'
    when bool_or(kind = 'services') then 'services' else 'unknown' end bucket from tiers left join (select src id, coalesce(t.kind, c.kind) kind from provides p join category c on c.id = p.dst left join category t on t.id = c.parent) using (id) group by id""", tiers(2))  # fmt: skip
add("manufactures_in", lambda g: T.manufactures_in(g, ROOT, "CN", 1, 6), """select id, name, tier, string_agg(distinct code, ',' order by code) codes from tiers join entity using (id)
    join (select src id, code from place where type = 'MANUFACTURES_IN' and code = 'CN') using (id) group by all""", tiers(6))  # fmt: skip
chain = """up_w as (select 'ent_s37' id, 0 hops, 'ent_s37' path union all select o.src, hops + 1, path || '>' || o.src from up_w join owns o on o.dst = up_w.id where hops < 6),
down_w as (select 'ent_s1' id, 0 hops, 'ent_s1' path union all select o.dst, hops + 1, path || '>' || o.dst from down_w join owns o on o.src = down_w.id where hops < 6),
seat as (select src id, min(code) country from place where type = 'INCORPORATED_IN' group by src)"""
add("ownership_chain_up", lambda g: T.ownership_chain(g, "ent_s37").where("direction = 'up'"), "select id, name, 'up' direction, hops, path, country from up_w join entity using (id) left join seat using (id) where hops > 0", chain)
add("ownership_chain_down", lambda g: T.ownership_chain(g, "ent_s1").where("direction = 'down'"), "select id, name, 'down' direction, hops, path, country from down_w join entity using (id) left join seat using (id) where hops > 0", chain)
add("shared_directors", lambda g: T.shared_directors(g, ROOT, 3), """select distinct p.id person_id, p.name person, a.dst a_id, b.dst b_id from role a join role b on a.src = b.src and a.dst < b.dst join person p on p.id = a.src join entity x on x.id = a.dst join entity y on y.id = b.dst
    where a.dst in (from m) and b.dst in (from m) and (x.lei is null or y.lei is null or x.lei <> y.lei)""", tiers(3) + f", m as (select id from tiers union select '{ROOT}')")  # fmt: skip
add("sole_source", lambda g: T.sole_source(g, ROOT, 3), f"""select s.src id, e.name, min(b.tier) + 1 tier from supplies s join (select id, tier from tiers where tier < 3 union all select '{ROOT}', 0) b on b.id = s.dst
    join entity e on e.id = s.src where s.sole_source group by all""", tiers(3))  # fmt: skip
tops = """uw as (select id start, id, 0 hops from entity union select start, o.src, hops + 1 from uw join owns o on o.dst = uw.id where hops < 6),
parents as (select start id, uw.id parent_id, e.name parent, hops, row_number() over (partition by start order by hops, e.name, uw.id) as rank
  from (select start, id, min(hops) hops from uw group by all) uw join entity e on e.id = uw.id where hops > 0 and uw.id not in (select dst from owns))"""
add("ultimate_parents", T.ultimate_parents, "from parents", tops)
add("foreign_parent", lambda g: T.foreign_parent(g, ROOT), """select id, name, tier, seat, parent_id from tiers join (select src id, min(code) seat from place where type = 'PARENT_SEATED_IN' and not starts_with(code, 'US') group by src) using (id)
    join entity using (id) left join (select id, parent_id from parents where rank = 1 and hops <= 4) using (id)""", tiers(3) + ", " + tops)  # fmt: skip
ranked = "(risk_score is null), risk_score desc, risk_confidence desc nulls first, name nulls last, id"
add("risk_ranked", lambda g: T.risk_ranked(g, ROOT, None, 100), f"select * from (select row_number() over (order by {ranked}) as rank, id, name, tier, risk_score, risk_band, risk_confidence from tiers join entity using (id)) where rank <= 100", tiers(6))
add("risk_ranked_band", lambda g: T.risk_ranked(g, ROOT, "elevated", 50), f"select * from (select row_number() over (order by {ranked}) as rank, id, name, tier, risk_score, risk_band, risk_confidence from tiers join entity using (id) where risk_band = 'elevated') where rank <= 50", tiers(6))
near = """flagged as (select id from entity where flagged union all select id from person where flagged),
ctl as (select id, src, dst from owns union all select id, src, dst from role union all select id, src, dst from supplies), both_ as (select id, src, dst from ctl union all select id, dst, src from ctl),
nd1 as (select f.id seed, b.dst id, 1 hops, min([f.id, b.dst]) nodes from flagged f join both_ b on b.src = f.id where b.dst <> f.id group by all),
nd2 as (select n.seed, b.dst id, 2 hops, min(list_append(n.nodes, b.dst)) nodes from nd1 n join both_ b on b.src = n.id where b.dst <> n.seed and not exists (from nd1 x where x.seed = n.seed and x.id = b.dst) group by all)"""
add("near_designated", lambda g: T.near_designated(g, 2), "select seed, id, hops, array_to_string(nodes, '>') as path from (from nd1 union all from nd2)", near)
add("people_of", lambda g: T.people_of(g, SUPPLIER), f"""select row_number() over (order by current desc nulls first, "from" desc nulls first, p.name nulls last, title) as rank, src person_id, p.name person, title, "from", "to", current
    from role join person p on p.id = role.src where dst = '{SUPPLIER}'""")  # fmt: skip
add("as_of_board", lambda g: T.as_of_board(g, SUPPLIER, BOARD_DATE), f"""select src person_id, p.name person, title, "from", "to" from role join person p on p.id = role.src where dst = '{SUPPLIER}'
    and ("from" is null or "from" <= '{BOARD_DATE}') and ("to" is null or "to" >= '{BOARD_DATE}')""")  # fmt: skip
hood_e = "select src, dst from he union all select dst, src from he"
hood = "he as (select id, src, dst, 'SUPPLIES' as type from supplies union all select id, src, dst, 'OWNS' from owns), " + reach_sql("hood", f"select '{SUPPLIER}' id", hood_e, 2)
add("neighbourhood_nodes", lambda g: T.neighbourhood(g, SUPPLIER, 2)[0], "select id, hops from hood", hood)
add("neighbourhood_edges", lambda g: T.neighbourhood(g, SUPPLIER, 2)[1].select("id", "src", "dst", "type"), "select id, src, dst, type from he where src in (select id from hood) and dst in (select id from hood)", hood)
prog = "other as (select id from entity where kind = 'program' and id <> '" + ROOT + "'), pe as (select src, dst from supplies union all select dst, src from supplies union all select dst, src from owns), " + reach_sql(
    "inn", f"select '{ROOT}' id", "select * from pe where dst not in (from other)", 1
)
add("neighbourhood_program", lambda g: T.neighbourhood(g, ROOT, 1, program=ROOT, risk_hops=1)[0], """select id, min(hops) hops from (select id, hops from inn union all select unnest([src, dst]), null from (
      select src, dst, row_number() over (partition by src order by dst) k from both_ where src in (from flagged) and dst not in (from other) and dst in (select id from inn) and src <> dst) where k = 1) group by id""",
    prog + ", " + near.split("nd1 as")[0].rstrip().rstrip(","))

from . import profile_queries  # noqa: E402, F401  (it adds its queries)
from . import risk_queries  # noqa: E402, F401
from . import more_queries  # noqa: E402, F401
from . import dossier_queries  # noqa: E402, F401
from . import content_queries  # noqa: E402, F401
from . import focus_queries  # noqa: E402, F401
from . import search_queries  # noqa: E402, F401
from . import subaward_queries  # noqa: E402, F401
from . import linked_queries  # noqa: E402, F401
from . import style_queries  # noqa: E402, F401
from . import staging_queries  # noqa: E402, F401
