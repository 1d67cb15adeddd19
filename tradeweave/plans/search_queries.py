"""Typed searches over the whole index, and their SQL, which compares every name with every word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded
from ..model import GRAPH_SQL
from . import search as S
from .registry import ORACLES, QUERIES

#: What is typed, of which kind, how many are asked for.
ASKED = (("lei 3", "any", 10), ("Suplier 000000004", "any", 10), ("Pérson 1", "person", 12), ("upplie 0001", "any", 20), ("perosn 12", "any", 10), ("customer", "person", 10), ("customer#000000", "entity", 30), ("... !", "any", 10), ("zzz nothing", "any", 10))


def search_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, out = S.landed_index(spark, sf_dir), None
    for q, kind, limit in ASKED:
        one = S.search_entities(index, q, kind, limit).withColumn("query", F.lit(q))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["search_entities"] = search_entities
_parts = []
for _k, (_query, _kind, _limit) in enumerate(ASKED):
    _words = list(dict.fromkeys(folded(_query).split()))
    if not _words:
        continue
    _how = lambda w: f"list_max([case when x = '{w}' then 3 when starts_with(x, '{w}') then 2 {f"when damerau_levenshtein(x, '{w}') <= 1 then 1" if len(w) >= S.FUZZY_FROM else ''} else 0 end for x in words])"
    _ident = "".join(c for c in _query if c.isascii() and c.isalnum()).upper()
    _all = " and ".join(f"{_how(w)} > 0" for w in _words)
    _parts.append(f"""q{_k} as (select *, row_number() over (order by score desc, name nulls last, id) as rank from (
  select id, name, label, step, score, min(stage) over () first, stage from (
    select *, 1 stage, 'identifier' step, 1.0 score from named where lei = '{_ident}'
    union all select *, 2, 'words', round(({" + ".join(map(_how, _words))}) / {3.0 * len(_words)}, 4) from named where {_all}
    union all select *, 3, 'substring', 0.5 from named where {" and ".join(f"contains(lower(name), '{w}')" for w in _words)}))
  where stage = first qualify rank <= case when stage = 1 then {min(S.BY_IDENTIFIER, _limit)} else {_limit} end)""")
_pick = lambda k, q, kind: f"select rank, id, name, label, score::double score, step, '{q}' query from q{k}" + {"any": "", "entity": " where label = 'Entity'", "person": " where label = 'Person'"}[kind]
ORACLES["search_entities"] = f"""with recursive {GRAPH_SQL},
named as (select *, string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' ') words from (select id, name, 'Entity' label, upper(lei) lei from entity union all select id, name, 'Person', null from person)),
{", ".join(_parts)}
{" union all ".join(_pick(k, q, kind) for k, (q, kind, _) in enumerate(ASKED) if folded(q).split())}"""
