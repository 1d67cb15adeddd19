"""The composite risk score: dimensions graded one by one, their evidence-weighted mean, and what flows up the supply chain.

Each dimension is a DataFrame (id, rank): 0 clear to 3 high, null where the dimension has no data. Grades meet by id and are folded
by expressions; nothing is scored row by row in Python. Weights are whole numbers (twelfths, so that a clear grade's third is
whole), so a score is one exact division. Exposure flows along SUPPLIES in PASSES rounds; what is carried from round to round
is a score for each entity, settled in the shared folder.

Nodes without any data have a null score: unscored, not clear. Ties are broken by id. An empty graph gives no rows.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import CLASS_SEVERITY, PERSON_DIMENSIONS, SEVERITIES, WEIGHTS, band_of, placed, rank_of, severity_of
from ..model import CONTROL, Graph
from ..operators import walks as W
from ..operators.rounds import settle
from . import profiles as P
from . import templates as T

#: Rounds of the dependence, hops of the proximity and the grade of each, terms of the financial rules.
PASSES, HOPS, HOP_RANK = 4, 3, {1: 3, 2: 2, 3: 1}
WARN_DAYS, STALE_DAYS = 60, 550
LATE_FORMS = ("NT 10-K", "NT 10-Q", "NT 20-F")
DEFUNCT = ("dissolved", "inactive", "terminated", "struck", "liquidat")
ENTITY_DIMENSIONS = ("designation", "proximity", "foreign", "financial", "regional", "media")
#: Twelfths of a weight.
PARTS = {d: round(12 * w) for d, w in WEIGHTS.items()}
TODAY = datetime.date(2025, 3, 1)


def _of(df: DataFrame, ids: DataFrame | None, column: str = "id") -> DataFrame:
    """The rows of df whose column is among ids (id); all of them where ids is None."""
    return df if ids is None else df.join(ids.select(F.col("id").alias(column)), column, "left_semi").select(*df.columns)


def within(g: Graph, ids: DataFrame | None) -> Graph:
    """The graph with only what single nodes of ids are graded by: themselves, claims and artifacts about them, where they are."""
    if ids is None:
        return g
    at = {t: _of(g.edges[t], ids, "src") for t in ("INCORPORATED_IN", "MANUFACTURES_IN", "OPERATES_IN", "PARENT_SEATED_IN", "HELD_ROLE")}
    return g.with_(entity=_of(g.entity, ids), person=_of(g.person, ids), claim=_of(g.claim, ids, "subject_id"), edges=g.edges | at | {"ABOUT": _of(g.edges["ABOUT"], ids, "dst")})


def _nodes(g: Graph) -> DataFrame:
    return g.entity.select("id", "flagged", F.lit("Entity").alias("label")).unionByName(g.person.select("id", "flagged", F.lit("Person").alias("label")))


def designation(g: Graph) -> DataFrame:
    """High where a latest screen of a designating list is a hit or the node is flagged; clear where such screens ran."""
    ran = P.latest_screens(g).where(F.col("predicate").isin(*P.DESIGNATING)).groupBy("id").agg(F.bool_or(F.col("value") == "hit").alias("hit"))
    rank = F.when(F.col("hit") | F.coalesce("flagged", F.lit(False)), 3).when(F.col("hit").isNotNull(), 0)
    return _nodes(g).join(ran, "id", "left").select("id", rank.alias("rank"))


def proximity(g: Graph) -> DataFrame:
    """id, seed, hops, downstream, rank: the nearest designated party with the flow of supply, or against it one grade softer; the worse
    of the two readings, of equal ones the first. Nodes that none reaches aren't in it: they are clear."""
    seeds = P.designated(g)
    control = W.both_ways(g.edge(*CONTROL)).select("src", "dst")
    supply = g.edges["SUPPLIES"].select("src", "dst")
    with_flow = settle(W.nearest(control.unionByName(supply), seeds, HOPS))
    done = with_flow.where(F.col("hops") < HOPS).select("id")  # against the flow it is at most as bad there
    left = _nodes(g).select("id").join(done, "id", "left_anti")
    any_way = W.nearest_to(control.unionByName(supply).unionByName(W.reverse(supply)), seeds, HOPS, left)
    return _worse(g, with_flow.withColumn("downstream", F.lit(True)).unionByName(any_way.withColumn("downstream", F.lit(False))))


def _worse(g: Graph, readings: DataFrame) -> DataFrame:
    rank = F.lit(None).cast("int")
    for hops, r in HOP_RANK.items():
        rank = F.when(F.col("hops") == hops, r).otherwise(rank)
    both = readings.withColumn("rank", rank - F.when(F.col("downstream"), 0).otherwise(1))
    named = both.join(_nodes(g).select("id"), "id", "left_semi")
    return W.top(named, ["id"], [F.desc("rank"), F.desc("downstream")], 1, "k").drop("k")


def nearest_of(g: Graph, ids: DataFrame) -> DataFrame:
    """proximity() of the nodes ids (id). One sweep of the graph, whose rounds grow with the edges alone: with many ids what can reach some of
    them is nearly all of it, and finding that costs more than the sweep."""
    return _of(proximity(g), ids)


def proximity_of(g: Graph, ids: DataFrame) -> DataFrame:
    """id, seed, hops, downstream, rank, reachable, node_ids, rel_ids: proximity() of the nodes ids (id), with the number of designated parties
    within reach in the chosen reading and the chain from the nearest, the least of the shortest. Walks back from ids alone, side by
    side as bits: no row for each of ids and each node within HOPS of it. nearest_of() does without chains."""
    seeds = settle(P.designated(g))
    control = W.both_ways(g.edge(*CONTROL)).select("id", "src", "dst")
    supply = g.edges["SUPPLIES"].select("id", "src", "dst")
    out = None
    for downstream, edges in ((True, control.unionByName(W.reverse(supply))), (False, control.unionByName(supply).unionByName(W.reverse(supply)))):
        chain = W.nearest_chains(edges, ids, seeds, HOPS)
        one = chain.select(F.col("seed").alias("id"), F.col("id").alias("seed"), "hops", F.lit(downstream).alias("downstream"), "reachable", "node_ids", "rel_ids")
        out = one if out is None else out.unionByName(one)
    return _worse(g, out)


def _class_rank() -> Column:
    out = F.lit(None).cast("string")
    for cls, severity in CLASS_SEVERITY.items():
        out = F.when(F.col("class") == cls, severity).otherwise(out)
    return rank_of(out)


def _seats(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    """id, code: where entities (those among ids) are incorporated, their parents seated, and their topmost owners incorporated."""
    home = g.edges["INCORPORATED_IN"].select(F.col("src").alias("id"), "code")
    seat = _of(g.edges["PARENT_SEATED_IN"].select(F.col("src").alias("id"), "code"), ids)
    up = T.ultimate_parents(g, ids).select("id", "parent_id").join(home.groupBy(F.col("id").alias("parent_id")).agg(F.min("code").alias("code")), "parent_id").select("id", "code")
    return _of(home, ids).unionByName(seat).unionByName(up).distinct()


def foreign(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    """The worst class of the jurisdictions an entity is tied to; an opaque registry makes a mild one medium."""
    sites = g.edges["MANUFACTURES_IN"].select("src", "code").unionByName(g.edges["OPERATES_IN"].select("src", "code")).toDF("id", "code")
    known = placed(_seats(g, ids).unionByName(_of(sites, ids)).distinct()).where(F.col("class").isNotNull()).withColumn("r", _class_rank())
    worst = known.groupBy("id").agg(F.max("r").alias("r"), F.bool_or("opaque").alias("opaque"))
    return worst.select("id", F.when(F.col("opaque"), F.greatest("r", F.lit(2))).otherwise(F.col("r")).alias("rank"))


def person_foreign(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    """Of a person: the worst class of where their current seats, or if there are none all their seats, are incorporated or controlled."""
    current = F.coalesce("current", F.col("to").isNull())
    roles = _of(g.edges["HELD_ROLE"].select(F.col("src").alias("person"), F.col("dst").alias("id"), current.alias("current")), ids, "person")
    any_now = roles.groupBy("person").agg(F.bool_or("current").alias("any"))
    seats = roles.join(any_now, "person").where(F.col("current") | ~F.col("any")).select("person", "id").distinct()
    at = placed(seats.join(_seats(g, None if ids is None else seats.select("id").distinct()), "id")).where(F.col("class").isNotNull())
    return at.groupBy(F.col("person").alias("id")).agg(F.max(_class_rank()).alias("rank"))


def regional(g: Graph) -> DataFrame:
    """Conflict and natural hazard where an entity makes things (graded harder) or operates."""
    at = lambda t, made: g.edges[t].select(F.col("src").alias("id"), "code", F.lit(made).alias("made"))
    known = placed(at("MANUFACTURES_IN", True).unionByName(at("OPERATES_IN", False)))
    conflict = F.when(F.col("conflict") == "high", F.when(F.col("made"), 3).otherwise(2)).when(F.col("conflict").isNotNull(), 1)
    hazard = F.when(F.col("hazard") == "low", F.when(F.col("conflict").isNull(), 0)).when(F.col("hazard") == "high", F.when(F.col("made"), 2).otherwise(1)).when(F.col("hazard").isNotNull(), 1)
    return known.groupBy("id").agg(F.max(F.greatest(conflict, hazard)).alias("rank"))


def _latest(g: Graph, predicate: str) -> DataFrame:
    """id, value of the latest screen of a predicate, whichever source ran it."""
    rows = P.latest_screens(g, by_source=False).where(F.col("predicate") == predicate)
    return rows.select("id", "value")


def financial_signs(g: Graph, today: datetime.date = TODAY) -> tuple[DataFrame, list[tuple[Column, Column]], Column]:
    """The entities with what their signs are read from; the signs of distress, each a rank (null where it doesn't show) and what it says;
    and 0 where a screen, filings in time or an active registration say that all is well."""
    about = g.edges["ABOUT"].select(F.col("src").alias("doc"), F.col("dst").alias("id")).join(g.artifact.select(F.col("id").alias("doc"), "kind", "form", "published_at"), "doc")
    docs = about.where(F.col("kind").isin("award", "filing")).groupBy("id").agg(
        F.bool_or(F.col("form").isin(*LATE_FORMS)).alias("late"), F.max(F.when(F.col("kind") == "filing", F.try_to_date(F.substring("published_at", 1, 10), "yyyy-MM-dd"))).alias("filed")
    )
    e = g.entity.join(docs, "id", "left").join(_latest(g, "financial_screen").withColumnRenamed("value", "screen"), "id", "left")
    day = F.lit(today)
    status, expires = F.lower(F.trim(F.coalesce("registration_status", F.lit("")))), F.try_to_date(F.substring("registration_expires", 1, 10), "yyyy-MM-dd")
    gone = F.lit(False)
    for word in DEFUNCT:
        gone = gone | F.lower(F.coalesce("entity_status", F.lit(""))).contains(word)
    active = status.isin("active", "registered")
    say = lambda text, c: F.concat(F.lit(text), c.cast("string"))
    signs = [
        (F.when((status != "") & ~active, 2), say("registration is ", F.col("registration_status"))),
        (F.when(expires < day, 3).when(F.date_diff(expires, day) < WARN_DAYS, 1), say("registration ends ", expires)),
        (F.when(gone, 3), say("registry says ", F.col("entity_status"))),
        (F.when(F.col("late"), 2), F.lit("late filing on record")),
        (F.when(F.col("public") & (F.date_diff(day, F.col("filed")) > STALE_DAYS), 2), say("listed, nothing filed since ", F.col("filed"))),
        (F.when(F.col("price_change_12m") <= -50, 3).when(F.col("price_change_12m") <= -25, 2), F.concat(F.lit("value down "), F.abs(F.bround("price_change_12m", 0)).cast("int"), F.lit(" % in a year"))),
        (F.when(rank_of(F.col("screen")) > 0, rank_of(F.col("screen"))), say("financial screen says ", F.col("screen"))),
    ]
    well = F.when((F.col("screen") == "clear") | (F.col("public") & F.col("filed").isNotNull()) | active, 0)
    return e, signs, well


def financial(g: Graph, today: datetime.date = TODAY) -> DataFrame:
    """The worst sign of distress; clear where a screen, filings in time or an active registration say so."""
    e, signs, well = financial_signs(g, today)
    return e.select("id", F.coalesce(F.greatest(*[rank for rank, _ in signs]), well).alias("rank"))


def media(g: Graph) -> DataFrame:
    """The latest screen of the press; an unknown verdict is low."""
    return _latest(g, "adverse_media_screen").select("id", F.coalesce(rank_of(F.col("value")), F.lit(1)).alias("rank"))


def _weight(dimension: str) -> Column:
    """A clear grade counts a third."""
    w = PARTS[dimension]
    return F.when(F.col(dimension) == 0, w // 3).when(F.col(dimension).isNotNull(), w).otherwise(0)


def composite(dimensions: tuple[str, ...]) -> Column:
    """0 to 100, null where no dimension has data."""
    total = sum((PARTS[d] * F.coalesce(F.col(d), F.lit(0)) for d in dimensions), F.lit(0))
    ceiling = sum((_weight(d) for d in dimensions), F.lit(0)) * 3
    return F.when(ceiling > 0, F.bround(100 * total / ceiling, 0).cast("int"))


def confidence(dimensions: tuple[str, ...]) -> Column:
    """Share of the weight of all dimensions that have data, in percent."""
    has = sum((F.when(F.col(d).isNotNull(), PARTS[d]).otherwise(0) for d in dimensions), F.lit(0))
    return F.bround(100 * has / sum(PARTS[d] for d in dimensions), 0).cast("int")


def weights(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    """id (supplier), consumer, sole, weight, edge_id of each award (of the consumers ids): 1 for a sole source; competed ones share 1 by amount, or evenly."""
    e = _of(g.edges["SUPPLIES"].where("src <> dst"), ids, "dst").select(F.col("src").alias("id"), F.col("dst").alias("consumer"), F.coalesce("sole_source", F.lit(False)).alias("sole"), F.coalesce("amount", F.lit(0)).cast("double").alias("amount"), F.col("id").alias("edge_id"))
    of = e.where("not sole").groupBy("consumer").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    share = F.when(F.col("sole"), 1.0).when(F.col("total") > 0, F.col("amount") / F.col("total")).otherwise(1 / F.col("n"))
    return e.join(of, "consumer", "left").select("id", "consumer", "sole", share.alias("weight"), "edge_id")


def exposure(weighted: DataFrame, scores: DataFrame) -> DataFrame:
    """id (consumer), dependency: a grade from the worst sole source or the shares of competed ones, of suppliers with a score."""
    met = weighted.join(scores.where("score is not null"), "id")
    worst, spread = F.max(F.when(F.col("sole"), F.col("score"))), F.sum(F.when(~F.col("sole"), F.col("weight") * F.col("score")))
    x = met.groupBy(F.col("consumer").alias("id")).agg(F.round(F.least(F.lit(100.0), F.greatest(worst, spread)), 6).alias("x"))
    rank = F.lit(0)
    for floor, severity in sorted(P.EXPOSURE):
        rank = F.when(F.col("x") >= floor, SEVERITIES.index(severity)).otherwise(rank)
    return x.select("id", rank.alias("dependency"))


def grades(g: Graph, ids: DataFrame | None = None, today: datetime.date = TODAY, near: DataFrame | None = None) -> DataFrame:
    """id, label and the rank of each dimension of every entity and person (of those among ids). near: proximity_of() the same ids, where it is known."""
    part = within(g, ids)
    out = _nodes(part).select("id", "label")
    if near is None:
        near = proximity(g) if ids is None else nearest_of(g, ids)
    abroad = foreign(g, ids).unionByName(person_foreign(g, ids))
    for name, df in (("designation", designation(part)), ("proximity", near.select("id", "rank")), ("foreign", abroad), ("financial", financial(part, today)), ("regional", regional(part)), ("media", media(part))):
        out = out.join(df.select("id", F.col("rank").alias(name)), "id", "left")
    return out.withColumn("proximity", F.coalesce("proximity", F.lit(0)))


WHOLE = (*ENTITY_DIMENSIONS, "dependency")


def risk_scores(g: Graph, today: datetime.date = TODAY) -> DataFrame:
    """id, label, score, band, confidence, n_scored, top_factor, and the severity of each dimension."""
    own = settle(grades(g, today=today))
    return _scored(own.join(_inherited(own.where("label = 'Entity'"), weights(g)), "id", "left"))


def _inherited(entities: DataFrame, weighted: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """exposure() after PASSES rounds. others (id, score): scores that stay. Scores of suppliers alone are carried on, so that only the
    last round is of all consumers; those before are of consumers that supply."""
    weighted = settle(weighted.select("id", "consumer", "sole", "weight"))
    suppliers = settle(weighted.select("id").distinct())
    own, among = settle(_of(entities, suppliers)), settle(_of(weighted, suppliers, "consumer"))
    stay = None if others is None else settle(_of(others, suppliers))
    scores = own.select("id", composite(ENTITY_DIMENSIONS).alias("score"))
    for k in range(PASSES):
        scores = settle(scores if stay is None else stay.unionByName(scores))
        inherited = settle(exposure(among if k < PASSES - 1 else weighted, scores))
        scores = own.join(inherited, "id", "left").select("id", composite(WHOLE).alias("score"))
    return inherited


def rescore(g: Graph, ids: DataFrame, today: datetime.date = TODAY, near: DataFrame | None = None) -> DataFrame:
    """risk_scores() of the nodes ids (id) alone, as if all others kept the scores that they have stored: suppliers among ids count with
    their new scores, round by round, the others with their stored ones. Reads what ids are graded by, the ways from designated
    parties within HOPS (none where near, their proximity_of(), is known), and the awards whose consumers they are; nothing else of the graph is scored."""
    ids = settle(ids.select("id").where("id is not null").distinct())
    own = settle(grades(g, ids, today, near))
    stored = g.entity.where("risk_score is not null").select("id", F.col("risk_score").alias("score")).join(ids, "id", "left_anti")
    return _scored(own.join(_inherited(own.where("label = 'Entity'"), weights(g, ids), stored), "id", "left"))


def _scored(full: DataFrame) -> DataFrame:
    """What risk_scores() gives, of the ranks of all dimensions."""
    person = F.col("label") == "Person"
    score = F.when(person, composite(PERSON_DIMENSIONS)).otherwise(composite(WHOLE))
    sure = F.when(person, confidence(PERSON_DIMENSIONS)).otherwise(confidence(WHOLE))
    n = sum((F.when(F.col(d).isNotNull(), 1).otherwise(0) for d in WHOLE), F.lit(0))
    best = F.greatest(*[PARTS[d] * F.coalesce(F.col(d), F.lit(0)) for d in WHOLE])
    top = F.lit(None).cast("string")
    for d in reversed(WHOLE):
        top = F.when((best > 0) & (PARTS[d] * F.coalesce(F.col(d), F.lit(0)) == best), d).otherwise(top)
    return full.select("id", "label", score.alias("score"), band_of(score).alias("band"), sure.alias("confidence"), n.alias("n_scored"), top.alias("top_factor"), *(severity_of(F.col(d)).alias(d) for d in WHOLE))


def risk_explain(g: Graph, scored: DataFrame) -> DataFrame:
    """id, dimension, severity (no data: null), weight: a row for each dimension that a node of scored is asked about."""
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("severity"), F.lit(WEIGHTS[d]).alias("weight"), F.lit(d in PERSON_DIMENSIONS).alias("personal")) for d in WHOLE])
    return scored.select("id", "label", F.explode(rows).alias("r")).where("label = 'Entity' or r.personal").select("id", "r.dimension", "r.severity", "r.weight")


def rescored(g: Graph, ids: DataFrame, scored: DataFrame) -> DataFrame:
    """Entities with the scores of those among ids (id) written over; all others keep theirs."""
    fresh = scored.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("score").alias("s"), F.col("band").alias("b"), F.col("confidence").alias("c"), F.lit(True).alias("new"))
    had = g.entity.join(fresh, "id", "left")
    pick = lambda new, old: F.when(F.col("new"), F.col(new)).otherwise(F.col(old)).alias(old)
    return had.select(*[c for c in g.entity.columns if c not in ("risk_score", "risk_band", "risk_confidence")], pick("s", "risk_score"), pick("b", "risk_band"), pick("c", "risk_confidence"))
