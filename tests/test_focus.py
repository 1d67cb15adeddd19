"""What is drawn around a node, and chains to designated parties, on small graphs made by hand."""

import pytest

from tradeweave.model import Graph
from tradeweave.operators import walks as W
from tradeweave.plans import focus as C
from tradeweave.plans import risk as R


def graph(spark, entities, people=(), **edges):
    """entities: (id, kind, score); people: (id, flagged); edges by type: (src, dst), each edge named after its ends."""
    entity = spark.createDataFrame([(i, i.upper(), k, False, s) for i, k, s in entities], "id string, name string, kind string, flagged boolean, risk_score int")
    person = spark.createDataFrame([(i, i.upper(), f) for i, f in people], "id string, name string, flagged boolean")
    claim = spark.createDataFrame([], "id string, predicate string, subject_id string, object_id string, object_value string, source string, status string, retrieved_at string, trust string, confidence double, detail string")
    e = {t: spark.createDataFrame([(f"{t[0]}:{a}-{b}", a, b) for a, b in pairs], "id string, src string, dst string") for t, pairs in edges.items()}
    for t in ("SUPPLIES", "OWNS", "HELD_ROLE"):
        e.setdefault(t, spark.createDataFrame([], "id string, src string, dst string"))
    none = spark.createDataFrame([], "id string")
    return Graph(spark, entity, person, none, none, none, claim, e)


@pytest.fixture(scope="module")
def drawn(spark):
    orgs = [("p1", "program", None), ("p2", "program", None), ("s1", "organization", 10), ("s2", "organization", 10), ("s3", "organization", 10), ("own", "organization", 5), ("sister", "organization", 5), ("deep", "organization", 90), ("via", "organization", 1), ("far", "organization", 2), ("lost", "organization", 99)]
    people = [("boss", True), ("clerk", False), ("chair", False)]
    return graph(
        spark, orgs, people, SUPPLIES=[("s1", "p1"), ("s2", "p1"), ("s2", "p2"), ("s3", "p2"), ("lost", "s3"), ("via", "s1"), ("deep", "via")],
        OWNS=[("own", "s1"), ("own", "sister")], HELD_ROLE=[("boss", "own"), ("clerk", "s2"), ("chair", "s2"), ("chair", "far")],
    )


def ids(df):
    return {r.id: r.hops for r in df.collect()}


def test_a_program_stays_inside_and_keeps_its_risky_nodes(drawn):
    nodes, edges = C.focus(drawn, "p1", 1, program="p1")
    got = ids(nodes)
    assert got == {"p1": 0, "s1": 1, "s2": 1, "via": None, "deep": None, "own": None, "boss": None}  # lost is behind p2
    assert {r.id for r in edges.collect()} == {"S:s1-p1", "S:s2-p1", "S:via-s1", "S:deep-via", "O:own-s1", "H:boss-own"}


def test_ownership_is_walked_upward_in_a_program_alone(drawn):
    assert "sister" not in ids(C.focus(drawn, "p1", 4, program="p1")[0])
    assert "sister" in ids(C.focus(drawn, "p1", 4)[0])


def test_people_are_cut_with_what_they_alone_tied_in(drawn):
    assert ids(C.focus(drawn, "s2", 2, ("people",)) [0]) == {"s2": 0, "p1": 1, "p2": 1, "clerk": 1, "chair": 1, "s1": 2, "s3": 2, "far": 2}
    assert ids(C.focus(drawn, "s2", 2)[0]) == {"s2": 0, "p1": 1, "p2": 1, "s1": 2, "s3": 2}
    assert ids(C.focus(drawn, "clerk", 1)[0]) == {"clerk": 0, "s2": 1}  # a root stays


def test_no_more_than_the_limit_and_no_root(drawn):
    assert ids(C.focus(drawn, "s2", 2, ("people",), limit=4)[0]) == {"s2": 0, "chair": 1, "clerk": 1, "p1": 1}
    nodes, edges = C.focus(drawn, "nobody", 2)
    assert nodes.count() == edges.count() == 0


def test_steps_and_chains(spark):
    edges = spark.createDataFrame([("1", "a", "b"), ("0", "a", "c"), ("2", "b", "d"), ("3", "c", "d"), ("4", "c", "d"), ("5", "d", "a"), ("6", "d", "e")], "id string, src string, dst string")
    seeds = spark.createDataFrame([("a",), ("c",)], "id string")
    stepped = W.steps(edges, seeds, 3)
    assert {(r.seed, r.id): (r.hops, r.parent, r.rel) for r in stepped.collect()} == {
        ("a", "b"): (1, "a", "1"), ("a", "c"): (1, "a", "0"), ("a", "d"): (2, "b", "2"), ("a", "e"): (3, "d", "6"), ("c", "d"): (1, "c", "3"), ("c", "a"): (2, "d", "5"), ("c", "e"): (2, "d", "6"), ("c", "b"): (3, "a", "1"),
    }
    ends = stepped.where("id = 'e'").select("seed", "id", "hops")
    got = {r.seed: (r.node_ids, r.rel_ids, r.hops) for r in W.chains(stepped, ends, 3).collect()}
    assert got == {"a": (["e", "d", "b", "a"], ["6", "2", "1"], 3), "c": (["e", "d", "c"], ["6", "3"], 2)}


def test_chains_to_designated_parties(spark):
    g = graph(spark, [("a", "organization", None), ("b", "organization", None), ("c", "organization", None), ("z", "organization", None)], [("bad", True), ("worse", True)], SUPPLIES=[("a", "b"), ("b", "c")], HELD_ROLE=[("bad", "a"), ("worse", "a"), ("worse", "c")])
    asked = g.entity.select("id")
    got = {r.id: (r.seed, r.hops, r.downstream, r["rank"], r.reachable, ">".join(r.node_ids)) for r in R.proximity_of(g, asked).collect()}
    assert got == {"a": ("bad", 1, True, 3, 2, "bad>a"), "b": ("bad", 2, True, 2, 2, "bad>a>b"), "c": ("worse", 1, True, 3, 2, "worse>c")}
    whole = {r.id: (r.seed, r.hops, r.downstream, r["rank"]) for r in R.proximity(g).where("id in ('a', 'b', 'c', 'z')").collect()}
    assert whole == {i: v[:4] for i, v in got.items()}
    for some in (["a"], ["c", "z"], ["a", "b", "c", "z"]):
        near = {r.id: (r.seed, r.hops, r.downstream, r["rank"]) for r in R.nearest_of(g, spark.createDataFrame([(i,) for i in some], "id string")).collect()}
        assert near == {i: v for i, v in whole.items() if i in some}
