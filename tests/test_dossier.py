"""Families of indicators on small graphs made by hand: priorities, nulls, ties and graphs without rows."""

import pytest

from tradeweave.model import Graph
from tradeweave.plans import dossier as D


def graph(spark, entities, roles=(), edges=None, places=None):
    entity = spark.createDataFrame(entities, "id string, name string, kind string, flagged boolean, lei string, public boolean")
    person = spark.createDataFrame([(p,) for p in sorted({r[0] for r in roles})], "id string").selectExpr("id", "id as name", "false as flagged")
    none = lambda schema: spark.createDataFrame([], schema)
    claim = none("id string, predicate string, subject_id string, object_id string, object_value string, source string, status string, retrieved_at string")
    e = {t: spark.createDataFrame((places or {}).get(t, []), "src string, code string") for t in ("INCORPORATED_IN", "PARENT_SEATED_IN", "MANUFACTURES_IN", "OPERATES_IN")}
    e |= {t: spark.createDataFrame((edges or {}).get(t, []), "id string, src string, dst string") for t in ("OWNS", "MEMBER_OF", "LOBBIES", "DONATED_TO", "ABOUT")}
    e["SUPPLIES"] = spark.createDataFrame((edges or {}).get("SUPPLIES", []), "id string, src string, dst string, sole_source boolean")
    e["HELD_ROLE"] = spark.createDataFrame(list(roles), "src string, dst string, current boolean, to string")
    return Graph(spark, entity, person, none("id string"), none("id string"), none("id string, kind string"), claim, e)


def org(id_, flagged=False, kind="organization", lei=None, name=None):
    return (id_, name or id_, kind, flagged, lei, None)


def ranks(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_people_by_priority(spark):
    orgs = [org(x) for x in "abcdefg"] + [org("bad", flagged=True), org("sup"), org("a2", lei="L"), org("a3", lei="L")]
    now, then = (True, None), (False, "2020-01-01")
    roles = [
        ("p1", "a", *now), ("p1", "bad", *now),  # at once
        ("p2", "b", *then), ("p2", "bad", *now), ("p3", "b", *now), ("p3", "bad", *now),  # one left for it: that comes first
        ("p4", "c", *now), ("p4", "bad", *then),
        ("p5", "d", *now), ("p5", "sup", *then),
        ("p6", "e", *now), ("p6", "sup", *now),
        ("p7", "f", None, None),  # current, as it has no end
        ("p8", "a2", *now), ("p8", "a3", *now),  # one organisation by its lei
    ]
    g = graph(spark, orgs, roles, {"SUPPLIES": [("s1", "sup", "g", False), ("s2", "a2", "g", None), ("s3", "a3", "g", True)]})
    got = ranks(D.people(D.seats(g)), "rank")
    assert {k: got.get(k) for k in ("a", "b", "c", "d", "e", "f", "g", "a2", "a3")} == {"a": 3, "b": 2, "c": 2, "d": 2, "e": 1, "f": 0, "g": None, "a2": 0, "a3": 0}


def test_government_needs_a_current_seat(spark):
    orgs = [org("a"), org("b"), org("c"), org("gov", kind="agency")]
    roles = [("p1", "a", True, None), ("p1", "gov", True, None), ("p2", "b", True, None), ("p2", "gov", False, "2019"), ("p3", "c", False, "2018"), ("p3", "gov", True, None)]
    g = graph(spark, orgs, roles)
    got = ranks(D.government(g, D.seats(g)), "rank")
    assert (got["a"], got["b"], got.get("c")) == (2, 1, None)


def test_ties_and_hints(spark):
    orgs = [org("a"), org("b", name="Royal Works"), org("c", flagged=True), org("d"), org("e")]
    edges = {"MEMBER_OF": [("m1", "a", "b"), ("m2", "d", "c")], "LOBBIES": [("l1", "e", "a")], "DONATED_TO": [("d1", "d", "a")], "OWNS": [("o1", "e", "d")]}
    g = graph(spark, orgs, edges=edges, places={"INCORPORATED_IN": [("d", "CN"), ("a", "US")]})
    ties = D.affiliations(g)
    assert ranks(D.tied(ties), "rank") == {"a": 1, "b": 0, "d": 3, "c": 2, "e": 2}
    assert ranks(D.political(g, ties), "rank") == {"a": 1, "b": None, "c": None, "d": 0, "e": 1}


def test_ownership_and_mean(spark):
    g = graph(spark, [org(x) for x in "abcd"], edges={"OWNS": [("o", "a", "b"), ("o", "a", "b")]}, places={"PARENT_SEATED_IN": [("c", "CN-31"), ("d", "us-tx")]})
    rows = D.indicators(g)
    assert ranks(rows, "ownership") == {"a": None, "b": 1, "c": 3, "d": 0}
    assert ranks(D.indicator_mean(rows), "composite") == {"a": 0, "b": 33, "c": 100, "d": 0}  # a owns b: a tie that is clear


@pytest.mark.parametrize("what", [D.indicators, D.affiliations, D.seats])
def test_empty_graph(spark, what):
    assert what(graph(spark, [])).count() == 0
