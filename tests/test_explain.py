"""Reasons of scores: they agree with the scores, and name what is in the graph."""

import pytest
from pyspark.sql import functions as F

from tradeweave.functions.dims import PERSON_DIMENSIONS, WEIGHTS
from tradeweave.model import landed
from tradeweave.plans import explain as X
from tradeweave.plans import risk as R

from .oracle import SMALL
from .test_focus import graph


@pytest.fixture(scope="module")
def told(spark):
    g = landed(spark, SMALL)
    ids = g.entity.where("id in ('ent_c0', 'ent_s0', 'ent_s3', 'ent_s4', 'ent_s7')").select("id").unionByName(g.person.where("id in ('per_u4', 'per_u3')").select("id"))
    rows = X.explained(g, ids).collect()
    scores = {r.id: r for r in R.rescore(g, ids).collect()}
    return g, rows, scores


def test_each_dimension_is_told_once_with_its_grade(told):
    _, rows, scores = told
    want = {(i, d): s[d] for i, s in scores.items() for d in (WEIGHTS if s.label == "Entity" else PERSON_DIMENSIONS)}
    assert {(r.id, r.dimension): r.severity for r in rows} == want and len(rows) == len(want)
    assert all(r.label and r.weight == WEIGHTS[r.dimension] for r in rows)


def test_what_is_pointed_at_is_in_the_graph(told):
    g, rows, _ = told
    there = {r.id for r in g.nodes.select("id").unionByName(g.all_edges.select("id")).collect()}
    for r in rows:
        assert r.element_ids[0] is not None and set(r.element_ids) <= there and len(set(r.element_ids)) == len(r.element_ids)
    near = [r for r in rows if r.dimension == "proximity" and r.severity != "clear"]
    assert near and all(len(r.element_ids) > 1 and " → " in r.detail for r in near)


def test_grades_without_data_say_so(told):
    for r in told[1]:
        if r.severity is None:
            assert r.label.startswith("No") or "none scored" in r.label
        assert not (r.severity in ("medium", "high") and r.label.startswith("No"))


def test_what_carries_a_consumers_exposure(spark):
    g = graph(spark, [(x, "organization", None) for x in ("c", "d", "e", "s1", "s2", "s3", "s4")])
    weighted = spark.createDataFrame(
        [("s1", "c", True, 1.0, "e1"), ("s2", "c", False, 0.75, "e2"), ("s3", "c", False, 0.25, "e3"), ("s4", "c", False, 0.5, "e4"), ("s2", "d", False, 0.6, "e5"), ("s3", "d", False, 0.4, "e6"), ("s4", "e", False, 1.0, "e7")],
        "id string, consumer string, sole boolean, weight double, edge_id string",
    )
    scores = spark.createDataFrame([("s1", 80), ("s2", 60), ("s3", 60), ("s4", None)], "id string, score int")
    got = {r.id: r for r in X.dependency(g, g, weighted, scores).collect()}
    assert got["c"].label == "Only source S1 (risk 80)" and got["c"].detail == "exposure 80 of 100 by 4 suppliers · 1 only sources · 1 unscored · S1 100 % of 80; S2 75 % of 60; S3 25 % of 60"
    assert got["c"].element_ids == ["c", "s1", "e1", "s2", "e2", "s3", "e3"]
    assert got["d"].label == "Supply base carries 60, most of it S2 (risk 60)" and got["e"].label == "1 supplier, none scored" and got["e"].detail is None
    assert got["s1"].label == "No suppliers on record" and got["s1"].element_ids == ["s1"]
    assert [(r.id, r["rank"]) for r in X.drivers(weighted, scores, 2).where("consumer = 'c'").orderBy("rank").collect()] == [("s1", 1), ("s2", 2)]


def test_rescoring_counts_others_with_what_they_have_stored(spark):
    """Fresh scores of everything would differ: the supplier that isn't asked about keeps its stored 90."""
    g = landed(spark, SMALL)
    supplier, consumer = g.edges["SUPPLIES"].where("tier = 1").select("src", "dst").first()
    one = g.edges["SUPPLIES"].where((F.col("src") == supplier) & (F.col("dst") == consumer))
    for stored, want in ((90, "high"), (30, "medium"), (None, None)):
        changed = g.with_(entity=g.entity.withColumn("risk_score", F.lit(stored).cast("int")), edges=g.edges | {"SUPPLIES": one})
        got = R.rescore(changed, spark.createDataFrame([(consumer,)], "id string")).collect()
        assert [(r.id, r.dependency) for r in got] == [(consumer, want)]
