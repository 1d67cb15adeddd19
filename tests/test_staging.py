"""References of one batch resolved against the graph and each other."""

from tradeweave.plans import staging as S

from .test_focus import graph


def ref(i, label="Entity", name=None, uei=None, lei=None, cage=None):
    return (label, i, name, uei, lei, cage)


def fact(subject, predicate, obj=None, value=None, url=None, source="s1", title="t"):
    return (subject, predicate, obj, value, source, "open", 0.7, "m", "d", "2024-01-01", (url, title, "record", None) if url else None)


def test_one_node_for_what_is_the_same(spark):
    g = graph(spark, [("e1", "organization", None), ("e2", "organization", None)], [("p1", False)])
    g = g.with_(entity=spark.createDataFrame([("e1", "Acme Inc", "U1"), ("e2", "Bolt", None)], "id string, name string, uei string"))
    a, b, c, d = ref("n4", name="Newcomer Ltd"), ref("n2", name="newcomer", lei="l9"), ref("n3", lei="L9", cage="c1"), ref("n1", cage="C1", name="Other name")
    facts = [
        fact(ref("e2"), "SUPPLIES", a, url="https://x/1"), fact(b, "OWNS", c), fact(d, "SUPPLIES", ref("q1", name="ACME, Inc."), url="https://x/1", title="longer"), fact(ref("q2", uei="u1", name="Whatever Group"), "SUPPLIES", ref("q3", name="Whatever")),
        fact(ref("p1", "Person"), "HELD_ROLE", ref("q1", name="ACME, Inc.")), fact(ref("p9", "Person", name="Jo"), "HELD_ROLE", a), fact(ref("n5"), "mention", url="https://x/2"), fact(ref(None, name="Acme"), "mention"), fact(ref("e1"), None),
        fact(ref("e2"), "SUPPLIES", a, url="https://x/1"),
    ]
    got = S.stage(g, spark.createDataFrame(facts, S.FACT))
    assert {r.id: (r.node, r.method) for r in got.refs.collect()} == {
        "e2": ("e2", "id"), "n1": ("n1", "new"), "n2": ("n1", "group"), "n3": ("n1", "group"), "n4": ("n1", "group"), "q1": ("e1", "name_exact"), "q2": ("e1", "uei"), "q3": ("e1", "group"), "p1": ("p1", "id"), "p9": ("p9", "id"), "n5": ("n5", "new"),
    }
    claims = {(r.subject_id, r.predicate, r.object_id): (r.status, r.note) for r in got.claims.collect()}
    assert claims == {
        ("e2", "SUPPLIES", "n1"): ("staged", None), ("n1", "OWNS", "n1"): ("rejected", S.NOTE), ("n1", "SUPPLIES", "e1"): ("staged", None), ("e1", "SUPPLIES", "e1"): ("rejected", S.NOTE), ("p1", "HELD_ROLE", "e1"): ("staged", None), ("p9", "HELD_ROLE", "n1"): ("staged", None), ("n5", "mention", None): ("staged", None),
    }
    assert {(r.id, r.label, r.name, r.lei, r.cage) for r in got.nodes.collect()} == {("n1", "Entity", "Newcomer Ltd", "L9", "C1"), ("p9", "Person", "Jo", None, None), ("n5", "Entity", None, None, None)}
    edges = {(r.type, r.dst) for r in got.edges.collect()}
    assert {d for t, d in edges if t == "ABOUT"} == {"e2", "n1", "n5"} and {d for t, d in edges if t == "TARGETS"} == {"n1", "e1"} and sum(t == "EVIDENCES" for t, _ in edges) == 3
    arts = {r.url: r for r in got.artifacts.collect()}
    old = spark.createDataFrame([(arts["https://x/1"].id, "https://x/1", "old", "record", "s0", "2020-01-01")], "id string, url string, title string, kind string, source string, published_at string")
    after = {r.url: (r.title, r.source, r.published_at) for r in S.artifacts_after(old, got).collect()}
    assert after == {"https://x/1": ("longer", "s1", "2020-01-01"), "https://x/2": ("t", "s1", None)}


def test_no_facts(spark):
    g = graph(spark, [("e1", "organization", None)])
    got = S.stage(g, spark.createDataFrame([], S.FACT))
    assert got.claims.count() == got.nodes.count() == got.artifacts.count() == got.edges.count() == got.refs.count() == 0
