"""Steps whose rows grow with the edges, held against brute force, and how many rows they make."""

import random

import pytest

from tradeweave.operators import walks as W


def _graph(spark, n=160, m=420, seed=5):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})
    rows = [(f"r{k}", a, b) for k, (a, b) in enumerate(edges)]
    return rows, spark.createDataFrame(rows, "id string, src string, dst string")


def _hops(rows, start, depth):
    out, front = {start: 0}, {start}
    for hop in range(1, depth + 1):
        front = {b for _, a, b in rows if a in front} - set(out)
        out |= dict.fromkeys(front, hop)
    return out


def test_chains_of_many_nodes_are_walked_as_bits(spark, monkeypatch):
    monkeypatch.setattr(W, "WORDS", 1)  # blocks of 64, so that there are several
    rows, edges = _graph(spark)
    ids, ends = [f"n{k}" for k in range(150)], [f"n{k}" for k in range(0, 160, 7)]
    of = lambda x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r["seed"]: r for r in W.nearest_chains(edges, of(ids), of(ends), 3).collect()}
    for a in ids:
        hops = _hops(rows, a, 3)
        met = sorted((hops[e], e) for e in ends if e in hops and e != a)
        if not met:
            assert a not in got
            continue
        r = got[a]
        assert (r["hops"], r["id"], r["reachable"]) == (*met[0], len(met))
        nodes, rels = [r["id"]], []
        for h in range(r["hops"] - 1, -1, -1):
            parent, rel = min((p, k) for k, p, b in rows if b == nodes[-1] and hops.get(p) == h)
            nodes, rels = [*nodes, parent], [*rels, rel]
        assert (r["node_ids"], r["rel_ids"]) == (nodes, rels)
    asked = W.numbered(of(ids))
    blocks = asked.select("block").distinct().count()
    most = len({x for _, a, b in rows for x in (a, b)} | set(ids)) * blocks
    assert all(m.count() <= most for m in W.marks(edges, asked, 3, of(ends)))


def test_nearest_seeds_are_those_of_brute_force(spark):
    rows, edges = _graph(spark, seed=9)
    seeds = [f"n{k}" for k in range(0, 160, 5)]
    got = {r["id"]: (r["hops"], r["seed"]) for r in W.nearest(edges, spark.createDataFrame([(s,) for s in seeds], "id string"), 3).collect()}
    want = {}
    for s in seeds:
        for i, h in _hops(rows, s, 3).items():
            if i != s:
                want[i] = min(want.get(i, (9, "")), (h, s))
    assert got == want


@pytest.mark.parametrize("few", [False, True])
def test_nearest_seeds_of_some_nodes_are_those_of_all(spark, few):
    rows, edges = _graph(spark, seed=11 + few)
    of = lambda x: spark.createDataFrame([(i,) for i in x], "id string")
    seeds, ids = of(f"n{k}" for k in range(0, 160, 50 if few else 7)), of(f"n{k}" for k in range(0, 160, 3))
    want = {tuple(r) for r in W.nearest(edges, seeds, 3).join(ids, "id", "left_semi").select("id", "seed", "hops").collect()}
    assert {tuple(r) for r in W.nearest_to(edges, seeds, 3, ids).collect()} == want and want
    assert W.nearest_to(edges, seeds, 3, ids.where("false")).collect() == []


def test_proximity_against_the_flow_is_walked_for_what_is_left(spark, monkeypatch):
    """One sweep of all edges, not two: the other reading is of nodes that the first gives no worse grade."""
    from tradeweave.model import landed
    from tradeweave.plans import risk as R

    from .oracle import SMALL

    g, swept, asked = landed(spark, SMALL), [], []
    monkeypatch.setattr(W, "nearest", lambda *a, walk=W.nearest: swept.append(1) or walk(*a))
    monkeypatch.setattr(W, "nearest_to", lambda *a, walk=W.nearest_to: asked.append(a[3].count()) or walk(*a))
    R.proximity(g)
    assert len(swept) == 1 and asked[0] < g.nodes.where("label in ('Entity', 'Person')").count() / 2


@pytest.mark.parametrize("walk", ["nearest", "steps"])
def test_later_rounds_do_not_walk_what_is_settled(spark, monkeypatch, walk):
    """A hub among seeds: what has its seeds after a round isn't walked into again."""
    made = []
    monkeypatch.setattr(W, "settle", lambda df, keep=W.settle: made.append(keep(df)) or made[-1])
    pairs = [(f"s{k}", f"c{c}") for k in range(10) for c in range(20)]
    both = [(f"r{n}", a, b) for n, (a, b) in enumerate([*pairs, *[(b, a) for a, b in pairs]])]
    edges = spark.createDataFrame(both, "id string, src string, dst string")
    getattr(W, walk)(edges, spark.createDataFrame([("s0",), ("s1",)], "id string"), 3).collect()
    if walk == "nearest":  # edges left for the last round: none, as each node has two seeds
        assert [df.count() for df in made if df.columns == ["src", "dst"]][-1] == 0
    else:  # the third hop meets nothing that wasn't met before
        assert [df.count() for df in made if "parent" in df.columns] == [40, 18, 0]


def test_ways_near_designated_hold_neither_edges_nor_what_was_met(spark):
    rows, edges = _graph(spark, seed=3)
    seeds = ["n1", "n2", "n50"]
    got = {(r["seed"], r["id"]): (r["hops"], r["via"]) for r in W.first_ways(edges, spark.createDataFrame([(s,) for s in seeds], "id string"), 3).collect()}
    old = W.first_paths(edges, spark.createDataFrame([(s,) for s in seeds], "id string"), 3).collect()
    assert got == {(r["seed"], r["id"]): (r["hops"], r["node_ids"][1:-1]) for r in old}


def test_partitions_grow_with_the_tables(spark, monkeypatch):
    from tradeweave import model

    from .oracle import SMALL

    had = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        model.deal_out(spark, SMALL)
        assert spark.conf.get("spark.sql.shuffle.partitions") == had
        monkeypatch.setattr(model, "PART_BYTES", 4 << 10)
        model.deal_out(spark, SMALL)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > int(had)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


def test_ids_of_like_neighbours_share_a_block(spark, monkeypatch):
    monkeypatch.setattr(W, "WORDS", 1)  # blocks of 64
    rows = [(f"r{g}_{k}", f"p{k}_{g}", f"hub{g}") for g in range(4) for k in range(50)]
    ids = spark.createDataFrame([(a,) for _, a, _ in rows], "id string")
    at = {r["id"]: r["block"] for r in W.numbered(ids, spark.createDataFrame(rows, "id string, src string, dst string")).collect()}
    assert len(at) == 200
    met = {(at[a], hub) for _, a, hub in rows}
    assert len(met) < 4 + len(set(at.values())) <= 4 + 5  # dealt by hash each block meets every hub


def test_reasons_are_told_without_a_sweep_of_the_graph(spark, monkeypatch):
    from tradeweave.model import landed
    from tradeweave.plans import explain as X
    from tradeweave.plans import risk as R

    from .oracle import SMALL

    monkeypatch.setattr(R, "proximity", lambda g: pytest.fail("the chains say how near each node is"))
    g = landed(spark, SMALL)
    out = X.explained(g, g.entity.where("id in ('ent_c0', 'ent_s4')").select("id"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0  # each dimension has a plan of its own
    assert {r["dimension"] for r in out.collect()} == set(R.WEIGHTS)


def test_blocked_nodes_are_not_entered_by_steps(spark):
    rows = [("r1", "a", "b"), ("r2", "b", "c"), ("r3", "a", "d"), ("r4", "d", "e"), ("r5", "e", "c")]
    edges, of = spark.createDataFrame(rows, "id string, src string, dst string"), lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {(r["id"], r["hops"], r["parent"]) for r in W.steps(edges, of("a"), 4, blocked=of("b")).collect()}
    assert got == {("d", 1, "a"), ("e", 2, "d"), ("c", 3, "e")}


def test_paths_of_payloads_are_literals(spark):
    from tradeweave.sources import shapes as S

    known = S.parsed(spark.createDataFrame([("a", '{"primaryDocument": "x", "form": "8-K", "size": 0}')], "id string, payload string")).select("id", "body", "shape")
    got = S._mapped(known)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # a path that is a column is parsed again for each row
    assert {(r["label"], r["value"]) for r in got.collect()} == {("Form", "8-K"), ("Primary document", "x"), ("Size", "0")}


def test_the_base_of_a_report_is_walked_once(spark, monkeypatch):
    from tradeweave.model import landed
    from tradeweave.plans import report_store as K
    from tradeweave.plans.registry import ROOT

    from .oracle import SMALL

    walked = []
    monkeypatch.setattr(W, "reach", lambda *a, walk=W.reach: walked.append(1) or walk(*a))
    out = K.citations(K.assembled(landed(spark, SMALL), ROOT, "2025-03-01T00:00:00Z"))
    assert len(walked) == 1
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # both kinds of edges read one written report
