"""Styles and live changes on small canvases made by hand."""

import random

import pytest

from tradeweave.plans import styles as S


def op(seq, kind, scope=None, dashed=None, label=None, **style):
    return (seq, kind, scope, *(style.get(p) for p in S.PROPERTIES), dashed, label)


def replay(elements, ops, targets):
    """One by one, as a canvas does it."""
    state = {i: {"dim": False, "hide": False, "dashed": False, "highlight": False} for i, _ in elements}
    for seq, kind, scope, *style, dashed, _ in sorted(ops, key=lambda o: o[0]):
        ids = [i for s, i in targets if s == seq]
        reach = [i for i in ids if i in state] if ids or kind in ("set", "highlight") else [i for i, k in elements if scope in (None, "all", k)]
        for i in ([i for i, k in elements if scope in (None, "all", k)] if kind == "clear" else reach):
            if kind == "clear":
                state[i] = {"dim": False, "hide": False, "dashed": False, "highlight": False}
            elif kind in ("dim", "hide"):
                state[i][kind] = True
            else:
                state[i] |= {p: v for p, v in zip(S.PROPERTIES, style, strict=True) if v} | {"dim": False} | ({"dashed": True} if dashed else {}) | ({"highlight": True} if kind == "highlight" else {})
    return {i: (*(s.get(p) for p in S.PROPERTIES), s["dashed"], s["highlight"], s["dim"], s["hide"]) for i, s in state.items()}


@pytest.mark.parametrize("seed", range(3))
def test_the_fold_is_the_replay(spark, seed):
    r = random.Random(seed)
    elements = [(f"n{k}", "nodes") for k in range(8)] + [(f"e{k}", "edges") for k in range(8)]
    ops, targets = [], []
    for k in range(40):
        kind = r.choice(["set", "set", "highlight", "dim", "hide", "clear"] if k % 7 == 0 else ["set", "highlight", "dim", "set"])
        ops.append(op(k, kind, r.choice([None, "all", "nodes", "edges"]), r.choice([None, True, False]), None, **{p: r.choice([None, "red", "blue"]) if p in ("fill", "stroke") else r.choice([None, "x", "y"]) for p in r.sample(S.PROPERTIES, 2)}))
        if kind != "clear" and r.random() < 0.8:
            targets += [(k, i) for i in r.sample([i for i, _ in elements] + ["gone"], 4)]
    got = S.style_state(spark.createDataFrame(elements, "id string, kind string"), spark.createDataFrame(ops, S.OPS), spark.createDataFrame(targets, "seq int, id string")).collect()
    assert {r.id: tuple(r)[1:] for r in got} == replay(elements, ops, targets)


def test_colours_and_legend(spark):
    ops = spark.createDataFrame([op(0, "set", fill="red"), op(1, "clear", "edges"), op(2, "set", fill=" Blue "), op(3, "highlight", stroke="#fff", badge="B"), op(4, "set", fill="blue"), op(5, "dim", "all"), op(6, "set", label="L", fill="blue")], S.OPS)
    targets = spark.createDataFrame([(0, "a"), (2, "a"), (2, "b"), (3, "a"), (4, "c"), (6, "a")], "seq int, id string")
    assert [tuple(r) for r in S.legend(ops, targets).orderBy("place").collect()] == [(1, "blue", "Blue", 3), (2, "neutral", "B", 1), (3, "blue", "L", 1)]
    none = spark.createDataFrame([], S.OPS)
    assert S.legend(none, spark.createDataFrame([], "seq int, id string")).collect() == []
    state = S.style_state(spark.createDataFrame([("a", "nodes")], "id string, kind string"), none, spark.createDataFrame([], "seq int, id string")).collect()
    assert [tuple(r) for r in state] == [("a", None, None, None, None, None, False, False, False, False)]


def test_a_change_arrives(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    N, E, X = "id string, kind string, v int", "id string, src string, dst string", "id string, src string, dst string, seq int"
    nodes, edges = frame([("p", "program", 1), ("a", "organization", 1)], N), frame([("pa", "a", "p")], E)
    new_nodes = frame([("a", "organization", 2), ("b", "organization", 2), ("c", "organization", 2), ("d", "organization", 2), ("q", "program", 2), ("z", "organization", 2)], N)
    new_edges = frame([("cd", "c", "d", 0), ("ab", "a", "b", 1), ("bc", "b", "c", 2), ("aq", "a", "q", 3), ("qz", "q", "z", 4)], X)

    def after(changed, focus):
        n, e, fresh = S.apply_delta(nodes, edges, new_nodes, new_edges, frame([(i,) for i in changed], "id string"), focus)
        return {(r.id, r.v) for r in n.collect()}, {r.id for r in e.collect()}, {r.id for r in fresh.collect()}

    every = {("p", 1), ("a", 2), ("b", 2), ("c", 2), ("d", 2)}
    assert after(["a"], None) == (every | {("q", 2), ("z", 2)}, {"pa", "cd", "ab", "bc", "aq", "qz"}, {"a", "b", "c", "d", "q", "z", "cd", "ab", "bc", "aq", "qz"})
    assert after(["a"], "p") == ({("p", 1), ("a", 2), ("b", 2), ("c", 2)}, {"pa", "ab", "bc"}, {"a", "b", "c", "ab", "bc"})  # cd came before c was taken
    assert after(["b"], "p")[0] == every | {("z", 2)} and after(["b"], "p")[1] == {"pa", "cd", "ab", "bc"}  # about a node that isn't drawn yet
    n, e, fresh = S.apply_delta(nodes, edges, new_nodes.limit(0), new_edges.limit(0), frame([], "id string"), "p")
    assert n.count() == 2 and e.count() == 1 and fresh.count() == 0
