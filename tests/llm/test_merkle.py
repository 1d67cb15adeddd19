from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

import tradeweave.llm.merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part int, tree long, idx long, digest string, leaf string"
H = lambda s: sha256(s.encode()).hexdigest()


def table(spark, rows):
    """rows: (doc_id, source, lang, n_chars, text); extra columns have names that the operator uses inside."""
    return spark.createDataFrame([(*r, 1, 2, 3, "x", "y") for r in rows], SCHEMA)


def leaf(row) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain(rows) -> list[tuple]:
    of = defaultdict(list)
    for r in rows:
        of[r[1]].append(r)
    order = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(of[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in order}
    built = {s: climb([leaf(r) for r in trees[s]]) for s in order}
    top = climb([built[s][-1][0] for s in order])
    out = []
    for rank, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            now, proof = leaf((*r[:4], text)), []
            for levels, k in ((built[s], i), (top, rank)):
                for level in levels[:-1]:
                    a = k // 3 * 3
                    run = level[a : a + 3]
                    proof += [d for j, d in enumerate(run) if a + j != k]
                    now = H("".join(now if a + j == k else d for j, d in enumerate(run)))
                    k //= 3
            out.append((r[0], leaf(r), built[s][-1][0], top[-1][0], H("".join(proof)), now, now == top[-1][0]))
    return out


def made(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for k in range(n):
        source = r.choice(["hot"] * 6 + ["a", "b", "é", "", None, "\U0001f600", "Z"] + [f"s{k}"] * 2)
        rows.append((r.choice([k, k, k, None, 7, -k]), source, r.choice(["en", None, ""]), r.choice([None, k]), r.choice([None, "", "line\nline\n", "no break", "\n", "é\n" * 5, f"text {k}\n"])))
    return rows + rows[:10] * 3


@pytest.mark.parametrize(("n", "leaves", "stride"), [(400, 32_768, 7), (150, 11, 1), (150, 40, 2)])
def test_proofs_are_the_plain_ones(spark, monkeypatch, n, leaves, stride):
    monkeypatch.setattr(M, "LEAVES", leaves)
    monkeypatch.setattr(M, "STRIDE", stride)
    rows = made(n + stride, n)
    got = [tuple(r) for r in M.prove(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_empty_single_and_equal_rows(spark):
    assert M.prove(table(spark, [])).collect() == []
    for rows in ([(5, None, None, None, None)], [(5, "a", "en", 1, "x\ny")] * 10):
        got = [tuple(r) for r in M.prove(table(spark, rows)).collect()]
        assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 40])
def test_missing_nodes_are_the_fewest(n):
    """What a range lacks is enough for its proofs, and without any one node of it they can't be made."""
    levels = climb([str(k) for k in range(n)])
    for lo in range(n):
        for hi in range(lo + 1, n + 1):
            wanted = list(M.missing(lo, hi, n))
            given = {(k, i): levels[k][i] for k, i in wanted}
            branch = M.Branch(lo, levels[0][lo:hi], n, given)
            assert branch.root == levels[-1][0] and len(given) == len(wanted)
            assert all(M.fold(levels[0][i], branch.proof(i)) == branch.root for i in range(lo, hi))
            below = {(k, i) for k in range(len(levels)) for i in range(len(levels[k])) if all(lo <= j < hi for j in range(i * 3**k, min(n, (i + 1) * 3**k)))}
            assert not below & given.keys()  # none can be derived from the range alone
