from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

import tradeweave.llm.langid as L

from .util import ODD

SCHEMA = "doc_id long, text string, lang string, held_out string, known_id int, lang_pred string, score string, h long, n_docs long"
SYLLABLES = {"aa": ["ka", "to", "mi", "ra", "nu"], "bb": ["sch", "ung", "ein", "ver", "ött"], "cc": ["ción", "ado", "que", "lla", "ñe"]}


def table(spark, rows):
    """rows: (doc_id, text, lang); extra columns have names that the operator uses inside."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2, 3) for r in rows], SCHEMA)


def word(r: random.Random, lang: str) -> str:
    return "".join(r.choices(SYLLABLES[lang], k=r.randrange(1, 5)))


def prose(r: random.Random, lang: str, n: int) -> str:
    return " ".join(word(r, lang) + r.choice(["", "", ",", ".", " 42"]) for _ in range(n))


def labelled(n: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    return [(k, prose(r, lang, r.randrange(1, 60)), lang) for k in range(n) for lang in [r.choice(["aa", "aa", "bb", "cc"])]]


def brute(scores: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, float]:
    """Posteriors and the logarithm of the sum over all labellings."""
    size, n = scores.shape
    total, by = 0.0, np.zeros((size, n))
    for path in itertools.product(range(n), repeat=size):
        w = np.exp(edges[0, path[0]] + sum(scores[t, y] for t, y in enumerate(path)) + sum(edges[1 + a, b] for a, b in itertools.pairwise(path)))
        total += w
        for t, y in enumerate(path):
            by[t, y] += w
    return by / total, float(np.log(total))


@pytest.mark.parametrize(("chunk", "few"), [(32, 12), (2, 12), (1, 12), (3, 12), (2, 0)])
def test_posteriors_are_those_of_all_labellings(monkeypatch, chunk, few):
    monkeypatch.setattr(L, "CHUNK", chunk)
    monkeypatch.setattr(L, "FEW", few)
    g = np.random.default_rng(chunk)
    lengths = np.array([1, 5, 7, 2, 6, 4])
    scores, edges = g.normal(size=(lengths.sum(), 3)) * 2, g.normal(size=(4, 3)) * 2
    got, at = L.posteriors(scores, lengths, edges), 0
    for n in lengths:
        assert np.allclose(got[at : at + n], brute(scores[at : at + n], edges)[0])
        at += n


def test_long_texts_keep_their_scale():
    g = np.random.default_rng(3)
    scores, edges = g.normal(size=(5000, 3)) * 30, np.eye(4, 3) * 9
    got = L.posteriors(scores, np.array([4990, 10]), edges)
    assert np.isfinite(got).all() and np.allclose(got.sum(axis=1), 1)


def test_gradient_is_that_of_the_likelihood():
    g = np.random.default_rng(5)
    scores, edges, gold, length = g.normal(size=(3, 4, 3)), g.normal(size=(4, 3)), g.integers(0, 3, (3, 4)), np.array([4, 1, 3])

    def value(s, e):
        out = 0.0
        for k, n in enumerate(length):
            y = gold[k, :n]
            out += e[0, y[0]] + s[k, range(n), y].sum() + sum(e[1 + a, b] for a, b in itertools.pairwise(y)) - brute(s[k, :n], e)[1]
        return out

    by_score, by_edge = L.gradient(scores, gold, length, edges)
    for x, grad in ((scores, by_score), (edges, by_edge)):
        for at in np.ndindex(x.shape):
            x[at] += 1e-5
            up = value(scores, edges)
            x[at] -= 2e-5
            down = value(scores, edges)
            x[at] += 1e-5
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def test_features_are_affixes_n_grams_and_the_lexicon():
    words = ["a", "abc", "ñandú"]
    where, value, who = L.features(words, {"abc": 4})
    for k, w in enumerate(words):
        grams = sum(max(0, len(w) - n + 1) for n in range(1, 4))
        assert (who == k).sum() == grams + 2 * min(3, len(w)) + 1
        assert np.isclose(value[who == k].sum(), 3)
    assert L.BUCKETS + 4 in where[who == 1] and L.BUCKETS in where[who == 0]


@pytest.fixture(scope="module")
def learnt(spark):
    return L.train(L.learnable(L.prepared(table(spark, labelled(500)))))


def test_code_switched_words_are_labelled(spark, learnt):
    """Words of held-out, mixed texts, whose syllables alone tell their language."""
    r, right, total = random.Random(9), 0, 0
    rows, gold = [], []
    for k in range(40):
        pieces = [(lang, prose(r, lang, r.randrange(3, 12))) for lang in r.sample(sorted(SYLLABLES), 3)]
        rows.append((k, " ".join(p for _, p in pieces), None))
        gold.append([(m.group(), lang) for lang, p in pieces for m in L.WORD.finditer(p)])
    got = {}
    for d in L.runs(table(spark, rows), learnt).collect():
        text = rows[d.doc_id][1]
        got.setdefault(d.doc_id, []).extend((d.start + m.start(), m.group(), d.lang) for m in L.WORD.finditer(text[d.start : d.end]))
    for k, want in enumerate(gold):
        mine = [(w, lang) for _, w, lang in sorted(got[k])]
        assert [w for w, _ in mine] == [w for w, _ in want]
        right, total = right + sum(a == b for a, b in zip(mine, want, strict=True)), total + len(want)
    assert right / total > 0.97


def test_transitions_favour_staying(learnt):
    assert learnt.langs == ["aa", "bb", "cc"]
    for k in range(3):
        assert learnt.edges[1 + k, k] == learnt.edges[1 + k].max()


def test_documents_of_unknown_words(spark, learnt):
    rows = labelled(200, seed=77)
    got = {r.doc_id: r for r in L.identify(L.prepared(table(spark, rows)), learnt, "doc_id", "held_out").collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())


def test_odd_texts(spark, learnt):
    rows = [(i, t, None) for i, t in ODD] + [(8, "12 34 _ ²", None), (9, "Ⅷ ١٢", None), (10, "q" * 100_000, None), (11, prose(random.Random(2), "bb", 30_000), None), (12, prose(random.Random(2), "cc", 50).upper(), None)]
    got = sorted(tuple(r) for r in L.identify(L.prepared(table(spark, rows)), learnt, "doc_id", "held_out").na.fill(-1, ["doc_id"]).collect())
    assert len(got) == len(rows)
    none = [r for r in got if r[2] == "und"]
    assert {r[0] for r in none} == {1, 2, 3, 8, 9} and all(r[3] == 0 for r in none)  # 8: two rows, one of them with letters
    assert {r[0]: r[2] for r in got if r[0] in (11, 12)} == {11: "bb", 12: "cc"}


def test_held_out_and_unlabelled_rows_are_not_learnt_from(spark):
    rows = labelled(120)
    other = [(i, "zz " * 50, "zz") for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2] + [(None, "yy yy", "yy"), (3, "ww", None), (5, None, "vv"), (7, "1 2", "uu")]
    model = L.train(L.learnable(L.prepared(table(spark, rows + other))))
    assert model.langs == ["aa", "bb", "cc"] and not {"zz", "yy", "ww"} & model.lexicon.keys()


def test_empty_tables_and_single_languages(spark):
    empty = L.prepared(table(spark, []))
    assert L.train(L.learnable(empty)) is None and L.identify(empty, None, "doc_id").collect() == []
    rows = [(0, "only words", "aa"), (1, "more words", None), (2, "?", "aa")]
    one = L.prepared(table(spark, rows))
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(one, L.train(L.learnable(one)), "doc_id").collect()}
    assert got == {0: ("aa", 1.0), 1: ("aa", 1.0), 2: ("und", 0.0)}
