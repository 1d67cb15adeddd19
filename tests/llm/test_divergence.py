from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import tradeweave.llm.divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, shard long, slot long, n long, total long"


def table(spark, rows):
    """rows: (text, lang, source); extra columns have names that the operator uses inside."""
    return spark.createDataFrame([(i, *r, 5, 6, 7, 8) for i, r in enumerate(rows)], SCHEMA)


def plain(rows) -> set[tuple]:
    """The audit by its definition, in Python integers."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", a or "", s or "") for t, a, s in rows):
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in docs[lang].items() if n >= 10]
        whole = sum((counts[lang, s] for s in sources), Counter())
        share = {s: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for w in kept} for s, c in [*((s, counts[lang, s]) for s in sources), (None, whole)]}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(f(share[s][w], share[o][w]) for w in kept), o) for o in sources if o != s]
            lead = [(f(share[s][w], share[None][w]), w) for w in kept if counts[lang, s][w] > 0 and share[s][w] > share[None][w]]
            for part, found, most in (("pair", pairs, None), ("term", lead, 10)):
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return out


def made(seed: int, n: int = 240) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = [r.choice(["word", "Wort", "é", "ßx", "ж", "Ünd", "\U0001f600"]) + chr(97 + k % 26) + chr(97 + k // 26) for k in range(120)]
    rows = []
    for _ in range(n):
        lang, source = r.choice(["en", "en", "de", None, "", "x\x00y"]), r.choice(["hot"] * 8 + ["b", None, "", "Z", "é"])
        text = r.choice(["{} {}", "{}\x00{}", "{}1{}", "{}_{}", "{}\n{}"]).format(" ".join(r.choices(vocabulary, k=r.randrange(30))), " ".join(r.choices(vocabulary[:20], k=9)))
        rows.append((r.choice([text, text.upper(), None, ""]) if r.random() < 0.3 else text, lang, source))
    return rows + rows[:20] * 4 + [("alone " * 3, "single", "s")] * 3 + [("rare", "few", "s"), ("rare", "few", "t"), (None, "few", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_is_the_plain_one(spark, seed):
    rows = made(seed)
    got = [tuple(r) for r in D.audit(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_small_shards_blocks_and_bins(spark, monkeypatch):
    rows = made(3)
    for k, v in {"SHARD": 7, "BROADCAST": 600, "BLOCK": 2}.items():
        monkeypatch.setattr(D, k, v)
    got = [tuple(r) for r in D.audit(table(spark, rows).repartition(5)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_empty_and_termless_tables(spark):
    assert D.audit(table(spark, [])).collect() == []
    got = D.audit(table(spark, [(None, None, None), ("12 34", "", "b"), ("few", "", "b")])).collect()
    assert {tuple(r) for r in got} == {("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)}


def test_perfect_hash_is_minimal_and_verified():
    words = [f"term{k}".encode() for k in range(5000)] + ["ж".encode(), b"a"]
    h = D.hashes(words)
    perfect = D.PerfectHash(words, h)
    slots = perfect.slots(words, h)
    assert sorted(slots) == list(range(len(words)))
    assert [perfect.word(k) for k in slots] == words
    others = [f"other{k}".encode() for k in range(5000)] + [b"", b"term"]
    assert (perfect.slots(others, D.hashes(others)) == -1).all()


def test_equal_hashes_are_listed():
    words, h = [b"x", b"y", b"z"], np.array([7, 7, 9], np.uint64)
    perfect = D.PerfectHash(words, h)
    assert sorted(perfect.slots(words, h)) == [0, 1, 2] and len(perfect.listed) == 2
    assert perfect.slots([b"q"], np.array([7], np.uint64)).tolist() == [-1]


def test_hash_is_that_of_spark(spark):
    words = [b"a", "été".encode(), b"x" * 100]
    got = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").selectExpr("xxhash64(w) h").collect()
    assert [r.h % 2**64 for r in got] == D.hashes(words).tolist()


def test_shares_are_exact():
    r = random.Random(5)
    for _ in range(200):
        total, kept = r.randrange(1, 10**13), r.randrange(1, 10**9)
        n = [r.randrange(total + 1) for _ in range(5)]
        assert D.shares(np.array(n), total, kept).tolist() == [1 + 10**9 * (x + 2) // (total + 2 * kept) for x in n]
