import random
import re
from collections import Counter

from tradeweave.llm import quality
from tradeweave.llm.common import table

from ..oracle import SMALL
from .util import ODD, docs_of, words

W = re.compile(r"[^\x20\x09-\x0D]+")


def plainly(t):
    t = t or ""
    w = W.findall(t)
    lines = t.split("\n")
    dup = sum(bool(W.search(x)) and x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 3000 else None
    covered = {}
    for n in (5, *quality.LIMITS):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        seen, inside = Counter(grams), set()
        for i, g in enumerate(grams):
            if seen[g] > 1:
                inside.update(range(i, i + n))
        covered[n] = (len(inside), sum(len(w[i]) for i in inside))
    failed = len(w) < 10 or 100 * covered[5][0] > 20 * len(w)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": dup, "n_repeat_words": covered[5][0], "base_failed": failed} | {f"dup_chars_{n}": covered[n][1] for n in quality.LIMITS}


def noise(seed):
    r = random.Random(seed)
    return "".join(r.choice(["a", "b", "cc", "é", "#", "<"]) + r.choice([" ", " ", "\n", "\t", " \n", "\r\n"]) for _ in range(r.randrange(120)))


def test_measures(spark):
    small = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    rows = [*ODD, *((100 + i, noise(i)) for i in range(300)), *((10_000 + i, t) for i, t in small), (99, "same line of words here\n" * 500), (98, words(1, 400) + " " + words(1, 50))]
    got = quality.quality(docs_of(spark, rows), "doc_id").collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(plainly(t))
    for r in got:
        assert any(all(v is None or r[k] == v for k, v in w.items()) for w in want[r.doc_id]), r
        assert not (r.base_failed and r.kept)


def repeating(seed):
    """Words of which about a fifth repeat, so that verdicts fall on either side of each limit."""
    r = random.Random(seed)
    lines = [words(seed * 50 + i, r.randrange(3, 14)) for i in range(12)]
    return "\n".join(lines + r.sample(lines, r.randrange(5)) + [words(seed + 9, r.randrange(1, 80))])


def test_kept_by_plain_measures(spark):
    rows = [*((i, repeating(i)) for i in range(200)), *((1000 + i, noise(i)) for i in range(50)), (2000, None), (2001, "")]
    got = {r.doc_id: r.kept for r in quality.quality(docs_of(spark, rows), "doc_id").collect()}
    for i, t in rows:
        p, lines = plainly(t), (t or "").split("\n")
        again = sum(len("".join(W.findall(x))) for k, x in enumerate(lines) if x in lines[:k])
        over = again > quality.LINE_LIMIT * p["word_chars"] or any(p[f"dup_chars_{n}"] > limit * p["word_chars"] for n, limit in quality.LIMITS.items())
        assert got[i] == (not p["base_failed"] and not over), (i, t)
    assert 50 < sum(got.values()) < 200


def test_kept_drops_repetition_and_keeps_columns(spark):
    docs = docs_of(spark, [(1, words(1, 300)), (2, "buy it now at once friend " * 40), (3, None), (4, (words(2, 30) + "\n") * 2 + words(3, 60))])
    out = quality.kept(docs)
    assert out.schema == docs.schema
    assert {r.doc_id for r in out.collect()} == {1}


def test_clean_documents_stay(spark):
    docs = docs_of(spark, [(i, words(i, 200)) for i in range(50)])
    assert quality.kept(docs).count() == 50


def test_empty(spark):
    assert quality.quality(docs_of(spark, []), "doc_id").collect() == []
