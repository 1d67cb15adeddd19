"""Near-duplicates and decontamination against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeweave.llm import decontaminate, neardup
from tradeweave.llm.common import table

from ..oracle import SMALL
from .util import ODD, docs_of, words


def simple(t):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", t or "").strip().translate({c: c + 32 for c in range(65, 91)})


def shingles(t):
    w = simple(t).split(" ") if simple(t) else []
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def classes(pairs, items):
    up = {i: i for i in items}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in items}


def edited(text, seed, share):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), int(len(w) * share)):
        w[i] = f"z{r.randrange(10**6)}"
    return " ".join(w)


def groups():
    rows, k = [], 0
    for g in range(60):
        text = words(1000 + g, 60 + 10 * g)
        for c in range(1 + g % 5):
            rows.append((k, text if c % 2 else edited(text, k, 0.01 if c else 0)))
            k += 1
    for c in range(150):  # a large group of near copies
        rows.append((k, edited(words(7, 400), k, 0.008)))
        k += 1
    return rows + [(k + i, words(5000 + i, 50)) for i in range(100)]


def brute(rows):
    sh = {i: shingles(t) for i, t in rows}
    byword = defaultdict(set)
    for i, s in sh.items():
        for x in s:
            byword[x].add(i)
    out = set()
    for i, s in sh.items():
        for j in {j for x in s for j in byword[x] if j > i}:
            both = sum((s & sh[j]).values())
            if both >= 0.8 * (s.total() + sh[j].total() - both):
                out.add((i, j))
    empty = sorted(i for i, s in sh.items() if not s)
    return out | {(empty[0], i) for i in empty[1:]}


@pytest.mark.parametrize("rows", [groups(), None])
def test_classes_are_those_of_brute_force(spark, rows):
    rows = rows or [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    pairs = brute(rows)
    want = classes([p for p in pairs], [i for i, _ in rows])
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert set(got) == {i for i, _ in rows}
    text = dict(rows)
    linked = [(a, b) for a, b in pairs if (text[a] or "") and (text[b] or "")]
    found = sum(got[a] == got[b] for a, b in linked)
    assert found >= 0.97 * len(linked), (found, len(linked))
    wrong = [i for i in got if got[i] != i and want[got[i]] != want[i]]
    assert len(wrong) <= 0.01 * len(rows), wrong[:5]  # weights of idf below 1 may move a pair at the threshold


def test_samples_of_very_long_texts_differ():
    r = np.random.default_rng(1)
    a, b = (np.sort(r.integers(0, 2**64, 1_000_000, dtype=np.uint64)) for _ in range(2))
    assert (neardup.samples(a, np.ones(len(a))) == neardup.samples(b, np.ones(len(b)))).mean() < 0.05


def test_samples_agree_as_weights_do():
    r, same, want = np.random.default_rng(2), [], []
    for _ in range(100):
        h, a = np.sort(r.integers(0, 2**64, 300, dtype=np.uint64)), r.choice([1, 1, 0.8, 2, 3], 300)
        b = np.where(r.random(300) < 0.6, a, r.choice([1, 0.8, 2, 3], 300))
        same.append((neardup.samples(h, a) == neardup.samples(h, b)).mean())
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(same) - np.mean(want)) < 0.02


def test_often_repeated_words_count_as_often_as_they_occur(spark):
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.near_duplicates(docs_of(spark, [(1, "a " * 130_000), (2, "a " * 65_000), (3, "a " * 110_000)])).collect()}
    assert got[1][0] == got[3][0] == 1 and got[2] == (2, 0)


@pytest.mark.parametrize(("common", "linked"), [(7999, False), (8000, True), (8001, True)])
def test_the_check_is_exact(spark, common, linked):
    """Two arrays of 10000 hashes in all, of which so many are common; hashes that differ in their low halves alone are unlike."""
    h = np.arange(10_000, dtype=np.uint64) + (np.uint64(1) << np.uint64(40))
    own = (10_000 - common) // 2
    a, b = h[: common + own], np.concatenate((h[:common], h[common + own :]))
    rows = [(bytearray(k), *map(bytearray, neardup.packed(x, np.ones(len(x))))) for k, x in ((b"a", a), (b"b", b))]
    arrays = spark.createDataFrame(rows, "node binary, h binary, w binary")
    pairs = spark.createDataFrame([(bytearray(b"b"), bytearray(b"a"), 7)], "node binary, leader binary, more int")
    assert neardup.verified(pairs, arrays).count() == linked


@pytest.mark.parametrize("held", [neardup.HELD, 2000])
def test_pairs_are_checked_in_groups_of_leaders(spark, monkeypatch, held):
    monkeypatch.setattr(neardup, "HELD", held)
    r = np.random.default_rng(3)
    base = np.sort(r.integers(0, 2**64, 60, dtype=np.uint64))
    sets = [np.sort(np.concatenate((base[: 60 - k % 13], r.integers(0, 2**64, k % 13, dtype=np.uint64)))) for k in range(40)]
    arrays = spark.createDataFrame([(bytearray([k]), *map(bytearray, neardup.packed(x, np.ones(len(x))))) for k, x in enumerate(sets)], "node binary, h binary, w binary")
    pairs = [(bytearray([i]), bytearray([j]), f"{i}-{j}") for i in range(40) for j in range(0, 40, 3) if i != j]
    got = {x.name for x in neardup.verified(spark.createDataFrame(pairs, "node binary, leader binary, name string"), arrays).collect()}
    want = {name for a, b, name in pairs if neardup.similarity((sets[a[0]], np.ones(60)), (sets[b[0]], np.ones(60))) >= 0.8}
    assert got == want and 0 < len(want) < len(pairs)


def test_packing_keeps_weights():
    h, w = np.array([1, 5, 2**63 + 1], np.uint64), np.array([1, 0.7512345678901, 130_000.25])
    a, b = neardup.unpacked(*neardup.packed(h, w))
    assert (a == h).all() and (b == w).all()


def test_pairs_among_refused_nodes_are_found(spark):
    """Forms just under the similarity, some of which have a twin above it."""
    form, rows = words(9, 350), []
    for g in range(300):
        own = [f"own{g}x{i}" for i in range(12)]
        for c in range(1 + (g % 3 == 0)):
            rows.append((2 * g + c, " ".join([form, *own, *(f"rest{g}x{c}x{i}" for i in range(24))])))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    twins = [i for i in got if i % 2]
    assert len(twins) == 100 and sum(got[i] == got[i - 1] for i in twins) >= 99
    assert all(got[i] == i for i in got if i % 6 in (2, 4))


def test_what_texts_share_with_no_other_bounds_their_similarity(spark):
    """Forms of one text with edits of their own can't be similar to others and are left out; no similar pair is."""
    r = np.random.default_rng(5)
    base, sets = np.sort(r.integers(0, 2**64, 200, dtype=np.uint64)), []
    for k in range(60):
        edits = int(r.integers(0, 70))
        one = np.sort(np.concatenate((r.permutation(base)[edits:], r.integers(0, 2**64, edits, dtype=np.uint64))))
        sets += [one] if k % 5 else [one, np.sort(np.concatenate((one[8:], r.integers(0, 2**64, 8, dtype=np.uint64))))]
    ws = [np.where(r.random(200) < 0.3, 0.8, 1.0) for _ in sets]
    arrays = spark.createDataFrame([(bytearray([k]), *map(bytearray, neardup.packed(x, w)), float(w.sum())) for k, (x, w) in enumerate(zip(sets, ws, strict=True))], "node binary, h binary, w binary, total double")
    got = {x.node[0]: (x.total, x.common) for x in neardup.shareable(arrays.select("node"), arrays, neardup.Scratch(spark, "test")).collect()}
    df = Counter(h for x in sets for h in x.tolist())
    for k, (x, w) in enumerate(zip(sets, ws, strict=True)):
        assert got[k] == pytest.approx((w.sum(), sum(v for h, v in zip(x.tolist(), w, strict=True) if df[h] > 1)))
    can = lambda c, t: 1.8 * c >= 0.8 * t * (1 - 1e-9)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if neardup.similarity((sets[i], ws[i]), (sets[j], ws[j])) >= 0.8]
    assert pairs and all(can(min(got[i][1], got[j][1]), got[i][0] + got[j][0]) for i, j in pairs)
    assert all(can(got[i][1], got[i][0] + got[i][1]) for p in pairs for i in p)
    assert sum(not can(c, t + c) for t, c in got.values()) >= 10


def test_two_large_classes_of_a_bucket_meet_in_few_rounds(spark, monkeypatch):
    made, keep = Counter(), neardup.Scratch.keep
    pairs = set()

    def counted(self, df, name):
        out = keep(self, df, name)
        if name.startswith("fresh"):
            made["rounds"] += 1
            pairs.update((bytes(x.a), bytes(x.b)) for x in out.select("a", "b").collect())
        return out

    monkeypatch.setattr(neardup.Scratch, "keep", counted)
    sets = [np.arange(50, dtype=np.uint64) + np.uint64(1000 * (k % 2)) for k in range(50)]
    names = [bytearray([k]) for k in range(50)]
    arrays = spark.createDataFrame([(n, *map(bytearray, neardup.packed(x, np.ones(50))), 50.0) for n, x in zip(names, sets, strict=True)], "node binary, h binary, w binary, total double")
    open_ = spark.createDataFrame([(7, 1, n, names[k % 2], *[0] * len([*neardup.PRINT, *neardup.BAND]), 50.0, 50.0) for k, n in enumerate(names)], "bucket long, band int, node binary, class binary, " + ", ".join(f"{p} long" for p in [*neardup.PRINT, *neardup.BAND]) + ", total double, common double")
    assert neardup.rest(open_, arrays, neardup.Scratch(spark, "test")) is None
    assert pairs == {(bytes([max(i, j)]), bytes([min(i, j)])) for i in range(0, 50, 2) for j in range(1, 50, 2)}
    assert made["rounds"] <= 5


def test_rows_that_are_wanted_are_found_by_their_bits(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "md5(cast(id as string)) row")
    wanted = rows.where("id % 7 = 3").select("row")
    for most in (neardup.BITS, 1):  # one word: nearly all bits are set
        monkeypatch.setattr(neardup, "BITS", most)
        got = neardup.among(rows, wanted, "row")
        assert got.columns == rows.columns and sorted(x.id for x in got.collect()) == list(range(3, 3000, 7))
    assert neardup.among(rows, wanted.where("false"), "row").collect() == []
    monkeypatch.undo()
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = neardup.among(rows, wanted, "row")._jdf.queryExecution().executedPlan().toString()
        assert 0 <= plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning(row") < plan.index("BroadcastHashJoin")  # rows are dealt after the bits
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_odd_rows(spark):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.n_links) for r in neardup.near_duplicates(docs_of(spark, ODD)).collect())
    assert len(got) == len(ODD)
    by = {d: c for d, c, _ in got}
    assert by[1] == by[2] == 1 and by[4] == by[5] == 4 and by[7] == 7
    assert neardup.near_duplicates(docs_of(spark, [])).collect() == []


def test_one_of_each(spark):
    docs = docs_of(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, words(3, 40)), (None, words(4, 40))])
    out = neardup.one_of_each(docs)
    assert out.schema == docs.schema
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 3]


def test_one_of_each_keeps_classes_that_share_an_id(spark):
    rows = [(None, words(1, 40)), (None, words(2, 40)), (None, words(2, 40)), (5, words(3, 40)), (5, words(4, 40)), (5, words(4, 40)), (6, words(4, 40)), (7, edited(words(5, 400), 1, 0.008)), (None, words(5, 400))]
    out = neardup.one_of_each(docs_of(spark, rows))
    assert out.columns == docs_of(spark, rows).columns
    want = [(None, words(1, 40)), (None, words(2, 40)), (5, words(3, 40)), (5, words(4, 40)), (7, rows[7][1])]
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted((i or 0, t) for i, t in want)


def benchmark_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def typo(text, seed, n):
    r, s = random.Random(seed), list(text)
    for _ in range(n):
        i = r.randrange(len(s))
        s[i : i + r.randrange(2)] = r.choice(["q", "", "zz"])
    return "".join(s)


def test_passages_are_found_and_clean_texts_left_alone(spark):
    items = [(i, words(20_000 + i, 40)) for i in range(30)] + [(100, None), (101, ""), (102, "short"), (103, words(20_003, 40))]
    docs = [(i, words(i, 200) + " " + typo(items[i % 30][1], i, i % 3) + " " + words(i + 1, 100)) for i in range(60)]
    docs += [(1000 + i, words(30_000 + i, 300)) for i in range(100)] + [(2000, items[5][1].upper().replace(" ", ",\n")), (2001, words(1, 60_000) + items[7][1])] + [(i and 3000 + i, t) for i, t in ODD if i != 7]
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs_of(spark, docs), benchmark_of(spark, items)).collect()}
    want = {(i, i % 30) for i in range(60)} | {(2000, 5), (2001, 7)}
    want |= {(d, 103) for d, i in want if i == 3}
    assert found == want
    left = decontaminate.clean(docs_of(spark, docs), benchmark_of(spark, items))
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(i for i, _ in docs if i not in {d for d, _ in want} and i is not None)


def edit_distance(p, t):
    """Fewest edits of p to a part of t."""
    d = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        e = [i]
        for j, x in enumerate(t, 1):
            e.append(min(d[j - 1] + (c != x), d[j] + 1, e[-1] + 1))
        d = e
    return min(d)


def test_search_is_brute_force(spark):
    items = [(i, words(40_000 + i, 25)) for i in range(4)]
    index = decontaminate.Index(items)
    for seed in range(40):
        r = random.Random(seed)
        data = decontaminate.plain(words(seed, 20) + " " + typo(items[seed % 4][1], seed, r.randrange(9)) + " " + words(seed + 9, 20))
        got = {s: e for s, _, e in sorted(index.search(data), key=lambda x: -x[2])}
        want = {s: e for s, p in enumerate(index.text) if (e := edit_distance(p, data)) <= index.edits[s]}
        assert got == want


def test_nothing_to_look_for(spark):
    docs, none = docs_of(spark, ODD), benchmark_of(spark, [])
    assert decontaminate.matches(docs, none).collect() == []
    assert decontaminate.clean(docs, none).count() == len(ODD)
    assert decontaminate.matches(docs_of(spark, []), benchmark_of(spark, [(1, words(1, 40))])).collect() == []


def unbroadcast(spark, make):
    """The plan of make() where no table is small enough to be broadcast unasked."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_sifting_keeps_all_that_is_wanted_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("id", "md5(cast(id as string)) row")
    got = {x.id for x in neardup.sifted(rows, rows.where("id % 50 = 3").select("row"), "row").collect()}
    want = set(range(3, 20_000, 50))
    assert want <= got and len(got - want) < 600  # 1.4 % are expected; one bit for eight would leave 12 %


def test_arrays_are_dealt_out_once(spark, monkeypatch):
    """Pairs that arrays know of need no join, what nodes share needs only their shingles, and texts are dealt by row alone."""
    r = np.random.default_rng(4)
    base = np.sort(r.integers(0, 2**64, 60, dtype=np.uint64))
    sets = [np.sort(np.concatenate((base[: 60 - k % 13], r.integers(0, 2**64, k % 13, dtype=np.uint64)))) for k in range(40)]
    pairs = spark.createDataFrame([(bytearray([i]), bytearray([j]), f"{i}-{j}") for i in range(40) for j in range(0, 40, 3) if i != j], "node binary, leader binary, name string")
    arrays = spark.createDataFrame([(bytearray([k]), *map(bytearray, neardup.packed(x, np.ones(len(x)))), 60.0) for k, x in enumerate(sets)], "node binary, h binary, w binary, total double")
    of = pairs.groupBy("node").agg(F.collect_list("leader").alias("of"))
    salts = pairs.select(F.col("leader").alias("of"), neardup.salt_of("node").alias("salt")).groupBy(F.col("of").alias("node")).agg(F.collect_set("salt").alias("salts"))
    known = neardup.Scratch(spark, "test").keep(arrays.join(of, "node", "left").join(salts, "node", "left"), "known")
    one, other = ({x.name for x in neardup.verified(pairs, *a).collect()} for a in ((arrays,), (known, True)))
    assert one == other and one
    assert "Join" not in unbroadcast(spark, lambda: neardup.verified(pairs, known, True))
    written, keep = [], neardup.Scratch.keep
    monkeypatch.setattr(neardup.Scratch, "keep", lambda self, df, name: written.append(df.columns) or keep(self, df, name))
    assert neardup.shareable(known.select("node"), known, neardup.Scratch(spark, "test")).count() == 40
    assert written == [["node"]]  # no array
    rows = spark.range(300).selectExpr("id", "md5(cast(id as string)) row", "cast(id as string) text")
    wanted = rows.where("id % 7 = 3").select("row", F.array("id").alias("of"))
    plan = unbroadcast(spark, lambda: neardup.among(rows, wanted, "row").dropDuplicates(["row"]))
    assert plan.count("Exchange hashpartitioning(row") == 2  # of texts, and of what is wanted
