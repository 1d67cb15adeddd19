"""Source divergence audit: how far the term distributions of sources of one language lie apart, recounted through perfect hashes.

1. The first pass counts documents by (lang, term), in the task and then by shuffle; the exact filter keeps terms of DOCS or more.
2. Kept terms are dealt into shards of about SHARD terms. Each shard gets a minimal perfect hash (levels of bit arrays: a
   term sits at the first level where no other of the shard meets it; its slot is the rank of that bit) and stores its
   terms in slot order.
3. Shards are broadcast in bins of at most BROADCAST bytes. For each bin a second pass looks terms up, compares them with
   the stored term, and adds to a dense array for each (lang, source, shard); arrays go out when they reach DENSE bytes.
4. For each shard and two blocks of sources, integer arithmetic gives the divergence of all pairs and the leading terms.

Null text, lang and source count as ''. A group without terms has the smoothed shares of no counts; a language without kept
terms has pairs of value 0 and no terms; a language with one source has no pairs. Repeated rows count as often as they
occur. Ties are ranked by item, bytewise. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, own, parts, ship, table

#: Fixed values of the measure.
DOCS, SMOOTH, SCALE_STEPS, TOP = 10, 2, 3, 10
#: Terms of a shard, bytes of a broadcast, entries and bytes a task holds, sources of a block.
SHARD, BROADCAST, ENTRIES, DENSE, BLOCK = 32_768, 48_000_000, 400_000, 64_000_000, 48
#: Levels of a perfect hash; terms that meet at all of them (equal hashes) are listed beside it.
LEVELS, SPARE, SEED = 40, 1.5, 42
#: Bytes of terms, letters in lower case; all others part terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    """XXH64, as Spark's xxhash64 of the same bytes."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))


def _at(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """slots(words, h): the slot of each stored term, -1 for all others. Slots are 0 to n - 1."""

    def __init__(self, words: list[bytes], h: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        slot, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        while len(left) and len(self.levels) < LEVELS:
            size = max(64, int(SPARE * len(left)))
            at = _at(h[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(-(-size // 64), np.uint64)
            np.bitwise_or.at(bits, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            before = base + np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))[:-1]
            self.levels.append((size, bits, before))
            slot[left[alone]] = self._rank(bits, before, at[alone])
            base, left = base + int(alone.sum()), left[~alone]
        self.listed = {words[i]: base + k for k, i in enumerate(left)}
        slot[left] = base + np.arange(len(left))
        order = np.argsort(slot)
        self.words = b"".join([words[i] for i in order])
        self.ends = np.cumsum([len(words[i]) for i in order], dtype=np.int64)

    def __len__(self) -> int:
        return len(self.ends)

    @staticmethod
    def _rank(bits: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(bits[at >> 6] & below)

    def word(self, slot: int) -> bytes:
        return self.words[self.ends[slot - 1] if slot else 0 : self.ends[slot]]

    def slots(self, words: list[bytes], h: np.ndarray) -> np.ndarray:
        out, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for k, (size, bits, before) in enumerate(self.levels):
            at = _at(h[left], k, size)
            hit = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[hit]] = self._rank(bits, before, at[hit])
            left = left[~hit]
            if not len(left):
                break
        found = np.flatnonzero(out >= 0)
        out[found[~self._stored([words[i] for i in found], out[found])]] = -1
        if self.listed:
            for i in np.flatnonzero(out < 0):
                out[i] = self.listed.get(words[i], -1)
        return out

    def _stored(self, words: list[bytes], slot: np.ndarray) -> np.ndarray:
        """Whether each word is the one stored in its slot."""
        begins = np.where(slot > 0, self.ends[slot - 1], 0)
        size = np.fromiter(map(len, words), np.int64, len(words))
        same = self.ends[slot] - begins == size
        if not same.any():
            return same
        mine = np.frombuffer(b"".join([w for w, s in zip(words, same.tolist(), strict=True) if s]), np.uint8)
        size, first = size[same], np.concatenate(([0], np.cumsum(size[same])))[:-1]
        there = np.frombuffer(self.words, np.uint8)[np.arange(len(mine)) + np.repeat(begins[same] - first, size)]
        same[same] = np.bitwise_and.reduceat(mine == there, first)
        return same


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n): of each task, in how many of its documents of lang the term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(c)), pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], names=["lang", "term", "n"])
            seen.clear()

        held = 0
        for batch in parts(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = seen.setdefault(lang, Counter())
                held -= len(c)
                c.update(set(terms(text)))
                held += len(c)
                if held > ENTRIES:
                    yield from out()
                    held = 0
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, term binary, n long")


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term) in DOCS documents of lang or more; exact."""
    return document_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= DOCS).select("lang", "term")


def perfect_hashes(kept: DataFrame, partitions: int) -> DataFrame:
    """(lang, shard, shards, n, data): a pickled PerfectHash for each shard of the kept terms."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD).cast("long").alias("shards"))
    dealt = kept.join(sizes, "lang").withColumn("shard", F.shiftrightunsigned(F.xxhash64("term"), 33) % F.col("shards"))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        words = sorted(rows.column("term").to_pylist())
        data = pickle.dumps(PerfectHash(words, hashes(words)), 5)
        return pa.table({"lang": [key[0].as_py()], "shard": [key[1].as_py()], "shards": [rows.column("shards")[0].as_py()], "n": pa.array([len(words)], pa.int64()), "data": pa.array([data], pa.binary())})

    return dealt.repartition(partitions, "lang", "shard").groupBy("lang", "shard").applyInArrow(build, "lang string, shard long, shards long, n long, data binary")


def recount(docs: DataFrame, shards: list) -> DataFrame:
    """(lang, source, shard, slot, n): of each task, how often the terms of the given shards occur in documents of the group."""
    index: dict[str, tuple[int, dict[int, bytes]]] = {}
    for r in shards:
        index.setdefault(r.lang, (r.shards, {}))[1][r.shard] = bytes(r.data)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {lang: (count, {k: pickle.loads(d) for k, d in of.items()}) for lang, (count, of) in sent.value.items()}
        seen: dict[tuple[str, str], Counter] = {}
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def resolve() -> None:
            for (lang, source), c in seen.items():
                count, of = own[lang]
                words, n = list(c), np.fromiter(c.values(), np.int64, len(c))
                h = hashes(words)
                shard = ((h >> np.uint64(33)) % np.uint64(count)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(count + 1))
                for k, perfect in of.items():
                    part = order[cuts[k] : cuts[k + 1]]
                    if len(part):
                        slot = perfect.slots([words[i] for i in part], h[part])
                        if (slot >= 0).any():
                            if (lang, source, k) not in dense:
                                dense[lang, source, k] = np.zeros(len(perfect), np.int64)
                            dense[lang, source, k][slot[slot >= 0]] += n[part[slot >= 0]]  # terms are distinct, and so are their slots
            seen.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source, k), a in dense.items():
                at = np.flatnonzero(a)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(at)), pa.repeat(source, len(at)), pa.repeat(pa.scalar(k, pa.int64()), len(at)), pa.array(at, pa.int64()), pa.array(a[at], pa.int64())], names=["lang", "source", "shard", "slot", "n"])
            dense.clear()

        held = 0
        for batch in parts(batches):
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if lang in own:
                    c = seen.setdefault((lang, source), Counter())
                    held -= len(c)
                    c.update(terms(text))
                    held += len(c)
                    if held > ENTRIES:
                        resolve()
                        held = 0
                        if sum(a.nbytes for a in dense.values()) > DENSE:
                            yield from out()
        resolve()
        yield from out()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, shard long, slot long, n long")


def shares(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(1000000000 * (n + 2) / (total + 2 * kept)), by long division in steps of 1000, exact below 9e15 occurrences."""
    rest, by, out = n.astype(np.int64) + SMOOTH, np.int64(total + SMOOTH * kept), np.zeros(len(n), np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        digit = rest // by
        rest -= digit * by
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


FOUND = "lang string, source string, part string, item string, value long"


def compare(key: tuple, rows: pa.Table) -> pa.Table:
    """Of one shard: the divergence of each pair of sources of two blocks (of one block: also the leading terms)."""
    lang, first, second = key[0].as_py(), key[2].as_py(), key[3].as_py()
    words, members, q, size = None, {first: [], second: []}, None, rows.column("size")[0].as_py()
    for r in rows.to_pylist():
        p = np.full(size, shares(np.zeros(1, np.int64), r["total"], r["kept"])[0], np.int64)
        at = np.array(r["slots"] or [], np.int64)
        p[at] = shares(np.array(r["counts"] or [], np.int64), r["total"], r["kept"])
        if r["source"] is None:
            q, words = p, pickle.loads(r["data"])
        else:
            members[r["block"]].append((r["source"], p, at))
    out: list[tuple[str, str, str, int]] = []
    for i, (a, p, _) in enumerate(members[first]):
        for b, o, _ in members[second][i + 1 if first == second else 0 :]:
            value = int(apart(p, o).sum())
            out += [(a, "pair", b, value), (b, "pair", a, value)]
    if first == second:
        for a, p, at in members[first]:
            at = at[p[at] > q[at]]
            value = apart(p[at], q[at])
            if len(at) > TOP:
                lead = value >= np.partition(value, len(value) - TOP)[len(value) - TOP]
                at, value = at[lead], value[lead]
            best = sorted(zip((-value).tolist(), (words.word(k) for k in at.tolist()), strict=True))[:TOP]
            out += [(a, "term", w.decode(), -v) for v, w in best]
    source, part, item, value = map(list, zip(*out)) if out else ([], [], [], [])
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for documents (lang, source, text)."""
    spark = docs.sparkSession
    ship(spark)
    work, partitions = Scratch(spark, "divergence"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = own(docs, "lang", "source", "text").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("string").cast("binary").alias("text"))
    groups = work.keep(docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs")), "groups").select("lang", "source")
    shards = work.keep(perfect_hashes(work.keep(kept_terms(docs), "kept"), partitions), "shards")

    found = shards.select(F.length("data").alias("b"), "lang", "shard")
    total, largest = found.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.max("b"), F.lit(0))).first()
    bins = -(-total // BROADCAST)
    place = lambda n: F.pmod(F.xxhash64("lang", "shard"), F.lit(n))
    while bins > 1 and found.groupBy(place(bins).alias("bin")).agg(F.sum("b").alias("b")).agg(F.max("b")).first()[0] > max(BROADCAST, largest):
        bins += 1
    counts = None
    for k in range(bins):
        part = recount(docs, shards.where(place(bins) == k).collect())
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        counts = spark.createDataFrame([], "lang string, source string, shard long, slot long, n long")

    counts = counts.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("slot", "n")))
    vectors = work.keep(counts.groupBy("lang", "source", "shard").agg(listed.alias("v"), F.sum("n").alias("own")), "vectors")
    each = vectors.select("lang", "shard", F.explode("v").alias("x")).groupBy("lang", "shard", "x.slot").agg(F.sum("x.n").alias("n"))
    whole = work.keep(each.groupBy("lang", "shard").agg(listed.alias("v"), F.sum("n").alias("own")), "whole")

    of_lang = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")).join(shards.groupBy("lang").agg(F.sum("n").alias("kept")), "lang", "left")
    sized = groups.join(vectors.groupBy("lang", "source").agg(F.sum("own").alias("total")), ["lang", "source"], "left").join(of_lang, "lang")
    sized = sized.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), "blocks", F.pmod(F.xxhash64("source"), "blocks").alias("block"))
    vector = (F.col("v.slot").alias("slots"), F.col("v.n").alias("counts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")
    sources = sized.where("kept > 0").join(shards.select("lang", "shard", F.col("n").alias("size")), "lang").join(vectors.drop("own"), ["lang", "source", "shard"], "left")
    sources = sources.select("lang", "shard", "source", "block", "size", "total", "kept", *vector, F.lit(None).cast("binary").alias("data"), other)
    lead = shards.select("lang", "shard", F.col("n").alias("size"), "data").join(whole.drop("own"), ["lang", "shard"], "left").join(whole.groupBy("lang").agg(F.sum("own").alias("total")), "lang").join(of_lang, "lang")
    lead = lead.select("lang", "shard", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("block"), "size", "total", "kept", *vector, "data", other)
    first, second = F.least(F.coalesce("block", "o"), "o").alias("first"), F.greatest(F.coalesce("block", "o"), "o").alias("second")
    dealt = sources.unionByName(lead).select("*", first, second).drop("o")
    parted = dealt.repartition(partitions, "lang", "shard", "first", "second").groupBy("lang", "shard", "first", "second").applyInArrow(compare, FOUND)
    parted = work.keep(parted, "parted")

    pairs = parted.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    none = sized.where("kept = 0").select("lang", "source")
    nothing = none.join(none.withColumnRenamed("source", "item"), "lang").where("source != item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")).alias("rank")
    ranked = pairs.unionByName(nothing).select("*", rank).unionByName(parted.where("part = 'term'").select("*", rank).where(F.col("rank") <= TOP))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as raw from d),
t as (select i, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from w),
kept as (select lang, term from t group by all having count(distinct i) >= 10),
v as (select lang, count(*) as v from kept group by all),
g as (select lang, source, coalesce(v, 0) as v from (select distinct lang, source from d) left join v using (lang)),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
gn as (select lang, source, v, coalesce(sum(n), 0)::hugeint as total from g left join c using (lang, source) group by all),
ln as (select lang, v, sum(total) as total from gn group by all),
p as (select lang, source, term, coalesce(n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 2) // (total + 2 * v) as p from gn join kept using (lang) left join c using (lang, source, term)),
q as (select lang, term, 1 + 1000000000::hugeint * (s + 2) // (total + 2 * v) as q from (select lang, term, sum(n) as s from c group by all) join ln using (lang)),
pair as (select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
term as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, item) as rank from pair
    union all by name select *, 'term' as part, row_number() over (partition by lang, source order by value desc, item) as rank from term qualify rank <= 10)
select lang, source, part, item, value::bigint as value, rank::int as rank from r"""
