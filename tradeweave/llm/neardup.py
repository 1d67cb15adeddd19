"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies. Two rows of counters, whose width depends on the mean length of a text alone, are added up over all
   documents: each distinct shingle of a text adds one to its counter in each row. The sums are whole numbers, so they are the
   same however the rows are dealt out. A shingle's frequency is the lesser of its two counters: never too low, too high
   by at most about a quarter of THETA. idf is ln(N / df) / ln(1 / THETA), at most 1; weight is tf (1 - IDF + IDF idf). IDF is a
   quarter, not 1, as a large group of near copies makes its own shingles frequent: with the whole of idf their few edits would
   outweigh all that they share.
2. Sketches. A shingle of weight w gets for each of BANDS * ROWS samples, from its whole 64-bit hash, r, c ~ Gamma(2, 1) and
   b ~ U(0, 1); t = floor(ln w / r + b); ln a = ln c - r (t - b) - r; the least ln a is the sample (Ioffe 2010). Two texts
   agree in a sample with the probability of their weighted Jaccard similarity. With weight 1 (rare, once in its text: most
   shingles) t is 0 and a is Exp(1). So a of weight 1 is drawn first, and c, r and b in their law given it: c = a + Exp(1),
   r = ln(c / a) + g and b = g / r with g ~ Exp(1), whence ln a = ln a(1) - r t. Weight 1 then needs one product a sample.
3. Bands. Equal texts are one node. Nodes that agree in all ROWS samples of a band share a bucket. Each node of a bucket is
   compared with the bucket's leader: the node whose buckets are largest, as that is the one from which the others were copied.
4. Rest. In buckets that hold more than one class after that, leaders of unlike classes are compared with all nodes of other
   classes, round by round with eight times as many leaders, until each bucket holds one class or all its nodes have led. A pair is
   made in one bucket, that of the second lowest band it shares by sixteen bits of their keys (which miss one pair of some 20 000).
   So such pairs of texts that share two bands, and whose sketches agree in AGREE samples or more, are checked unless they are in one
   class already, or can't be similar: what two texts share is at most what either shares with any node of these buckets
   (`shareable`), which is exact and leaves out forms of one text whose edits are all their own. Two texts at the threshold share two
   bands with a probability of 0.993 and agree in so many samples with 0.997; at 0.85 both hold with 0.999.
5. Check. Pairs are verified on the shingles of whole texts: weighted Jaccard similarity of SIMILARITY or more.
6. Classes. Connected components of verified links, by alternating large and small stars; class_id is the least doc_id.

Pairs of a group of copies are as many as its nodes, as one class needs no further pair; only unlike texts that agree in two bands
and share enough with others are all compared, by leaders. A node has a row for each of its bands at most. Hot keys: rows of the fewer than a thousand hot nodes and buckets stay in their tasks, what is
broadcast to them has fewer rows than that; leaders' shingles meet their pairs in SALTS parts. No link, component or sketch goes
to the driver; every step is a written table, so lost executors cost only their tasks.

Null and empty texts are equal texts, without shingles. Texts of fewer than WORDS words have one shingle, of all of them.
Rows with one doc_id are rows of their own and get the class of their text; a null doc_id is never a class_id unless all of
a class are null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import Scratch, map_rows, meet, own, parts, release, ship, table
from .decontaminate import plain
from .quality import mix

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4
#: Share of documents from which on a shingle's idf falls below 1; how much of a weight is idf.
THETA, IDF = 0.01, 0.25
#: Bits of the width of a row of counters: at least, at most.
COUNTERS = (18, 22)
#: Leaders at once in the first round among unlike nodes; how many times more in each round after.
SLOTS, MORE = 8, 8
#: Rounds in which a class has one leader of a bucket; then, as two large classes would take a round a node, any node can be one.
BY_CLASS = 2
#: Samples, of BANDS * ROWS, in which sketches have to agree before texts are compared (by four bits of each).
AGREE = 37
#: Parts of the pairs of leaders that are checked together; bytes of the arrays of such leaders.
SALTS, HELD = 32, 32_000_000
#: Numbers of 64 bits, at most, that say which rows may be wanted.
BITS = 1 << 17
#: Shingles sampled at once: bounds memory for very long texts.
AT_ONCE = 1 << 12
#: Plain bytes whose words are hashed at once.
BLOCK = 1 << 18
PRINTS = -(-BANDS * ROWS // 16)
_C, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit value for each byte; powers of an odd number and of its inverse."""
    byte = mix(np.arange(256, dtype=np.uint64) << np.uint64(20))
    inverse = np.uint64(pow(int(_B), -1, 1 << 64))
    return byte, *(np.concatenate(([np.uint64(1)], np.cumprod(np.full(BLOCK, b, np.uint64)))) for b in (_B, inverse))


def _words_of(data: bytes) -> np.ndarray:
    """A hash of each word of plain bytes (single spaces between words): sums of byte values times powers, from prefix sums."""
    b = np.frombuffer(data, np.uint8)
    byte, power, inverse = _powers()
    if len(b) > BLOCK:  # one very long word
        power, inverse = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(b), x[1], np.uint64)))) for x in (power, inverse))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(byte[b] * power[: len(b)], out=sums[1:])
    space = np.flatnonzero(b == 32)
    first, end = np.concatenate(([0], space + 1)), np.append(space, len(b))
    return mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > BLOCK:
            cut = data.rfind(b" ", at, at + BLOCK)
            if cut <= at:
                cut = data.find(b" ", at + BLOCK)
            end = cut if cut > 0 else end
        out.append(_words_of(data[at:end]))
        at = end + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _windows(v: np.ndarray, k: int) -> np.ndarray:
    h = v[: len(v) - k + 1].copy()
    for i in range(1, k):
        h *= _C
        h += v[i : i + len(h)]
    return mix(h)


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.diff(np.append(first, len(h)))


def shingled(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: (hashes of its distinct shingles of WORDS words, rising; how often each occurs). Many short texts are hashed at once."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        v = word_hashes(b" ".join(p for p in held if p))
        every, at = (_windows(v, WORDS) if len(v) >= WORDS else v[:0]), 0
        for p in held:
            n = p.count(b" ") + 1 if p else 0
            if n >= WORDS:
                yield _counted(every[at : at + n - WORDS + 1])
            elif n:
                yield _counted(_windows(v[at : at + n], n))
            else:
                yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
            at += n

    for t in texts:
        held.append(plain(t))
        size += len(held[-1])
        if size > BLOCK:
            yield from flush()
            held, size = [], 0
    yield from flush()


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return next(iter(shingled([text])))


def counters(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each hash in either row."""
    down = np.uint64(64 - bits)
    return (h >> down).astype(np.int64), ((h * _C) >> down).astype(np.int64) + (1 << bits)


def idf_table(docs: DataFrame) -> np.ndarray:
    """idf by counter: two rows of counters, one after the other."""
    ship(docs.sparkSession)
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    wide = 4 * (size / 6 / max(1, n)) / THETA  # four times the mean words of a text, over THETA
    bits = min(COUNTERS[1], max(COUNTERS[0], int(np.ceil(np.log2(max(1.0, wide))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(2 << bits, np.int64)
        for batch in parts(batches):
            every = [h for h, _ in shingled(batch.column(0).to_pylist())]
            for row in counters(np.concatenate(every), bits):
                count += np.bincount(row, minlength=2 << bits)
        at = np.flatnonzero(count)
        for lo in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_pydict({"slot": at[lo : lo + (1 << 16)].astype(np.int32), "n": count[at[lo : lo + (1 << 16)]]})

    sums = own(docs, "text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("df")).where(F.col("df") > F.lit(THETA * n))
    out = np.ones(2 << bits, np.float32)
    for r in sums.collect():  # at most the counters, a number that doesn't grow with the documents
        out[r["slot"]] = np.log(n / min(r["df"], n)) / np.log(1 / THETA)
    return np.minimum(out, 1)


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    a, b = counters(h, len(idf).bit_length() - 2)
    return tf * (1 - IDF + IDF * np.maximum(idf[a], idf[b]).astype(float))


@lru_cache(maxsize=1)
def _odd(k: int) -> np.ndarray:
    """An odd factor for each sample."""
    return mix(np.arange(k, dtype=np.uint64) * np.uint64(8)) | np.uint64(1)


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1), with all bits of small x."""
    return np.minimum((x.astype(float) + 0.5) * 2.0**-64, 1 - 2.0**-53)


def ln_unit_weight(x: np.ndarray) -> np.ndarray:
    """ln a of weight 1: rises with x."""
    return np.log(-np.log1p(-unit(x)))


def ln_a(h: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """ln a of each hash and sample."""
    x = h[:, None] * _odd(k)
    one = ln_unit_weight(x)
    e, g = (-np.log(unit(mix(x ^ np.uint64(c)))) for c in (0x51ED270B7A3F2C95, 0xD6E8FEB86659FD93))
    r = np.log1p(e * np.exp(-one)) + g
    return one - r * np.floor(np.log(w)[:, None] / r + g / r * (1 - 2**-30))


def samples(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    k = BANDS * ROWS
    least = np.full(k, np.inf, np.float32)
    plain_ = w == 1
    one, factor = h[plain_], _odd(k)
    if len(one):
        low = np.full(k, np.iinfo(np.uint64).max)
        for lo in range(0, len(one), AT_ONCE):
            np.minimum(low, (one[lo : lo + AT_ONCE, None] * factor).min(axis=0), out=low)
        least = ln_unit_weight(low).astype(np.float32)
    other, w = h[~plain_], w[~plain_]
    for lo in range(0, len(other), AT_ONCE):
        np.minimum(least, ln_a(other[lo : lo + AT_ONCE], w[lo : lo + AT_ONCE], k).min(axis=0).astype(np.float32), out=least)
    return least


def bands(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[list[int], list[int]]:
    """A key for each band, and four bits of each sample, sixteen in a number; none for a text without words."""
    if not len(h):
        return [], [0] * PRINTS
    s = mix(samples(h, weights(h, tf, idf)).view(np.uint32).astype(np.uint64))
    few = np.zeros(16 * PRINTS, np.uint64)
    few[: len(s)] = s >> np.uint64(60)
    s, key = s.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64) * _C
    for i in range(ROWS):
        key = mix(key ^ s[:, i])
    return key.view(np.int64).tolist(), np.bitwise_or.reduce(few.reshape(PRINTS, 16) << np.arange(0, 64, 4, dtype=np.uint64), axis=1).view(np.int64).tolist()


def differing(one: list[Column], other: list[Column]) -> Column:
    """Samples that differ in their four bits."""
    out = F.lit(0)
    for a, b in zip(one, other, strict=True):
        x = a.bitwiseXOR(b)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        out = out + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    return out


def band_prints() -> list[Column]:
    """Sixteen bits of each band's key, four bands in a number."""
    out = []
    for k in range(0, BANDS, 4):
        each = [F.shiftleft(F.get("bands", F.lit(b)).bitwiseAND(F.lit(0xFFFF)), 16 * (b - k)) for b in range(k, min(BANDS, k + 4))]
        out.append(reduce(lambda x, y: x.bitwiseOR(y), each))
    return out


def shared_below(one: list[Column], other: list[Column], band: Column) -> Column:
    """How many bands below the given one are shared, by the sixteen bits of their keys."""
    out = F.lit(0)
    for b in range(BANDS - 1):
        x = F.shiftrightunsigned(one[b // 4].bitwiseXOR(other[b // 4]), 16 * (b % 4)).bitwiseAND(F.lit(0xFFFF))
        out = out + ((x == 0) & (F.lit(b) < band)).cast("int")
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (hashes, weights)."""
    total = a[1].sum() + b[1].sum()
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][at] == b[0]
    low = np.minimum(a[1][at[hit]], b[1][hit]).sum()
    return float(low / (total - low))


def packed(h: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes]:
    """Hashes as they are; of the weights only those that aren't 1: their places, then their values."""
    other = np.flatnonzero(w != 1)
    return h.astype("<u8").tobytes(), other.astype("<i8").tobytes() + w[other].astype("<f8").tobytes()


def unpacked(h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.frombuffer(h, "<u8")
    out, n = np.ones(len(hashes)), len(w) // 16
    if n:
        out[np.frombuffer(w, "<i8", n)] = np.frombuffer(w, "<f8", n, 8 * n)
    return hashes, out


def weighed(texts: DataFrame, idf) -> DataFrame:
    """(node, h, w, total, of, salts) of rows (node, text, of, salts): their shingles and weights, packed, none of them rounded, and the sum of the weights."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            of = [(x, weights(x, tf, idf.value)) for x, tf in shingled(batch.column(1).to_pylist())]
            every, total = [packed(x, w) for x, w in of], pa.array([float(w.sum()) for _, w in of], pa.float64())
            made = [pa.array([h for h, _ in every], pa.binary()), pa.array([w for _, w in every], pa.binary()), total]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, batch.column(2), batch.column(3)], names=["node", "h", "w", "total", "of", "salts"])

    return texts.select("node", "text", "of", "salts").mapInArrow(run, "node binary, h binary, w binary, total double, of array<binary>, salts array<long>")


def shareable(nodes: DataFrame, arrays: DataFrame, work: Scratch) -> DataFrame:
    """(node, total, common) of nodes (node, each once): the weight of its text, and that of its shingles which any other of nodes has, or one of the
    few nodes that sifting leaves beside them. Arrays aren't dealt out, only their shingles are."""
    ship(nodes.sparkSession)
    asked = work.keep(nodes.select("node"), "asked")
    at = sifted(arrays.select("node", "h", "w", "total"), asked, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for k, h, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, weight = unpacked(h, w)
                for lo in range(0, len(x), 1 << 16):
                    one = x[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(np.full(len(one), k, np.int64)), pa.array(weight[lo : lo + (1 << 16)])], names=["shingle", "k", "weight"])

    each = at.select(F.xxhash64("node").alias("k"), "h", "w").mapInArrow(run, "shingle long, k long, weight double")
    alone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("k").alias("k"), F.min("weight").alias("weight")).where("n = 1")
    alone = alone.groupBy("k").agg(F.sum("weight").alias("alone"))
    total = at.select("node", F.xxhash64("node").alias("k"), "total").join(asked, "node")
    return total.join(alone, "k", "left").select("node", "total", (F.col("total") - F.coalesce("alone", F.lit(0.0))).alias("common"))


def can_be(common: Column, total: Column) -> Column:
    """Whether two texts of this total weight, which share at most so much, can be similar; sums of doubles may be a little off."""
    return (1 + SIMILARITY) * common >= SIMILARITY * total * (1 - 1e-9)


def salt_of(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(SALTS))


def verified(pairs: DataFrame, arrays: DataFrame, placed: bool = False) -> DataFrame:
    """Those of the pairs (node, leader and other columns) whose texts are similar. Leaders are dealt into as many groups as keep a group's
    arrays at about HELD bytes. Pairs of a group meet in SALTS parts, by node: the arrays of its leaders come to each part once, and
    first, then each node's array once, before its pairs. A task holds the leaders of one group and one node. Arrays that are not asked for
    stay in their tasks. placed: arrays say whom each node meets (`of`: its leaders; `salts`: of the nodes it leads), so they go to the parts unjoined."""
    ship(pairs.sparkSession)
    names = pairs.columns
    mean = arrays.agg(F.avg(F.length("h") + F.length("w"))).first()[0] or 0
    groups = max(1, -(-pairs.select("leader").distinct().count() * int(mean) // HELD))
    group = lambda leader: F.pmod(F.xxhash64(leader), F.lit(groups))
    dealt = pairs.select(group("leader").alias("g"), salt_of("node").alias("salt"), "node", "leader", F.struct(*names).alias("pair"))
    kind = dealt.schema["pair"].dataType.simpleString()
    if not placed:
        arrays = sifted(arrays, pairs.select("node").unionByName(pairs.select(F.col("leader").alias("node"))).distinct(), "node")

    def brought(column: str, kind_: int) -> DataFrame:
        if not placed:
            ids = dealt.select("g", "salt", F.col(column).alias("node")).distinct().join(arrays, "node")
        elif column == "leader":
            ids = arrays.select(group("node").alias("g"), F.explode("salts").alias("salt"), "node", "h", "w")
        else:
            ids = arrays.select(F.explode(F.array_distinct(F.transform("of", group))).alias("g"), salt_of("node").alias("salt"), "node", "h", "w")
        return ids.select("g", "salt", F.lit(min(kind_, 1)).alias("turn"), "node", F.lit(kind_).alias("kind"), F.lit(None).cast("binary").alias("leader"), "h", "w", F.lit(None).cast(kind).alias("pair"))

    none = F.lit(None).cast("binary")
    asked = dealt.select("g", "salt", F.lit(1).alias("turn"), "node", F.lit(2).alias("kind"), "leader", none.alias("h"), none.alias("w"), "pair")
    every = brought("leader", 0).unionByName(brought("node", 1)).unionByName(asked)
    placed = every.repartition("g", "salt").sortWithinPartitions("g", "salt", "turn", "node", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders, at, mine = {}, None, None
        for batch in parts(batches):
            keep = []
            for g, salt, node, k, leader, h, w in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7)), strict=True):
                if at != (g, salt):
                    at, leaders = (g, salt), {}
                if k == 0:
                    leaders[node] = unpacked(h, w)
                elif k == 1:
                    mine = unpacked(h, w)
                keep.append(k == 2 and similarity(mine, leaders[leader]) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays(batch.column(8).filter(pa.array(keep, pa.bool_())).flatten(), names=names)

    return placed.mapInArrow(run, pairs.schema)


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """(node, root) of every node with a link (columns a, b): root is the least node of its component."""
    edges = work.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges0")
    before, k = None, 0
    while True:
        # large star: each node's larger neighbours are hung below its least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = work.keep(large, f"large{k}")
        # small star: each node and its smaller neighbours are hung below the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = work.keep(small.where("a <> b").distinct(), f"edges{k + 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("b", "b").distinct().toDF("node", "root"))
        before, k = now, k + 1


def merged(rows: DataFrame, links: DataFrame, work: Scratch, name: str) -> DataFrame:
    """rows with their class renamed along links (ca, cb), three steps far: classes that are still apart only cost more checks."""
    both = links.select("ca", "cb").unionByName(links.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct()
    at = both.select("ca").distinct().select("ca", F.col("ca").alias("to"))
    for _ in range(3):
        near = both.join(at.toDF("cb", "near"), "cb").groupBy("ca").agg(F.min("near").alias("near"))
        at = at.join(near, "ca").select("ca", F.least("to", "near").alias("to"))
    keys = rows.groupBy("class").agg(F.count("*").alias("n")).join(at.toDF("class", "to"), "class", "left").withColumn("to", F.coalesce("to", "class"))
    return meet(rows, work.keep(keys, name), "class").withColumn("class", F.col("to")).drop("to", "n")


def unlike(parts_: DataFrame) -> DataFrame:
    """(bucket, n) of the buckets that hold nodes of more than one class."""
    return parts_.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "n")


def rest(open_: DataFrame, arrays: DataFrame, work: Scratch) -> DataFrame | None:
    """Links (a, b) between nodes of unlike classes in the buckets open_ (bucket, band, node, class, total, common, prints of samples and
    bands), each pair in the bucket of the second lowest band that it shares. A node that has led leaves its bucket, so a pair
    comes up once, or twice if both lead at once; pairs that the leaders of buckets refused may be checked again."""
    k, slots, links = 0, SLOTS, None
    while True:
        crowded = work.keep(unlike(open_), f"crowded{k}")
        if not crowded.take(1):
            return links
        open_ = work.keep(meet(open_, crowded, "bucket").drop("n"), f"open{k}")
        slot = F.pmod(F.xxhash64("class" if k < BY_CLASS else "node", F.lit(k)), F.lit(slots))
        top = F.max(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "class", *KEPT)).alias("top")
        led = [F.col("top.node").alias("leader"), F.col("top.class").alias("of"), *(F.col(f"top.{p}").alias(f"of_{p}") for p in KEPT)]
        leaders = work.keep(open_.groupBy("bucket", slot.alias("slot")).agg(top).select("bucket", *led).join(crowded, "bucket"), f"leaders{k}")
        alike = differing([F.col(p) for p in PRINT], [F.col(f"of_{p}") for p in PRINT]) <= BANDS * ROWS - AGREE
        once = shared_below([F.col(p) for p in BAND], [F.col(f"of_{p}") for p in BAND], F.col("band")) == 1
        similar = can_be(F.least("common", "of_common"), F.col("total") + F.col("of_total"))
        met = meet(open_, leaders, "bucket").where((F.col("class") != F.col("of")) & similar & alike & once)
        up = F.col("node") > F.col("leader")
        pair = [F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b"), F.when(up, F.col("class")).otherwise(F.col("of")).alias("ca"), F.when(up, F.col("of")).otherwise(F.col("class")).alias("cb")]
        fresh = work.keep(met.select(*pair, "node", "leader").dropDuplicates(["a", "b"]), f"fresh{k}")
        found = work.keep(verified(fresh, arrays).drop("node", "leader"), f"found{k}")
        open_ = open_.join(leaders.select("bucket", F.col("leader").alias("node")), ["bucket", "node"], "left_anti")
        if found.take(1):
            links = found.select("a", "b") if links is None else links.unionByName(found.select("a", "b"))
            open_ = merged(open_, found, work, f"names{k}")
        open_ = work.keep(open_, f"left{k}")
        for name in (f"crowded{k}", f"open{k}", f"leaders{k}", f"left{k - 1}"):
            work.drop(name)
        release(arrays.sparkSession)
        k, slots = k + 1, slots * MORE


PRINT = [f"p{i}" for i in range(PRINTS)]
BAND = [f"b{i}" for i in range(-(-BANDS // 4))]
KEPT = [*PRINT, *BAND, "total", "common"]


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def row_of(node: Column, doc_id: Column) -> Column:
    """Of a text and an id; rows that are equal in both are one."""
    return F.md5(F.concat_ws(":", F.hex(node), F.when(doc_id.isNull(), "null").otherwise(F.concat(F.lit("id"), doc_id.cast("string")))))


def sifted(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """The rows whose `on` is one of wanted (a written table), and a few others: those whose two bits, of at most 64 * BITS, wanted values set too. The bits
    are broadcast, so no row leaves its task."""
    words = min(BITS, max(1, wanted.count() // 4))
    hashed = F.xxhash64(on)
    place = [F.pmod(F.shiftright(h, 6), F.lit(words)).cast("int") for h in (hashed, F.xxhash64(F.lit(1), on))]
    bit = [h.bitwiseAND(F.lit(63)).cast("int") for h in (hashed, F.xxhash64(F.lit(1), on))]
    one = F.explode(F.array(*(F.struct(w.alias("word"), b.alias("bit")) for w, b in zip(place, bit, strict=True)))).alias("one")
    set_ = wanted.select(one).groupBy("one.word").agg(F.bit_or(F.expr("shiftleft(1L, one.bit)")).alias("bits"))
    for w, b in zip(place, bit, strict=True):
        rows = rows.withColumn("word", w).join(F.broadcast(set_), "word").where(F.getbit("bits", b) == 1).select(*rows.columns)
    return rows


def among(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """The rows whose `on` is one of wanted (a written table, each once), with its other columns. Before they are dealt, most of the others are sifted out where
    they are, with their texts; the join is exact."""
    return sifted(rows, wanted, on).join(wanted.dropDuplicates([on]), on).select(*rows.columns, *(c for c in wanted.columns if c != on))  # a semi-join would be planned below the bits


def classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id and node of each row; node, n (rows), first, root, class and n_links of each node): first is the least doc_id of its
    text, class of its component. A node without links is its own root."""
    spark = docs.sparkSession
    work = Scratch(spark, "neardup")
    docs = own(docs, "doc_id", "text")
    idf = spark.sparkContext.broadcast(idf_table(docs))
    keyed = docs.withColumn("node", node_of(F.col("text")))
    schema = StructType([docs.schema["doc_id"], keyed.schema["node"], StructField("bands", ArrayType(LongType())), StructField("prints", ArrayType(LongType()))])

    def sketch(c: dict[str, list]) -> dict[str, list]:
        found = [bands(h, tf, idf.value) for h, tf in shingled(c["text"])]
        return {"doc_id": c["doc_id"], "node": c["node"], "bands": [b for b, _ in found], "prints": [p for _, p in found]}

    sketched = work.keep(map_rows(keyed, sketch, schema), "sketches")
    one = F.max(F.struct("bands", "prints")).alias("one")
    nodes = sketched.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), one)
    nodes = work.keep(nodes.select("node", "n", "first", "one.bands", *(F.col("one.prints")[i].alias(p) for i, p in enumerate(PRINT))), "nodes")

    members = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = work.keep(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = work.keep(meet(sifted(members, shared, "bucket"), shared, "bucket"), "members")
    central = members.groupBy("node").agg(F.round(F.sum(F.log("n")), 6).alias("score"))
    members = work.keep(members.join(central, "node").select("bucket", "band", "node", F.struct("score", "node").alias("rank")), "ranked")
    work.drop("shared")
    work.drop("members")
    leaders = work.keep(members.groupBy("bucket").agg(F.max("rank").alias("top"), F.count("*").alias("n")).select("bucket", F.col("top.node").alias("leader"), "n"), "leaders")
    led = meet(members.select("bucket", "node"), leaders, "bucket").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    led = work.keep(led, "led")
    of = led.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("of"))
    salts = led.groupBy(F.col("b").alias("node")).agg(F.collect_set(salt_of("a")).alias("salts"))
    wanted = members.select("node").distinct().join(nodes.select("node", "first"), "node").join(of, "node", "left").join(salts, "node", "left")
    wanted = work.keep(wanted.select(row_of(F.col("node"), F.col("first")).alias("row"), "of", "salts"), "wanted")
    rows = among(keyed.withColumn("row", row_of(F.col("node"), F.col("doc_id"))), wanted, "row").dropDuplicates(["row"])  # dealt by row already
    arrays = work.keep(weighed(rows, idf), "arrays")
    release(spark)
    links = work.keep(verified(led.select("a", "b", F.col("a").alias("node"), F.col("b").alias("leader")), arrays, placed=True).select("a", "b"), "links")
    roots = work.keep(components(links, work), "roots")

    at = members.select("bucket", "band", "node").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    at = work.keep(at, "classes0")
    mixed = work.keep(unlike(at), "mixed")
    if mixed.take(1):
        crowd = work.keep(meet(at, mixed, "bucket").drop("n"), "crowd")
        share = shareable(crowd.select("node").distinct(), arrays, work).where(can_be(F.col("common"), F.col("total") + F.col("common")))
        held = work.keep(share.join(nodes.select("node", *PRINT, *(c.alias(p) for c, p in zip(band_prints(), BAND, strict=True))), "node"), "shareable")
        parts_ = crowd.join(held, "node").select("bucket", "band", "node", "class", *KEPT)
        more = rest(work.keep(parts_, "left-1"), arrays, work)
        if more is not None:
            links = links.unionByName(more)
            roots = work.keep(components(links, Scratch(spark, "neardup-again")), "roots-again")

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    number = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    placed = roots.join(nodes.select("node", "first"), "node")
    classes = placed.groupBy("root").agg(F.min("first").alias("class"), F.count("*").alias("n"))
    classes = work.keep(classes, "classes1")
    of = meet(placed, classes, "root").join(number, "node", "left").select("node", "root", "class", "n_links")
    known = nodes.select("node", "n", "first").join(of, "node", "left")
    known = known.select("node", "n", "first", F.coalesce("root", "node").alias("root"), F.coalesce("class", "first").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return sketched.select("doc_id", "node"), work.keep(known, "known")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of each row: links of its text to other texts that the check verified, to leaders or from
    nodes led; two texts of a class that both hang from a leader are not paired, so it is no count of all similar texts."""
    rows, known = classed(docs)
    return meet(rows, known, "node").select("doc_id", F.col("class").alias("class_id"), "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of each class: one whose doc_id is the class_id. Rows of one doc_id, or of none, that are
    of different classes all stay. Copies of a row meet in the task that reads them before any shuffle."""
    order = F.struct(F.col("first").isNull().alias("none"), "first", "node")
    kept = classed(docs)[1].groupBy("root").agg(F.min(order).alias("k")).select(row_of(F.col("k.node"), F.col("k.first")).alias("kept"))
    at = next(n for n in (f"row{i}" for i in range(len(docs.columns) + 1)) if n not in {c.lower() for c in docs.columns})
    rows = docs.withColumn(at, row_of(node_of(F.col("text")), F.col("doc_id"))).dropDuplicates([at])
    return rows.join(kept.withColumnRenamed("kept", at), at, "left_semi").drop(at)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
