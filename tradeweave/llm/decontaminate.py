"""Benchmark decontamination by the q-gram lemma.

Texts are compared in a plain form (ASCII letters lower-cased, ASCII punctuation and white space one space). Benchmark items
are cut into overlapping segments of SEGMENT bytes, one every STEP (shorter items: one), each with an edit budget e of EDITS of
its length.
A copy of a segment of m bytes with e edits shares at least T = m + 1 - q (e + 1) of its q-grams with it, on at most e + 1
neighbouring diagonals. So, in each batch of texts, all in numpy:
1. q-gram hashes at every position, looked up in a bit table of the benchmark's q-grams;
2. places whose window holds fewer than the least T such q-grams are left out;
3. the rest are matched to segments and counted in overlapping bands of diagonals; bands with T or more are retained;
4. retained bands are verified by banded alignment: edit distance at most e, ends of the text free.

Texts stay in their tasks; only (doc, item) matches leave them. The benchmark is a query set: it goes to the executors in
blocks of at most BLOCK_BYTES, one pass over the texts for each block.

A document matches an item if it matches one of its segments: a verbatim excerpt of SEGMENT + STEP - 1 bytes always does. Items
shorter than q bytes in plain form, or without a plain form of q-grams, are matched exactly: by documents whose whole plain
form they are. Null and empty texts and items match nothing. Pairs of places and segments are counted CROWD at a time, so a
sentence that thousands of items share costs time, not memory. Repeated rows are judged one by one; items with equal text are all reported. An empty benchmark or an
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import filter_rows, own, ship, table

Q, SEGMENT, STEP, EDITS = 8, 80, 16, 0.09
BLOCK_BYTES = 1_000_000
#: Pairs of a place and a segment that are counted at once, about.
CROWD = 1 << 20
#: Plain bytes that are searched at once; those whose q-grams are hashed at once.
AT_ONCE, HASHED = 1 << 19, 1 << 16
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def plain(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def qgrams(data: bytes) -> np.ndarray:
    """A hash of the Q bytes at each place."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.ndarray((n,), "<u8", data, 0, (1,)) * _A
    return (h ^ (h >> np.uint64(32))) * _B


class Index:
    """Segments of a block of items, and where their q-grams are."""

    def __init__(self, items: list[tuple[int, str | None]]):
        cut: dict[bytes, list[int]] = {}
        self.short: dict[bytes, list[int]] = {}
        for item, text in items:
            p = plain(text)
            if len(p) >= Q:
                for a in dict.fromkeys([*range(0, max(1, len(p) - SEGMENT + 1), STEP), max(0, len(p) - SEGMENT)]):
                    of = cut.setdefault(p[a : a + SEGMENT], [])
                    if item not in of:
                        of.append(item)
            elif p:
                self.short.setdefault(p, []).append(item)
        self.text, self.items = list(cut), list(cut.values())
        size = np.array([len(t) for t in self.text], np.int64)
        edits = np.minimum((EDITS * size).astype(np.int64), np.maximum(size // Q - 2, 0))
        self.size, self.edits, self.least = size, edits, size + 1 - Q * (edits + 1)
        h, seg, pos = [], [], []
        for i, t in enumerate(self.text):
            g = qgrams(t)
            h.append(g)
            seg.append(np.full(len(g), i, np.int32))
            pos.append(np.arange(len(g), dtype=np.int32))
        self.h, self.seg, self.pos = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((h, np.uint64), (seg, np.int32), (pos, np.int32)))
        order = np.argsort(self.h, kind="stable")
        self.h, self.seg, self.pos = self.h[order], self.seg[order], self.pos[order]
        self.bits = max(16, int(len(self.h) * 16).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.h)] = True
        self.width = int(edits.max()) + 1 if len(edits) else 1

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def _hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places whose q-gram the benchmark has, and its hash. HASHED places at once: only hits are held of all of them."""
        places, hashes = [], []
        for at in range(0, len(data) - Q + 1, HASHED):
            h = qgrams(data[at : at + HASHED + Q - 1])
            hit = np.flatnonzero(self.table[self._slot(h)])
            h = h[hit]
            good = np.searchsorted(self.h, h, "right") > np.searchsorted(self.h, h, "left")
            places.append(hit[good] + at)
            hashes.append(h[good])
        return np.concatenate(places), np.concatenate(hashes)

    def search(self, data: bytes) -> list[tuple[int, int, int]]:
        """(segment, place in data, edits) of each copy of a segment."""
        if len(data) < Q or not len(self.h):
            return []
        hit, h = self._hits(data)
        least, span = int(self.least.min()), int((self.size + self.edits).max()) - Q + 1
        # a window of span places that begins or ends at the hit holds `least` hits; one that holds the hit lies in both
        if least > 1 and len(hit):
            upto = np.searchsorted(hit, hit + span) - np.arange(len(hit))  # hits from here on
            since = np.arange(len(hit)) - np.searchsorted(hit, hit - span, "right") + 1
            near = upto + since - 1 >= least
            hit, h = hit[near], h[near]
        if not len(hit):
            return []
        lo = np.searchsorted(self.h, h, "left")
        n = np.searchsorted(self.h, h, "right") - lo
        total, found, i = np.cumsum(n), {}, 0
        while i < len(hit):  # some hits, and those after them that may lie in one band with the last
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + CROWD, "right")))
            end = int(np.searchsorted(hit, hit[j - 1] + 2 * span))
            for s, a, e in self._counted(data, hit[i:end], lo[i:end], n[i:end]):
                found[s, a] = min(e, found.get((s, a), e))
            i = j
        return [(s, a, e) for (s, a), e in found.items()]

    def _counted(self, data: bytes, hit: np.ndarray, lo: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        at += np.arange(len(at))
        w = self.width  # bands of 2w diagonals, one begins every w: e + 1 neighbours lie in one of them
        key, half = np.empty(2 * len(at), np.int64), len(at)
        key[:half] = np.repeat(hit, n)
        key[:half] -= self.pos[at]
        key[:half] //= w
        key[:half] += 4
        key[:half] += self.seg[at].astype(np.int64) << 40
        del at
        key[half:] = key[:half] - 1
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        bands, count = key[first], np.diff(np.append(first, len(key)))
        seg, band = bands >> 40, (bands & ((1 << 40) - 1)) - 4
        keep = count >= self.least[seg]
        return self.verify(data, seg[keep], band[keep] * w)

    def verify(self, data: bytes, seg: np.ndarray, diagonal: np.ndarray) -> list[tuple[int, int, int]]:
        """Banded alignment of segments with data along the diagonals from `diagonal` on, 2w of them and e to either side."""
        out: list[tuple[int, int, int]] = []
        e, text = self.width - 1, np.frombuffer(data, np.uint8)
        for size in np.unique(self.size[seg]):
            of = np.flatnonzero(self.size[seg] == size)
            for part in np.array_split(of, max(1, len(of) // 20_000)):
                pattern = np.stack([np.frombuffer(self.text[s], np.uint8) for s in seg[part]])
                first, wide = diagonal[part] - e, 2 * self.width + 2 * e
                cells = np.arange(wide)
                d = np.zeros((len(part), wide), np.int32)  # of no pattern byte and any place: nothing
                for i in range(int(size)):
                    at = first[:, None] + i + cells
                    byte = np.where((at >= 0) & (at < len(text)), text[np.clip(at, 0, len(text) - 1)], 0)
                    new = d + (byte != pattern[:, i : i + 1])
                    new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)  # a pattern byte that the text lacks
                    d = np.minimum.accumulate(new - cells, axis=1) + cells  # text bytes that the pattern lacks
                best = d.min(axis=1)
                good = best <= self.edits[seg[part]]
                out += [(int(s), max(0, int(a)), int(b)) for s, a, b in zip(seg[part][good], first[good] + d.argmin(axis=1)[good], best[good], strict=True)]
        return out


def rows_with(index: Index, texts: list[str | None]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """By (row, item): fewest edits, number of the item's segments, first place in plain form."""
    pairs: dict[tuple, list] = {}
    data: list[bytes] = []
    rows: list[int] = []
    starts = [0]

    def search() -> None:
        begins = np.array(starts[:-1])
        for seg, at, edits in index.search(b"\0".join(data)):
            k = int(np.searchsorted(begins, at, "right")) - 1
            for item in index.items[seg]:
                got = pairs.setdefault((rows[k], item), [edits, set(), at - starts[k]])
                got[0], got[2] = min(got[0], edits), min(got[2], at - starts[k])
                got[1].add(seg)
        data.clear()
        rows.clear()
        starts[1:] = []

    for row, text in enumerate(texts):
        if p := plain(text):
            for item in index.short.get(p, ()):
                pairs.setdefault((row, item), [0, {-1}, 0])
            data.append(p)
            rows.append(row)
            starts.append(starts[-1] + len(p) + 1)
            if starts[-1] > AT_ONCE:
                search()
    if data:
        search()
    return {k: (e, len(s), a) for k, (e, s, a) in pairs.items()}


def blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of about BLOCK_BYTES."""
    items = own(benchmark, "item_id", "text").where(F.length("text") > 0)
    n = int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES + 1
    for k in range(n):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits (fewest), segments (how many of the item's), plain_start (byte in plain form) of each matching pair."""
    spark = docs.sparkSession
    ship(spark)
    schema = StructType([docs.schema["doc_id"], benchmark.schema["item_id"], *(StructField(n, LongType()) for n in ("edits", "segments", "plain_start"))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    found = None
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                ids = batch.column(0)
                if got := rows_with(index, batch.column(1).to_pylist()):
                    rows = [(ids[r].as_py(), item, *x) for (r, item), x in got.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow, strict=True)], schema=arrow)

        part = own(docs, "doc_id", "text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose text matches no item. No shuffle."""
    spark = docs.sparkSession
    for block in blocks(benchmark):
        shared, held = spark.sparkContext.broadcast(block), {}

        def keep(texts: list, shared=shared, held=held) -> list[bool]:
            if "index" not in held:  # once in a task
                held["index"] = Index(shared.value)
            bad = {r for r, _ in rows_with(held["index"], texts)}
            return [r not in bad for r in range(len(texts))]

        docs = filter_rows(docs, keep)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
