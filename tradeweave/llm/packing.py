"""Shortest-pack-first packing over the length histogram.

Documents are cut into full pieces of the sequence length and a rest, where they lie. Only the histogram of piece lengths,
at most as many rows as the sequence length, reaches the driver: there lengths are placed longest first, each into the
shortest pattern that has room, and counts of patterns are updated. Pieces then get a rank within their length, from
counts by bucket and their prefix sums, and meet their place by a join on length and rank with the pattern slots, whose
number depends on the sequence length alone, not on the corpus.

A sequence is padded to the sequence length, but for one whose ids are a power of two in number, which stays as it is; a
piece says to how many ids its own is padded.

Null and empty texts are documents of the end id alone. Repeated rows are packed one by one; equal rows share no piece. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_rows, own, table
from .tokens import encoder, vocabulary

SEQUENCE, END = 1024, 0
#: Rows with one length that meet in a task when ranks are dealt out, about.
BUCKET_ROWS, BUCKETS = 50_000, 256


def patterns(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) and how many sequences follow each, for counts of pieces by length."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    heap: list[int] = []

    def put(total: int, pattern: tuple[int, ...], n: int) -> None:
        if total not in open_:
            open_[total] = []
            heapq.heappush(heap, total)
        open_[total].append((pattern, n))

    done: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while heap and not open_[heap[0]]:
                del open_[heapq.heappop(heap)]
            if heap and heap[0] + length <= size:
                pattern, n = open_[heap[0]].pop()
                took = min(n, left)
                if n > took:
                    open_[heap[0]].append((pattern, n - took))
                put(heap[0] + length, (*pattern, length), took)
                left -= took
            else:  # none has room: new sequences, each filled before the next is begun
                each = size // length
                if full := left // each:
                    put(each * length, (length,) * each, full)
                if rest := left % each:
                    put(rest * length, (length,) * rest, 1)
                left = 0
    done += [x for at in open_.values() for x in at]
    return sorted(done, reverse=True)


def slots(found: list[tuple[tuple[int, ...], int]], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, padded length): pieces of a length take these in order of rank."""
    out, rank, base = [], {}, 0
    for lengths, n in found:
        at, total = 0, sum(lengths)
        padded = size if total & (total - 1) else total
        for length in lengths:
            r = rank.get(length, 0)
            out.append((length, r, r + n, base, at, padded))
            rank[length] = r + n
            at += length
        base += n
    return out


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: list[tuple] = []
        tail, encode = end.to_bytes(4, "little"), encoder(path).ids
        for doc, text in zip(cols["doc_id"], cols["text"], strict=True):
            raw = encode(text) + tail
            n = len(raw) // 4
            out += [(doc, at, min(size, n - at), zlib.crc32(raw[4 * at : 4 * (at + size)]), n) for at in range(0, n, size)]
        return dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), map(list, zip(*out)), strict=True))

    from pyspark.sql.types import LongType, StructField, StructType

    fields = [StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens"))]
    return map_rows(own(docs, "doc_id", "text"), run, StructType(fields))


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """pieces() with sequence_id, offset and sequence_length (with the padding)."""
    spark = docs.sparkSession
    cut = Scratch(spark, "pack").keep(pieces(docs, path, size, end), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    found = patterns(counts, size)
    places = spark.createDataFrame(slots(found, size) or [(0,) * 6], "length long, lo long, hi long, base long, offset long, sequence_length long")
    buckets = max(BUCKETS, sum(counts.values()) // BUCKET_ROWS)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    by = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("within", F.row_number().over(within) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    at = F.broadcast(places.withColumnRenamed("length", "of"))  # depends on size alone
    return ranked.join(at, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", "sequence_length"
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
