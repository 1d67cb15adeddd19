"""Flat token-id files with 64-bit document offsets, written and read by memory map.

A shard is three files in the shared folder: ids (unsigned 16- or 32-bit, as the vocabulary needs), offsets (unsigned
64-bit, one more than documents, within the shard) and docs (signed 64-bit ids of the documents). Shards hold ranges of
doc_id in order; a table of shards, written by Spark, names the files that count and gives each shard's base, a prefix sum
of the ids before it. A file gets its name from the attempt that wrote it and is listed only by the attempt that Spark
committed, so retried and speculative tasks and lost executors leave no trace in the result.

Null and empty texts are documents of the end id alone. Rows with one doc_id stay together, in order of their text. A null
doc_id sorts first and is kept as the smallest 64-bit integer. An empty table makes no shard and reads back no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, own, ship, table
from .tokens import encoder, vocabulary

END = 2
SHARD_CHARS = 32_000_000  # of text in a shard, about
NO_ID = -(2**63)
SHARDS = "first_doc long, path string, n_docs long, n_ids long, width int"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, path: str, folder: str, end: int = END, shards: int | None = None) -> DataFrame:
    """Writes the shards below folder and returns the table of shards with their bases."""
    spark = docs.sparkSession
    ship(spark)
    if shards is None:
        shards = max(1, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path).ids, end.to_bytes(4, "little")
        width = 2 if max(len(encoder(path).width) - 1, end) < 2**16 else 4
        files, base = None, f"{folder}/shard-{uuid.uuid4().hex}"
        at, n, offsets, ids = 0, 0, [0], []
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if files is None:
                    store, place = fs.FileSystem.from_uri(base)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    files = {k: store.open_output_stream(f"{place}.{k}") for k in ("ids", "offsets", "docs")}
                    files["offsets"].write(np.zeros(1, "<u8").tobytes())
                    first = batch.column(0)[0].as_py()
                for text in batch.column(1).to_pylist():
                    raw = np.frombuffer(encode(text) + tail, "<u4").astype(f"<u{width}")
                    at += len(raw)
                    ids.append(raw.tobytes())
                    offsets.append(at)
                n += batch.num_rows
                files["ids"].write(b"".join(ids))
                files["offsets"].write(np.array(offsets[1:], "<u8").tobytes())
                files["docs"].write(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                offsets, ids = [at], []
        finally:
            for f in (files or {}).values():
                f.close()
        if files:
            yield pa.RecordBatch.from_pydict({"first_doc": [first], "path": [base], "n_docs": [n], "n_ids": [at], "width": pa.array([width], pa.int32())})

    slim = own(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    done = Scratch(spark, "tokenfile").keep(slim.repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARDS), "shards")
    before = Window.orderBy("first_doc").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return done.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def mapped(uri: str, suffix: str, kind: str) -> np.ndarray:
    """The file as an array: memory-mapped where the folder is a local one, else read."""
    store, place = fs.FileSystem.from_uri(f"{uri}.{suffix}")
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(place, dtype=kind, mode="r")
    return np.frombuffer(store.open_input_file(place).read(), kind)


def read(shards: DataFrame, n: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files of the n shards, a task for each."""
    ship(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                docs, offsets = mapped(s["path"], "docs", "<i8"), mapped(s["path"], "offsets", "<u8").astype(np.int64)
                ids = mapped(s["path"], "ids", f"<u{s['width']}")
                if len(docs) != s["n_docs"] or len(offsets) != len(docs) + 1 or offsets[-1] != len(ids) or len(ids) != s["n_ids"]:
                    raise ValueError(f"{s['path']}: its files don't agree with the table of shards")
                for lo in range(0, len(docs), 4096):
                    part = offsets[lo : lo + 4097]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(part[:-1], part[1:], strict=True)]
                    doc = pa.array(np.array(docs[lo : lo + 4096]), mask=np.array(docs[lo : lo + 4096]) == NO_ID)
                    yield pa.RecordBatch.from_pydict({"doc_id": doc, "start": part[:-1] + s["base"], "n_tokens": np.diff(part), "ids_crc32": pa.array(crc, pa.int64())})

    return shards.repartition(max(1, n)).mapInArrow(run, ROWS)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "tokenfile").path
    shards = write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder)
    return read(shards, shards.count())
