"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

The writer groups payloads by digest: the smallest page_id of each group is a response, the others revisit it. Digests are
counted before they are shuffled. Only digests that occur twice are joined to the pages; pages with one of the fewer than HOT
digests that are hot stay in their tasks, the others meet theirs in a join that broadcasts only what is small. Each task
writes archives of bounded size to the shared folder and lists them in a table that Spark commits, so retried tasks and
lost executors leave nothing that counts. The dictionary of an archive is trained on its own first records.

The reader takes the dictionary from the leading frame, decodes a frame at a time, and checks version, headers, lengths
and digests; a record that doesn't hold raises ValueError.

Null and empty html: an empty payload. A null url: no WARC-Target-URI. A null page_id is never referred to unless all of a
group are null; then all are responses. Rows that share the smallest page_id of a group are all responses. An empty table
makes no archive and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, Scratch, own, ship, table

#: Fixed values of the formats.
DICTIONARY_FRAME, VERSION, PROFILE = 0x184D2A5D, b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL, DATE = 64_000_000, 16_384, 1_000_000, 3, "1970-01-01T00:00:00Z"
#: Payloads of at least so many bytes are joined to their copies.
LEAST = 0
ARCHIVES = "path string, n_records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
CHUNK = 1 << 16


def urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, a revisit if refers_to is given; its HTTP header tells the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]):
    import zstandard

    taken, size = [], 0
    for s in samples:
        if size > SAMPLE_BYTES:
            break
        taken.append(s[:CHUNK])
        size += len(taken[-1])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, taken)
    except zstandard.ZstdError:  # too few samples to train on: their bytes are the dictionary
        return zstandard.ZstdCompressionDict(b"".join(taken)[:DICTIONARY_BYTES] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def parse(data: bytes) -> dict:
    """The fields of RECORDS; ValueError if version, headers, lengths or digest don't hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, s, v in (x.decode("utf-8", "surrogatepass").partition(":") for x in lines[1:]) if s}
    missing = {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"headers are missing: {sorted(missing)}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length isn't Content-Length")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", http)
    if not gap or not length:
        raise ValueError("no HTTP header")
    kind, digest, full = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(length[1])
    of = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", x)) else None
    if kind == "response":
        if len(payload) != full or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("the payload's length or digest differs")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError("neither a response nor a revisit")
    return {"page_id": of(fields["warc-record-id"]), "payload_bytes": full, "payload_digest": digest, "record_type": kind, "refers_to": of(fields.get("warc-refers-to", ""))}


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one from each frame."""
    import zstandard

    magic, size = struct.unpack_from("<II", data) if len(data) >= 8 else (0, 0)
    if magic != DICTIONARY_FRAME or len(data) < 8 + size:
        raise ValueError("no dictionary in the leading frame")
    engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at = 8 + size
    while at < len(data):
        one, parts = engine.decompressobj(), []
        while not one.eof:
            piece = data[at : at + CHUNK]
            if not piece:
                raise ValueError("the last frame is cut off")
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes archives of pages (page_id, url, html) below folder; the table of archives."""
    ship(pages.sparkSession)
    full = own(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    full = full.withColumn("sha1", F.sha1("payload"))
    twice = full.where(F.length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = Scratch(pages.sparkSession, "warc-digests").keep(twice, "twice")
    total = twice.agg(F.sum("n")).first()[0] or 0
    hot, rest = F.broadcast(twice.where(F.col("n") > total / HOT)), twice.where(F.col("n") <= total / HOT)
    met = full.join(hot, "sha1").unionByName(full.join(hot.select("sha1"), "sha1", "left_anti").join(rest, "sha1", "left"))
    marked = met.select("page_id", "url", "payload", "sha1", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        out, path, size, n = None, "", 0, 0
        listed: list[tuple[str, int]] = []
        try:
            for batch in batches:
                cols = [c.to_pylist() for c in batch.columns]
                for page, url, payload, sha1, refers in zip(*cols, strict=True):
                    if out is not None and size > ARCHIVE_BYTES:
                        out.close()
                        listed.append((path, n))
                        out = None
                    if out is None:
                        words = dictionary([record(a, b, c, "", None) for a, b, c in zip(*cols[:3], strict=True)][:256])
                        engine = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
                        path, n = f"{folder}/pages-{uuid.uuid4().hex}.warc.zst", 0
                        store, place = fs.FileSystem.from_uri(path)
                        store.create_dir(place.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(place, compression=None)
                        out.write(struct.pack("<II", DICTIONARY_FRAME, size := len(words.as_bytes())) + words.as_bytes())
                    frame = engine.compress(record(page, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers))
                    out.write(frame)
                    size, n = size + len(frame), n + 1
        finally:
            if out is not None:
                out.close()
        if n and out is not None:
            listed.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in listed], pa.string()), pa.array([x[1] for x in listed], pa.int64())], names=["path", "n_records"])

    return Scratch(pages.sparkSession, "warc").keep(marked.mapInArrow(run, ARCHIVES), "archives")


def read(archives: DataFrame, n: int) -> DataFrame:
    """The records of the n archives, each read in one task."""
    ship(archives.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                rows, found = [], 0
                for data in frames(store.open_input_file(place).read()):
                    rows.append(parse(data))
                    found += 1
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if found != n:
                    raise ValueError(f"{path}: {found} records, not {n}")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.repartition(max(1, n)).mapInArrow(run, RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(table(spark, sf_dir, "pages"), Scratch(spark, "warc").path)
    return read(archives, archives.count())


#: DuckDB has no base32: the digest is made from the bits of the SHA-1, five at a time.
OP4_SQL = """
with p as (select page_id, encode(coalesce(html, '')) payload, sha1(coalesce(html, '')) h from pages),
f as (select h, min(page_id) as first from p group by h),
d as (select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([(((strpos('0123456789abcdef', h[(5 * i + j) // 4 + 1]) - 1) // (2 ** (3 - (5 * i + j) % 4))::int) % 2) * (2 ** (4 - j))::int
    for j in [0, 1, 2, 3, 4]])::int, 1), '' order by i) digest from f, range(32) t(i) group by h)
select page_id, octet_length(payload) payload_bytes, digest payload_digest, case when page_id = first then 'response' else 'revisit' end record_type,
    case when page_id <> first then first end refers_to from p join f using (h) join d using (h)"""
