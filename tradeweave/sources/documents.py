"""Landed documents: files of bytes with a JSON note beside each, read by content type.

A landed document is KEY.doc (the bytes) and KEY.doc.json (url, content_type, _ts, truncated). Bytes come through the binaryFile
source, notes through the JSON source; they meet by key. Bytes without a note are of unknown type; a note without bytes is no document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import LONG, decode, read_page

#: Hosts whose pages hold nothing without a browser.
SCRIPTED = ("usaspending.gov", "gleif.org", "sam.gov", "finnhub.io")
NOTE = "url string, content_type string, _ts double, truncated boolean"
UNKNOWN = "application/octet-stream"


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """(key, url, content_type, retrieved_at, capped, body) of the documents below folder."""
    key = lambda path, end: F.regexp_extract(path, rf"([^/]+){end}$", 1)
    bodies = spark.read.format("binaryFile").option("pathGlobFilter", "*.doc").option("recursiveFileLookup", "true").load(folder).select(key(F.col("path"), r"\.doc").alias("key"), F.col("content").alias("body"))
    notes = spark.read.schema(NOTE).option("multiLine", "true").option("pathGlobFilter", "*.doc.json").option("recursiveFileLookup", "true").json(folder)
    notes = notes.select(key(F.input_file_name(), r"\.doc\.json").alias("key"), "url", F.lower(F.trim("content_type")).alias("content_type"), F.timestamp_seconds("_ts").alias("retrieved_at"), F.coalesce("truncated", F.lit(False)).alias("capped"))
    return bodies.join(notes, "key", "left").select("key", "url", F.coalesce("content_type", F.lit(UNKNOWN)).alias("content_type"), "retrieved_at", F.coalesce("capped", F.lit(False)).alias("capped"), "body")


def read(documents: DataFrame, long: int | None = LONG) -> DataFrame:
    """(key, url, mime, bytes, capped, render, title, text, markup, text_truncated): how each document is shown: html, text, pdf, image or
    binary. Text after `long` characters is left out (None: none is)."""
    mime = F.trim(F.split("content_type", ";")[0])
    render = (
        F.when(mime.isin("text/html", "application/xhtml+xml"), "html").when(mime == "application/pdf", "pdf").when(mime.startswith("image/"), "image")
        .when(mime.isin("application/json", "application/ld+json") | mime.startswith("text/") | mime.endswith("+xml") | mime.endswith("/xml"), "text").otherwise("binary")
    )
    rows = documents.select("key", "url", mime.alias("mime"), F.length("body").alias("bytes"), "capped", render.alias("render"), F.when(render.isin("html", "text"), F.col("body")).alias("body"), "content_type")
    rows = rows.withColumn("raw", decode("body", "content_type")).withColumn("p", read_page(F.when(F.col("render") == "html", F.col("raw"))))
    whole = F.when(F.col("render") == "html", F.col("p.text")).when(F.col("render") == "text", F.col("raw"))
    cut = whole if long is None else F.substring(whole, 1, long)
    more = F.coalesce(F.length(whole) > (F.lit(2**31 - 1) if long is None else F.lit(long)), F.lit(False))
    of = lambda c: F.when(F.col("render") == "html", F.col(f"p.{c}")).alias(c)
    return rows.select("key", "url", "mime", "bytes", "capped", "render", of("title"), cut.alias("text"), of("markup"), more.alias("text_truncated"))


def servable(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with status: whether a url can have a document at all: missing, unreadable and browser-only ones are unavailable."""
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    scripted = F.lit(False)
    for h in SCRIPTED:
        scripted = scripted | (host == h) | host.endswith(f".{h}")
    ok = (F.trim(F.coalesce(F.col(url), F.lit(""))) != "") & host.isNotNull() & ~scripted
    return urls.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("unavailable"))
