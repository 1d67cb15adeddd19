"""Quotation linking: replies are joined to the messages they quote, and conversations are put in reply order without quotes.

Each line of a message has a quote level (the marks before it) and a body; runs of lines of one level are passages. A message
offers hashes of its own passages (level 0): each line, each paragraph and the whole, normalised in case and white space.
A quoted passage links to the earliest earlier message of its conversation that offers its hash, or by its paragraphs or lines
where the passage was cut. A message replies to the latest message that its outermost quotes (level 1) link to, else to the
latest that deeper ones do. Threads hang from messages that reply to none; within a conversation threads come in the order
they begin, and messages of a thread in turn.

Each message is read once, in one pass over its lines, in the task that holds it; links, threads and order are DataFrame
operations. Offers are reduced to the least turn of each (conversation, hash) before they are shuffled, so a line that
everybody writes is one row a task. Positions in a conversation come from a range partitioning of all rows and prefix sums over
its partitions: a conversation with a third of all rows is spread over many tasks.

Null and empty texts have no lines: no own text, no links. Rows of one conversation and turn share their links and are put in
order of role and text. Rows with a null conv_id or turn are kept, link to nothing, and are threads of their own at the end.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import Scratch, map_rows, own, table

MARKS = r"^[ \t]*((?:>[ \t]?)*)"
ATTRIBUTION = r"(?i)^(on\b.*\bwrote|.{1,80}\b(wrote|schrieb|a écrit|escribió)):$"
#: Rows in a range partition, about.
RANGE_ROWS = 500_000


_MARKS, _ATTRIBUTION, _GAP = re.compile(MARKS), re.compile(ATTRIBUTION), re.compile(r"\n[ \t\x0b\f]*\n\s*", re.ASCII)
SPACES = " \t\n\x0b\x0c\r"


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(level, body) of each line; attributions above a quote (the next line that isn't blank is of a deeper level) have level -1."""
    out: list[tuple[int, str]] = []
    below = -1  # level of the next line that isn't blank
    for line in reversed((text or "").replace("\r", "").split("\n")):
        m = _MARKS.match(line)
        level = mine = m[1].count(">")
        if below > mine and _ATTRIBUTION.match(line.strip(" ")):
            level = -1
        out.append((level, line[m.end() :]))
        if line.strip(SPACES):
            below = mine
    return out[::-1]


def hashes(texts: list[str]) -> list[int]:
    """Distinct hashes of the texts that aren't blank, normalised in case and white space."""
    import xxhash

    bare = dict.fromkeys(" ".join(t.lower().split()) for t in texts)
    return [h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in bare if t)]


def parse(text: str | None) -> tuple[str, int, list[int], list[tuple[int, int, int]]]:
    """(own text, quoted lines, offers, quotes): hashes that the message offers; (passage, level, hash) that it quotes."""
    lines = lines_of(text)
    mine = [body for level, body in lines if level == 0]
    own_text = "\n".join(mine).strip(SPACES)
    offers = hashes([*mine, *_GAP.split(own_text), own_text])
    quotes: list[tuple[int, int, int]] = []
    passage, at = 0, 0
    while at < len(lines):
        end, level = at, lines[at][0]
        while end < len(lines) and lines[end][0] == level:
            end += 1
        if level > 0:
            bodies = [body for _, body in lines[at:end]]
            whole = "\n".join(bodies)
            quotes += [(passage, level, h) for h in hashes([whole, *_GAP.split(whole), *bodies])]
            passage += 1
        at = end
    return own_text, sum(level > 0 for level, _ in lines), offers, quotes


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, n_quoted, offers, quotes of each row."""
    quote = StructType([StructField("passage", IntegerType()), StructField("level", IntegerType()), StructField("h", LongType())])
    more = [StructField("own_text", StringType()), StructField("n_quoted", LongType()), StructField("offers", ArrayType(LongType())), StructField("quotes", ArrayType(quote))]

    def run(c: dict[str, list]) -> dict[str, list]:
        rows = [parse(t) for t in c["text"]]
        asked = [[{"passage": p, "level": lv, "h": h} for p, lv, h in q] for *_, q in rows]
        return {n: c[n] for n in ("conv_id", "turn", "role")} | {"own_text": [r[0] for r in rows], "n_quoted": [r[1] for r in rows], "offers": [r[2] for r in rows], "quotes": asked}

    return map_rows(messages, run, StructType([*(messages.schema[n] for n in ("conv_id", "turn", "role")), *more]))


def link(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of parsed messages that quote an earlier one of their conversation."""
    placed = rows.where("conv_id is not null and turn is not null")
    first = placed.select("conv_id", "turn", F.explode("offers").alias("h")).groupBy("conv_id", "h").agg(F.min("turn").alias("source"))
    asked = placed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.passage", "q.level", "q.h").distinct()
    met = asked.join(first, ["conv_id", "h"]).where(F.col("source") < F.col("turn"))
    outer, any_ = F.max(F.when(F.col("level") == 1, F.col("source"))), F.max("source")
    return met.groupBy("conv_id", "turn").agg(F.coalesce(outer, any_).alias("reply_to"), F.count_distinct("passage").alias("n_linked"))


def threads(links: DataFrame, work: Scratch) -> DataFrame:
    """(conv_id, turn, thread, depth) of messages with a link, by pointer doubling: as many rounds as log2 of the depth."""
    at = work.keep(links.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads0")
    k = 0
    while True:
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        joined = at.join(up, ["conv_id", "thread"], "left")
        if not joined.where("above is not null").take(1):
            return at
        k += 1
        at = work.keep(joined.select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), f"threads{k}")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, n_quoted (lines), n_linked (passages), reply_to, thread, depth, position (from 0) of each row."""
    spark = messages.sparkSession
    work = Scratch(spark, "quotes")
    read = work.keep(parsed(own(messages, "conv_id", "turn", "role", "text")), "read")
    links = work.keep(link(read), "links")
    hung = threads(links.select("conv_id", "turn", "reply_to"), work)
    rows = (
        read.select("conv_id", "turn", "role", "own_text", "n_quoted")
        .join(links, ["conv_id", "turn"], "left")
        .join(hung, ["conv_id", "turn"], "left")
        .withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)), "thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0)).cast("long")})
    )
    order = [F.asc_nulls_last("thread"), F.asc_nulls_last("turn"), F.asc_nulls_first("role"), F.asc("own_text")]
    n = read.count() // RANGE_ROWS + 1
    shuffles = max(int(n), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = work.keep(rows.repartitionByRange(shuffles, F.asc_nulls_last("conv_id"), *order).withColumn("part", F.spark_partition_id()), "dealt")
    before = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    local = dealt.withColumn("local", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)) - 1)
    return local.join(before, local["conv_id"].eqNullSafe(before["c"]) & (local["part"] == before["p"])).select(
        "conv_id", "turn", "role", "own_text", "n_quoted", "n_linked", "reply_to", "thread", "depth", (F.col("before") + F.col("local")).alias("position")
    )


def op5_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))
