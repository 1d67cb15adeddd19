"""Reported sub-awards, rolled up twice: by sub-awardee, of which the largest are kept, and below each by the prime that reported it.

Rows come from landed pages of search results, in the order of their page and place. A sub-awardee is its name in capitals; its identity
comes from the recipient that its first row names, where that is landed. Each prime gets one edge from each of its sub-awardees, however
many awards they share; a prime that is known from sub-awards alone is tied to the program too, so that the way to it exists.
Rows without a sub-awardee or a prime's name give nothing; amounts that aren't numbers count as 0; nobody supplies themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_id
from ..operators.walks import top

#: Sub-awardees of a program that are kept, awards that an edge names, primes that a program is evidenced by.
MAX_SUBS, NAMED, EVIDENCE = 40, 10, 5
ROWS = (
    "`Sub-Award ID` string, `Sub-Awardee Name` string, `Sub-Award Amount` string, `Prime Recipient Name` string, `Prime Award ID` string, `Sub-Award Date` string, `Sub-Award Description` string, "
    "sub_award_recipient_id string, prime_award_recipient_id string, prime_award_generated_internal_id string"
)
PAGES = f"id string, page int, results array<struct<{ROWS.replace(' string', ': string')}>>"
EDGE = ("supplier_id", "supplier", "consumer_id", "program", "tier", "amount", "award_count", "contract_ref", "sub_award_ids", "detail")


def rows_of(pages: DataFrame) -> DataFrame:
    """program, seq, sub, sub_key, sub_rid, amount, prime, prime_key, prime_rid, award, sub_award, about of landed pages (columns of PAGES)."""
    r = pages.select("id", "page", F.posexplode("results").alias("at", "r"))
    text = lambda c: F.coalesce(F.trim(F.col(f"r.`{c}`")), F.lit(""))
    some = lambda c: F.nullif(text(c), F.lit(""))
    prime_key = F.coalesce(some("prime_award_recipient_id"), F.concat(F.lit("name:"), F.upper(text("Prime Recipient Name"))))
    return r.select(
        F.col("id").alias("program"), F.struct("page", "at").alias("seq"), text("Sub-Awardee Name").alias("sub"), F.upper(text("Sub-Awardee Name")).alias("sub_key"), some("sub_award_recipient_id").alias("sub_rid"),
        F.coalesce(F.col("r.`Sub-Award Amount`").try_cast("double"), F.lit(0.0)).alias("amount"), text("Prime Recipient Name").alias("prime"), prime_key.alias("prime_key"), some("prime_award_recipient_id").alias("prime_rid"),
        some("Prime Award ID").alias("award"), some("Sub-Award ID").alias("sub_award"), some("Sub-Award Description").alias("about"),
    ).where("sub_key <> ''")


def _identified(df: DataFrame, recipients: DataFrame, rid: str, name: str) -> DataFrame:
    """df with node and label: of the landed recipient (rid, name, uei), or by the name alone."""
    none = F.lit(None).cast("string")
    known = recipients.select(F.col("rid").alias(rid), F.nullif(F.trim("name"), F.lit("")).alias("known"), F.nullif(F.trim("uei"), F.lit("")).alias("uei"))
    at = df.join(known, rid, "left").withColumn("label", F.coalesce("known", F.nullif(F.col(name), F.lit(""))))
    return at.withColumn("node", entity_id(F.col("uei"), none, none, F.col("label"))).drop("known", "uei")


def rolled_up(pages: DataFrame, recipients: DataFrame, primes: DataFrame, max_subs: int = MAX_SUBS) -> DataFrame:
    """EDGE: supplies of tier 2 from sub-awardees to primes, and of tier 1 from primes that primes (program, prime_key, node) doesn't have to
    their program. recipients: (rid, name, uei)."""
    rows = rows_of(pages)
    by_sub = rows.groupBy("program", "sub_key").agg(F.round(F.sum("amount"), 2).alias("total"), F.min_by(F.struct("sub", "sub_rid"), "seq").alias("first"))
    kept = top(by_sub, ["program"], [F.desc("total"), F.asc("sub_key")], max_subs).select("program", "sub_key", F.col("rank").alias("place"), "first.sub", "first.sub_rid")
    subs = _identified(kept, recipients, "sub_rid", "sub").where(F.col("label").isNotNull() & (F.col("node") != F.col("program"))).select("program", "sub_key", "place", F.col("node").alias("supplier_id"), F.col("label").alias("supplier"))

    key = ["program", "sub_key", "prime_key"]
    best = F.struct("amount", F.struct(-F.col("seq.page"), -F.col("seq.at")))
    of = rows.groupBy(*key).agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("award_count"), F.max_by(F.struct("award", "prime", "prime_rid", "about"), best).alias("lead"))
    named = top(rows.where("sub_award is not null"), key, [F.asc("seq")], NAMED).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "sub_award"))).alias("s")).select(*key, F.transform("s", lambda x: x["sub_award"]).alias("sub_award_ids"))
    pairs = subs.join(of, ["program", "sub_key"]).join(named, key, "left").withColumns({"prime": F.col("lead.prime"), "prime_rid": F.col("lead.prime_rid")})
    met = _identified(pairs, recipients, "prime_rid", "prime").join(primes.select("program", "prime_key", F.col("node").alias("had")), ["program", "prime_key"], "left")
    met = met.withColumn("consumer_id", F.coalesce("had", F.when(F.col("label").isNotNull() & (F.col("node") != F.col("program")), F.col("node")))).where("consumer_id is not null")

    below = met.where("consumer_id <> supplier_id").select("supplier_id", "supplier", "consumer_id", "program", F.lit(2).alias("tier"), "amount", "award_count", F.col("lead.award").alias("contract_ref"), F.coalesce("sub_award_ids", F.array().cast("array<string>")).alias("sub_award_ids"), F.coalesce(F.substring("lead.about", 1, 200), F.lit("reported sub-award")).alias("detail"))
    fresh = top(met.where("had is null"), ["program", "prime_key"], [F.asc("place")], 1)
    none = F.lit(None)
    above = fresh.select(F.col("node").alias("supplier_id"), F.col("label").alias("supplier"), F.col("program").alias("consumer_id"), "program", F.lit(1).alias("tier"), none.cast("double").alias("amount"), none.cast("long").alias("award_count"), F.col("lead.award").alias("contract_ref"), F.array().cast("array<string>").alias("sub_award_ids"), F.lit("prime of a reported sub-award").alias("detail"))
    return below.unionByName(above).select(*EDGE)


def award_facts(supplied: DataFrame, known_uei: DataFrame | None = None) -> DataFrame:
    """Facts beside the supply edges of prime awards (of payloads.usaspending(), with uei where it is known): what suppliers provide, by
    their code; the award that evidences a program, of its EVIDENCE largest; identifiers of suppliers that have none yet."""
    from .payloads import _all, _fact, _stated

    url = F.concat(F.lit("https://www.usaspending.gov/award/"), "contract_ref")
    say = lambda rows, *a, **k: rows.select(*_fact(*a, source="USAspending", **k))
    rows = supplied.withColumn("at", F.when(F.col("contract_ref").isNotNull(), url))
    lead = top(rows.where("at is not null"), ["program"], [F.desc("amount"), F.asc("id")], EVIDENCE)
    parts = [
        say(rows, "PROVIDES", object_=F.col("category"), confidence=0.7, detail=F.concat(F.lit("PSC "), "psc"), url=F.col("at")),
        say(lead, "mention", subject="program", value=F.col("contract_ref"), confidence=0.95, detail=F.lit("award record"), url=F.col("at")),
    ]
    if known_uei is not None:
        new = rows.join(known_uei.where("uei is not null").select("id"), "id", "left_anti")
        parts.append(say(new, "attr:uei", value=F.upper("uei"), confidence=0.95, url=F.col("at")))
    return _stated(_all(parts))
