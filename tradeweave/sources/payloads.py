"""Facts from landed payloads: JSON pages that a crawler has written, read with a schema, exploded and mapped by expressions.

A fact is a row (subject_id, predicate, object_id, object_value, source, trust, confidence, detail, url, published_at): what claims are
made of. Payloads carry the id of the node that they were asked for. Missing fields and empty lists give no facts.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import country_code, entity_id, is_sole_source, location_id, scrub_url

#: Forms that become mentions, annual and late forms, days until an annual report is overdue.
FORMS = ("10-K", "10-Q", "8-K", "20-F", "6-K", "40-F", "NT 10-K", "NT 10-Q", "NT 20-F", "DEF 14A", "SC 13D", "SC 13G")
ANNUAL, LATE, OVERDUE_DAYS, MENTIONS = ("10-K", "20-F", "40-F"), ("NT 10-K", "NT 10-Q", "NT 20-F"), 500, 12
#: Categories of product and service codes, by what the code begins with; other codes by whether a digit leads.
PSC = """
15 cat_structures | 16 cat_aircraft_components | 28 cat_engines | 29 cat_engines | 58 cat_avionics | 59 cat_avionics | 61 cat_avionics | 66 cat_avionics
70 cat_it_hardware | 53 cat_hardware | 47 cat_hardware | 95 cat_metals | 96 cat_metals | 10 cat_weapons | 11 cat_weapons | 12 cat_weapons | 13 cat_weapons | 14 cat_weapons
23 cat_vehicles | 24 cat_vehicles | J cat_maintenance | N cat_maintenance | R cat_professional | T cat_professional | Q cat_professional | B cat_professional | E cat_professional
A cat_rdte | D cat_it_services | U cat_training | V cat_logistics | W cat_logistics | Y cat_construction | Z cat_construction
H cat_engineering | L cat_engineering | K cat_engineering | C cat_engineering
S cat_other_services | F cat_other_services | G cat_other_services | M cat_other_services | P cat_other_services | X cat_other_services
"""
OTHER_GOODS, OTHER_SERVICES = "cat_other_goods", "cat_other_services"
FACT = ("subject_id", "predicate", "object_id", "object_value", "source", "trust", "confidence", "detail", "url", "published_at")


def _fact(predicate: str | Column, source: str, subject: str = "id", object_: Column | None = None, value: Column | None = None, confidence: float | Column = 1.0, detail: Column | None = None, url: Column | None = None, at: Column | None = None, trust: str = "authoritative") -> list[Column]:
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [F.col(subject).alias("subject_id"), lit(predicate).alias("predicate"), text(object_).alias("object_id"), text(value).alias("object_value"), F.lit(source).alias("source"), F.lit(trust).alias("trust"),
            lit(confidence).cast("double").alias("confidence"), text(detail).alias("detail"), text(url).alias("url"), text(at).alias("published_at")]


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _stated(facts: DataFrame) -> DataFrame:
    return facts.where(F.coalesce("object_id", "object_value").isNotNull() & (F.coalesce("object_value", F.lit("x")) != ""))


def psc_category(code: Column) -> Column:
    """By the first two characters of a code, or its first; codes of none of these by whether a digit leads. Null and empty: null."""
    known = dict(pair.split() for line in PSC.strip().splitlines() for pair in line.split(" | "))
    table, c = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.upper(code)
    other = F.when(c.rlike("^[0-9]"), OTHER_GOODS).otherwise(OTHER_SERVICES)
    return F.when(c != "", F.coalesce(table[F.substring(c, 1, 2)], table[F.substring(c, 1, 1)], other))


def payload_key(method: Column, url: Column, body: Column) -> Column:
    """The key that a payload is landed under: the same for urls that differ in credentials alone."""
    return F.sha1(F.concat_ws("|", F.upper(method), scrub_url(url), F.coalesce(body, F.lit(""))))


def latest_payloads(landed: DataFrame, now: Column, ttl: int) -> DataFrame:
    """The last payload of each key (key, fetched_at timestamp, ...) that is no older than ttl seconds."""
    fresh = landed.where(F.unix_timestamp(now) - F.unix_timestamp("fetched_at") <= ttl)
    return fresh.groupBy("key").agg(F.max_by(F.struct(*[c for c in fresh.columns if c != "key"]), "fetched_at").alias("r")).select("key", "r.*")


def located(narrow: DataFrame, url: Column, key: str = "key") -> DataFrame:
    """key, payload of landed payloads (key, url, payload) for a url, or for one that mentions its last path segment; exact ones first."""
    token = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    rank = F.when(scrub_url(F.col("url")) == scrub_url(url), 0).when((token != "") & F.col("payload").contains(token), 1)
    return narrow.select(key, "payload", rank.alias("rank")).where("rank is not null").orderBy("rank", key).limit(3)


def narrowed(rows: Column, token: str) -> Column:
    """The first element of a list that mentions the token."""
    return F.get(F.filter(rows, lambda x: F.to_json(x).contains(token)), F.lit(0))


GLEIF = "id string, lei string, country string, region string, legal_name string, status string, parent struct<lei: string, name: string, country: string>, ultimate struct<lei: string, name: string, country: string>, score double"


def gleif(records: DataFrame) -> DataFrame:
    """Facts of registry records (columns of GLEIF; score: of the match by name, null where the identifier was known)."""
    sure = F.when(F.col("score").isNull(), 1.0).when(F.col("score") < 97, 0.85).otherwise(0.95)
    none = F.lit(None).cast("string")
    url = F.concat(F.lit("https://search.gleif.org/#/record/"), "lei")
    code = F.when((F.col("country") == "US") & F.col("region").startswith("US-"), F.col("region")).otherwise(F.col("country"))
    of = lambda p: entity_id(none, F.col(f"{p}.lei"), none, F.col(f"{p}.name"))
    r = records.withColumns({"p": of("parent"), "u": of("ultimate")})
    has_p, has_u = F.col("parent.lei").isNotNull(), F.col("ultimate.lei").isNotNull()
    say = lambda rows, *a, **k: rows.select(*_fact(*a, source="GLEIF", url=url, **k))
    own = ~has_p & ~has_u & F.col("country").isNotNull()
    return _stated(_all([
        say(r.where(F.col("score").isNotNull()), "attr:lei", value=F.col("lei"), confidence=sure),
        say(r, "attr:legal_name", value=F.col("legal_name"), confidence=sure),
        say(r, "attr:entity_status", value=F.col("status"), confidence=sure),
        say(r, "INCORPORATED_IN", object_=location_id(code), confidence=sure),
        say(r.where(has_p), "OWNS", subject="p", object_=F.col("id"), confidence=sure),
        say(r.where(has_p), "INCORPORATED_IN", subject="p", object_=location_id(F.col("parent.country")), confidence=sure),
        say(r.where(has_u), "ULTIMATE_PARENT_OF", subject="u", object_=F.col("id"), confidence=sure),
        say(r.where(has_u), "INCORPORATED_IN", subject="u", object_=location_id(F.col("ultimate.country")), confidence=sure),
        say(r.where(has_u), "PARENT_SEATED_IN", object_=location_id(F.col("ultimate.country")), confidence=sure),
        say(r.where(own), "PARENT_SEATED_IN", object_=location_id(F.col("country")), confidence=sure * 0.9),
    ]))


SAM = (
    "id string, entityRegistration struct<ueiSAM: string, cageCode: string, legalBusinessName: string, registrationStatus: string, registrationExpirationDate: string, exclusionStatusFlag: string>, "
    "coreData struct<generalInformation: struct<organizationStructureDesc: string, countryOfIncorporationCode: string, stateOfIncorporationCode: string>, entityInformation: struct<entityStartDate: string>, "
    "physicalAddress: struct<countryCode: string, stateOrProvinceCode: string>>, assertions struct<goodsAndServices: struct<naicsList: array<struct<naicsCode: string>>>>"
)


def sam(records: DataFrame) -> DataFrame:
    """Facts of registrations (columns of SAM)."""
    reg, core = "entityRegistration.", "coreData."
    url = F.concat(F.lit("https://sam.gov/entity/"), F.coalesce(F.col(f"{reg}ueiSAM"), F.lit("")))
    say = lambda *a, **k: records.select(*_fact(*a, source="SAM.gov", url=url, **k))
    values = {"uei": f"{reg}ueiSAM", "cage": f"{reg}cageCode", "legal_name": f"{reg}legalBusinessName", "registration_status": f"{reg}registrationStatus", "registration_expires": f"{reg}registrationExpirationDate", "organization_structure": f"{core}generalInformation.organizationStructureDesc"}
    place = lambda c, s: location_id(country_code(F.nullif(F.col(core + c), F.lit("")), F.col(core + s)))
    codes = F.array_join(F.slice(F.filter(F.col("assertions.goodsAndServices.naicsList")["naicsCode"], lambda x: x.isNotNull()), 1, 20), ",")
    return _stated(_all([
        *[say(f"attr:{n}", value=F.col(c)) for n, c in values.items()],
        say("attr:sam_registered", value=F.lit("true")),
        say("attr:incorporation_date", value=F.col(f"{core}entityInformation.entityStartDate"), confidence=0.9),
        say("attr:naics_codes", value=codes),
        say("OPERATES_IN", object_=place("physicalAddress.countryCode", "physicalAddress.stateOrProvinceCode"), confidence=0.95),
        say("INCORPORATED_IN", object_=place("generalInformation.countryOfIncorporationCode", "generalInformation.stateOfIncorporationCode")),
        say("exclusion_screen", value=F.when(F.col(f"{reg}exclusionStatusFlag") == "Y", "hit"), confidence=0.95),
    ]))


EDGAR = "id string, cik long, recent struct<form: array<string>, filingDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>>"


def filings(records: DataFrame) -> DataFrame:
    """id, at, form, filed, url: a row for each filing of columnar lists (columns of EDGAR)."""
    rows = records.select("id", "cik", F.posexplode(F.arrays_zip("recent.form", "recent.filingDate", "recent.accessionNumber", "recent.primaryDocument")).alias("at", "f"))
    url = F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), "cik", F.regexp_replace("f.accessionNumber", "-", ""), "f.primaryDocument")
    return rows.select("id", "at", F.col("f.form").alias("form"), F.col("f.filingDate").alias("filed"), url.alias("url"))


def edgar(records: DataFrame, today: datetime.date) -> DataFrame:
    """Mentions of the first MENTIONS filings that matter, and a screen of how a company files: late is medium, overdue or none low."""
    rows = filings(records).withColumn("matters", F.col("form").isin(*FORMS))
    from pyspark.sql import Window

    nth = F.count_if("matters").over(Window.partitionBy("id").orderBy("at"))
    shown = rows.withColumn("nth", nth).where(F.col("matters") & (F.col("nth") <= MENTIONS))
    mentions = shown.select(*_fact("mention", source="EDGAR", value=F.col("form"), url=F.col("url"), at=F.col("filed"), detail=F.concat("form", F.lit(" filing"))))
    cut = shown.groupBy("id").agg(F.max("nth").alias("n"), F.max("at").alias("last"))
    seen = rows.join(cut, "id", "left").where(F.col("n").isNull() | (F.col("n") < MENTIONS) | (F.col("at") <= F.col("last")))
    graded = seen.groupBy("id").agg(F.bool_or(F.col("form").isin(*LATE)).alias("late"), F.max(F.when(F.col("form").isin(*ANNUAL), F.col("filed"))).alias("annual"))
    stale = F.col("annual").isNull() | F.coalesce(F.date_diff(F.lit(today), F.try_to_date(F.substring("annual", 1, 10), "yyyy-MM-dd")) > OVERDUE_DAYS, F.lit(False))
    screen = F.when(F.col("late"), "medium").when(stale, "low").otherwise("clear")
    return mentions.unionByName(graded.select(*_fact("financial_screen", source="EDGAR", value=screen, confidence=0.7)))


def tickers(table: DataFrame) -> DataFrame:
    """cik, ticker, title of a JSON object of rows (column value)."""
    rows = F.explode(F.map_values(F.from_json("value", "map<string, struct<cik_str: long, ticker: string, title: string>>")))
    return table.select(rows.alias("r")).select(F.col("r.cik_str").alias("cik"), "r.ticker", "r.title")


GDELT = "id string, articles array<struct<url: string, title: string, seendate: string, domain: string, sentiment: string>>"


def seen_at(c: Column) -> Column:
    """20240131T101500Z as 2024-01-31T10:15:00Z."""
    return F.when(c.rlike(r"^[0-9]{8}T[0-9]{6}Z$"), F.regexp_replace(c, r"^(....)(..)(..)T(..)(..)(..)Z$", "$1-$2-$3T$4:$5:$6Z"))


def gdelt(records: DataFrame) -> DataFrame:
    """A mention for each article and a screen of the press: three bad ones are medium, one low; not scored, clear with less confidence."""
    a = records.select("id", F.explode("articles").alias("a"))
    mentions = a.select(*_fact("mention", source="GDELT", value=F.col("a.title"), confidence=0.5, url=F.col("a.url"), at=seen_at(F.col("a.seendate")), trust="open"))
    bad = F.count_if(F.col("a.sentiment") == "negative")
    of = a.groupBy("id").agg(bad.alias("bad"), F.count("a.sentiment").alias("scored"), F.count("*").alias("n"))
    value = F.when(F.col("bad") >= 3, "medium").when(F.col("bad") >= 1, "low").otherwise("clear")
    screen = _fact("adverse_media_screen", source="GDELT", value=value, confidence=F.when(F.col("scored") > 0, 0.6).otherwise(0.4), detail=F.concat("n", F.lit(" recent articles")), trust="open")
    return mentions.unionByName(of.select(*screen))


AWARDS = "id string, award_id string, recipient string, recipient_uei string, amount double, psc string, extent string, offers string, solicitation string"


def usaspending(awards: DataFrame, max_primes: int = 25) -> DataFrame:
    """id (supplier), name, program, tier, amount, award_count, contract_ref, sole_source, psc, category: the largest recipients of each program's
    awards (columns of AWARDS, a row an award), described by their largest award. A program doesn't supply itself."""
    none = F.lit(None).cast("string")
    rows = awards.where(F.trim("recipient") != "").withColumn("supplier", entity_id(F.col("recipient_uei"), none, none, F.col("recipient"))).where("supplier <> id")
    lead = F.max(F.struct(F.coalesce("amount", F.lit(0.0)).alias("amount"), "award_id", "psc", "extent", "offers", "recipient", "solicitation")).alias("lead")
    of = rows.groupBy("id", "supplier").agg(F.round(F.sum(F.coalesce("amount", F.lit(0.0))), 2).alias("amount"), F.count("*").alias("award_count"), lead)
    from ..operators.walks import top

    kept = top(of, ["id"], [F.desc("amount"), F.asc("supplier")], max_primes)
    return kept.select(
        F.col("supplier").alias("id"), F.col("lead.recipient").alias("name"), F.col("id").alias("program"), F.lit(1).alias("tier"), "amount", "award_count", F.col("lead.award_id").alias("contract_ref"),
        is_sole_source(F.col("lead.extent"), F.col("lead.offers"), F.col("lead.solicitation")).alias("sole_source"), F.col("lead.psc").alias("psc"), psc_category(F.col("lead.psc")).alias("category"),
    )
