"""Linked resources: landed JSON:API documents whose records point at each other across pages, joined into roles, ties and attributes.

Each landed body is one document: `data` (a record or a list) and `included`. Records are read once, as VARIANT; of a record that comes
on several pages the richest copy counts. Relationships name two records by number; a tie is told when the record at its far end has
been landed, on whatever page. The first rows of a record's page are its newest, and where only so many are kept, they are those.

Years without month or day begin them (2019-00-00 is 2019-01-01); the year 0000 is no date. A tie is current if it says so, or has no end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_id, person_id, whole_date
from ..operators.walks import top
from .payloads import _all, _fact, _stated

#: Numbers of the categories; types of organisations whose seats are followed; of people who hold public office; how many rows are kept.
POSITION, MEMBERSHIP, DONATION, TRANSACTION, LOBBYING, OWNERSHIP, HIERARCHY = 1, 3, 5, 6, 7, 10, 11
FOLLOWED = ("Government Body", "Business", "Public Company", "Private Company", "Lobbying Firm", "Law Firm", "Political Fundraising", "Industry/Trade Association", "Government Advisory Body")
OFFICE = ("Public Official", "Elected Representative", "Political Candidate", "Lobbyist")
PEOPLE, SEATS = 30, 12
#: Category, edge type, whether the first record is the edge's source, its confidence, rows that are kept.
TIES = ((MEMBERSHIP, "MEMBER_OF", True, 0.8, 12), (DONATION, "DONATED_TO", True, 0.8, 10), (TRANSACTION, "TRANSACTS_WITH", True, 0.8, 15), (LOBBYING, "LOBBIES", True, 0.8, 15), (OWNERSHIP, "OWNS", True, 0.8, 15), (HIERARCHY, "OWNS", False, 0.7, 15))
SITE = "https://littlesis.org"
TIE = ("subject", "src", "src_name", "type", "dst", "dst_name", "title", "role_type", "from", "to", "current", "pct", "amount", "via", "confidence", "detail", "url")


def records(pages: DataFrame) -> DataFrame:
    """kind, number, a (attributes, VARIANT), page, at of every record of landed pages (page, body: JSON). Bodies that aren't JSON give none."""
    parsed = pages.select("page", F.try_parse_json("body").alias("b"))
    each = None
    for part, many in (("data", True), ("data", False), ("included", True)):
        kind = F.schema_of_variant(F.try_variant_get("b", f"$.{part}", "variant"))
        rows = parsed.where(kind.startswith("ARRAY" if many else "OBJECT"))
        one = rows.select("page", F.posexplode(F.try_variant_get("b", f"$.{part}", "array<variant>")).alias("at", "r")) if many else rows.select("page", F.lit(0).alias("at"), F.try_variant_get("b", f"$.{part}", "variant").alias("r"))
        each = one if each is None else each.unionByName(one)
    get = lambda p, t: F.try_variant_get("r", f"$.{p}", t)
    return each.select(get("type", "string").alias("kind"), F.coalesce(get("id", "long"), get("attributes.id", "long")).alias("number"), get("attributes", "variant").alias("a"), "page", "at").where("number is not null and a is not null")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("a", f"$.{path}", kind)


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def entities(recs: DataFrame) -> DataFrame:
    """number, name, ext (Org, Person), types, node and what else a record says of itself; one row for each, of its longest copy."""
    e = recs.where("kind = 'entities'").withColumn("text", F.col("a").cast("string"))
    one = e.groupBy("number").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text")).withColumn("a", F.parse_json("text"))
    none, name, ext = F.lit(None).cast("string"), _some(_get("name")), _get("primary_ext")
    node = F.when(ext == "Person", person_id(name, F.concat(F.lit("littlesis:"), "number"))).otherwise(entity_id(none, none, none, name))
    listed = lambda p: F.coalesce(_get(p, "array<string>"), F.array().cast("array<string>"))
    plain = {"website": "website", "blurb": "blurb", "ticker": "extensions.PublicCompany.ticker", "cik": "extensions.PublicCompany.sec_cik", "lda_registrant_id": "extensions.Org.lda_registrant_id", "fedspending_id": "extensions.Org.fedspending_id"}
    whole = {"revenue": "extensions.Org.revenue", "employees": "extensions.Org.employees"}
    return one.select(
        "number", name.alias("name"), ext.alias("ext"), listed("types").alias("types"), listed("aliases").alias("aliases"), listed("tags").alias("tags"), *[_some(_get(p)).alias(n) for n, p in plain.items()], *[_get(p, "double").cast("long").alias(n) for n, p in whole.items()], node.alias("node"),
    ).where("name is not null")


def relationships(recs: DataFrame) -> DataFrame:
    """number, category, one, two, seq, role and other columns of each relationship; of copies the one on the first page."""
    r = recs.where("kind = 'relationships'").select(
        "number", _get("category_id", "int").alias("category"), _get("entity1_id", "long").alias("one"), _get("entity2_id", "long").alias("two"), F.struct("page", "at").alias("seq"), _some(_get("description1")).alias("title"), _some(_get("description")).alias("detail"),
        *[F.when(~F.coalesce(_get(c), F.lit("")).startswith("0000"), whole_date(_get(c))).alias(n) for n, c in (("from", "start_date"), ("to", "end_date"))], _get("is_current", "boolean").alias("says"), _get("amount", "double").alias("amount"),
        *[F.coalesce(_get(f"category_attributes.{c}", "boolean"), F.lit(False)).alias(n) for n, c in (("board", "is_board"), ("executive", "is_executive"))], _get("category_attributes.percent_stake", "double").alias("pct"),
    )
    first = r.groupBy("number").agg(F.min_by(F.struct(*[c for c in r.columns if c != "number"]), "seq").alias("r")).select("number", "r.*")
    return first.withColumn("current", F.coalesce("says", F.col("to").isNull())).where("one is not null and two is not null")


def _tie(rows: DataFrame, src: str, dst: str, type_: str | Column, confidence: float | Column, **more: Column) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None)
    has = lambda n, kind: more.get(n, none).cast(kind).alias(n)
    return rows.select(
        "subject", F.col(f"{src}.node").alias("src"), F.col(f"{src}.name").alias("src_name"), lit(type_).alias("type"), F.col(f"{dst}.node").alias("dst"), F.col(f"{dst}.name").alias("dst_name"), has("title", "string"), has("role_type", "string"), "from", "to", "current",
        has("pct", "double"), has("amount", "double"), has("via", "string"), lit(confidence).cast("double").alias("confidence"), "detail", F.concat(F.lit(f"{SITE}/relationships/"), "number").alias("url"),
    )


def _role(fallback: str = "Position") -> dict[str, Column]:
    title = F.coalesce("title", F.when(F.col("board"), "Director").when(F.col("executive"), "Executive").otherwise(fallback))
    return {"title": title, "role_type": F.when(F.col("board") & F.col("executive"), "both").when(F.col("board"), "board").when(F.col("executive"), "executive").otherwise("position")}


def _ends(rows: DataFrame, ents: DataFrame, name: str, column: str) -> DataFrame:
    """rows with the record that column numbers, as a struct of this name."""
    return rows.join(ents.select(F.col("number").alias(column), F.struct("number", "node", "name", "ext", "types").alias(name)), column)


def officers(subjects: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    """subject, number and the columns of rels and their person (p) of the first PEOPLE directors and executives of each subject (id, number)."""
    at = rels.where(F.col("category") == POSITION).join(subjects.select(F.col("id").alias("subject"), F.col("number").alias("two")), "two").where("board or executive")
    people = _ends(at, ents, "p", "one").where("p.ext = 'Person'")
    return top(people, ["subject"], [F.asc("seq"), F.asc("number")], PEOPLE, "k").drop("k")


def roles(subjects: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    """TIE: who sits on a subject's board or leads it, and the other seats of these people."""
    led = officers(subjects, ents, rels)
    own = _tie(led.join(subjects.select(F.col("id").alias("subject"), F.struct(F.col("id").alias("node"), "name").alias("o")), "subject"), "p", "o", "HELD_ROLE", 0.85, **_role())
    who = led.select("subject", "one", "p", F.col("two").alias("here")).dropDuplicates(["subject", "one"])
    other = who.join(rels.where(F.col("category") == POSITION), "one").where("two <> here")
    far = _ends(other, ents, "o", "two").where((F.col("o.ext") == "Org") & F.arrays_overlap("o.types", F.array(*map(F.lit, FOLLOWED))))
    kept = top(far, ["subject", "one"], [F.asc("seq"), F.asc("number")], SEATS, "k")
    return own.unionByName(_tie(kept, "p", "o", "HELD_ROLE", 0.8, **_role()))


def ties(subjects: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    """TIE: a subject's own memberships, donations, transactions, lobbying, ownership and hierarchy; of people only owners with a stake in it."""
    mine = F.struct(F.col("id").alias("node"), "name").alias("me")
    either = None
    for side, far in (("one", "two"), ("two", "one")):
        one = rels.join(subjects.select(F.col("id").alias("subject"), F.col("number").alias(side), mine), side).withColumns({"other": F.col(far), "first": F.lit(side == "one")})
        either = one if either is None else either.unionByName(one)
    met = _ends(either.where("one <> two").select(*either.columns), ents, "o", "other")
    owner = met.where((F.col("o.ext") == "Person") & (F.col("category") == OWNERSHIP) & ~F.col("first") & (F.col("pct") > 0))
    out = [_tie(owner, "o", "me", "BENEFICIAL_OWNER_OF", 0.75, pct=F.col("pct"))]
    for category, type_, forward, confidence, most in TIES:
        rows = top(met.where((F.coalesce("o.ext", F.lit("")) != "Person") & (F.col("category") == category)), ["subject"], [F.asc("seq"), F.asc("number")], most, "k")
        more = {"pct": F.col("pct") if category == OWNERSHIP else F.lit(None), "amount": F.col("amount"), "via": F.lit("hierarchy" if category == HIERARCHY else None)}
        left = F.col("first") if forward else ~F.col("first")
        out += [_tie(rows.where(left), "me", "o", type_, confidence, **more), _tie(rows.where(~left), "o", "me", type_, confidence, **more)]
    return _all(out)


def facts(subjects: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    """What the record of each subject says of itself, the size of its board over all its rows, and which of its officers hold public office."""
    me = subjects.select("id", "number").join(ents.drop("name"), "number")
    url = F.concat(F.lit(f"{SITE}/org/"), "number")
    say = lambda rows, *a, **k: rows.select(*_fact(*a, source="LittleSis", trust="open", **k))
    joined = lambda c: F.nullif(F.array_join(F.array_distinct(F.filter(c, lambda x: x != "")), " | "), F.lit(""))
    values = {
        "littlesis_id": (F.col("number"), 0.9), "ticker": (F.col("ticker"), 0.9), "public": (F.when(F.col("ticker").isNotNull(), "true"), 0.9), "cik": (F.col("cik"), 0.9), "revenue": (F.nullif("revenue", F.lit(0)), 0.7), "employees": (F.nullif("employees", F.lit(0)), 0.7),
        "lda_registrant_id": (F.col("lda_registrant_id"), 0.9), "fedspending_id": (F.col("fedspending_id"), 0.85), "website": (F.when(F.col("website").rlike("^https?://"), F.col("website")), 0.8), "aliases_text": (joined("aliases"), 0.85), "blurb": (F.substring("blurb", 1, 500), 0.7),
        "org_types": (joined("types"), 0.8), "littlesis_tags": (joined("tags"), 0.8),
    }
    seats = rels.where((F.col("category") == POSITION) & F.col("board") & F.col("current") & F.col("to").isNull()).join(subjects.select("id", F.col("number").alias("two")), "two")
    size = seats.groupBy("id", F.col("two").alias("number")).agg(F.count("*").alias("n"))
    public = officers(subjects, ents, rels).where(F.arrays_overlap("p.types", F.array(*map(F.lit, OFFICE)))).select(F.col("p.node").alias("node"), "one", F.col("p.types").alias("types")).distinct()
    return _stated(_all([
        *[say(me, f"attr:{n}", value=c, confidence=sure, url=url) for n, (c, sure) in values.items()],
        say(size, "attr:board_size", value=F.col("n"), confidence=0.7, url=url),
        say(public, "attr:public_official", subject="node", value=F.lit("true"), confidence=0.8, detail=F.array_join("types", " | "), url=F.concat(F.lit(f"{SITE}/person/"), "one")),
    ]))
