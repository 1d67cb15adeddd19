"""Landed payloads read as fields: parsed once to VARIANT, recognised by their shape, mapped or flattened to (section, label, value).

What a shape shows is a list of paths by shape, so a new shape is rows, not code. Payloads of no known
shape go to a table function that flattens them in the order they were written: scalars of a level first, then what is
nested, DEPTH levels down, MOST fields in all.

Payloads that aren't JSON, or are a bare scalar, give no fields. Null, empty and missing values are left out. Truth values read yes and
no, nested values as JSON of at most NESTED characters, texts end after LONG ones. Numbers of mapped fields lose trailing zeros.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.text import is_sole_source

DEPTH, MOST, LISTED, NESTED, LONG, NAMES, ITEMS = 2, 120, 12, 400, 4000, 6, 20
#: How a payload announces its shape, in order: the first path that it has.
PROBES = """
usaspending_award: generated_unique_award_id
usaspending_recipient: recipient_level
gleif_lei: data.attributes.lei
sam_entity: entityRegistration.ueiSAM
edgar_submissions: filings.recent.accessionNumber
edgar_filing: primaryDocument
littlesis_relationship: data.attributes.related
littlesis_entity: data.attributes.primary_ext
"""
#: The fields of each shape by section, as label = path, with a format where one applies.
FIELDS = """
usaspending_award / Award: Award ID = piid; Unique ID = generated_unique_award_id; Type = type_description; Category = category; Description = description; Obligated = total_obligation money; Base + all options = base_and_all_options money; Signed = date_signed date; Sub-awards = subaward_count; Sub-award total = total_subaward_amount money
usaspending_award / Recipient: Name = recipient.recipient_name; UEI = recipient.recipient_uei; Parent = recipient.parent_recipient_name; Parent UEI = recipient.parent_recipient_uei; Address = recipient.location addr; Business types = recipient.business_categories list
usaspending_award / Agency: Awarding = awarding_agency.toptier_agency.name; Awarding sub-agency = awarding_agency.subtier_agency.name; Awarding office = awarding_agency.office_agency_name; Funding = funding_agency.toptier_agency.name; Funding sub-agency = funding_agency.subtier_agency.name; Parent IDV = parent_award.piid; IDV type = parent_award.type_of_idc_description
usaspending_award / Period of performance: Start = period_of_performance.start_date date; End = period_of_performance.end_date date; Potential end = period_of_performance.potential_end_date date; Last modified = period_of_performance.last_modified_date date; Place of performance = place_of_performance addr
usaspending_award / Competition: Extent competed = latest_transaction_contract_data.extent_competed_description; Solicitation procedures = latest_transaction_contract_data.solicitation_procedures_description; Other than full and open = latest_transaction_contract_data.other_than_full_and_open_description; Offers received = latest_transaction_contract_data.number_of_offers_received; Set-aside = latest_transaction_contract_data.type_set_aside_description; Contract pricing = latest_transaction_contract_data.type_of_contract_pricing; Subcontracting plan = latest_transaction_contract_data.subcontracting_plan; Commercial item = latest_transaction_contract_data.commercial_item_acquisition_description
usaspending_award / Classification: PSC = psc_hierarchy.base_code.code; PSC description = psc_hierarchy.base_code.description; PSC group = psc_hierarchy.midtier_code.description; NAICS = naics_hierarchy.base_code.code; NAICS description = naics_hierarchy.base_code.description
usaspending_recipient / Recipient: Name = name; UEI = uei; Level = recipient_level; Parent = parent_name; Parent UEI = parent_uei; Total awarded = total_prime_amount money; Prime awards = total_prime_awards; Business types = business_types list; Address = location addr
gleif_lei / Entity: LEI = data.attributes.lei; Legal name = data.attributes.entity.legalName.name; Other names = data.attributes.entity.otherNames names; Jurisdiction = data.attributes.entity.jurisdiction; Legal form = data.attributes.entity.legalForm.id; Category = data.attributes.entity.category; Status = data.attributes.entity.status; Registered as = data.attributes.entity.registeredAs; Created = data.attributes.entity.creationDate date; Successor = data.attributes.entity.successorEntity.name
gleif_lei / Addresses: Legal address = data.attributes.entity.legalAddress gleif_addr; Headquarters = data.attributes.entity.headquartersAddress gleif_addr
gleif_lei / Registration: Status = data.attributes.registration.status; First registered = data.attributes.registration.initialRegistrationDate date; Last updated = data.attributes.registration.lastUpdateDate date; Next renewal = data.attributes.registration.nextRenewalDate date; Corroboration = data.attributes.registration.corroborationLevel; Managing LOU = data.attributes.registration.managingLou; Conformity = data.attributes.conformityFlag
sam_entity / Registration: Legal business name = entityRegistration.legalBusinessName; DBA name = entityRegistration.dbaName; UEI = entityRegistration.ueiSAM; CAGE = entityRegistration.cageCode; Status = entityRegistration.registrationStatus; Purpose = entityRegistration.purposeOfRegistrationDesc; Registered = entityRegistration.registrationDate date; Expires = entityRegistration.registrationExpirationDate date; Last updated = entityRegistration.lastUpdateDate date; Activation = entityRegistration.activationDate date
sam_entity / Core data: Entity structure = coreData.generalInformation.entityStructureDesc; Organization start = coreData.generalInformation.entityStartDate date; State of incorporation = coreData.generalInformation.stateOfIncorporationCode; Country of incorporation = coreData.generalInformation.countryOfIncorporationCode; Business types = coreData.businessTypes.businessTypeList list
edgar_submissions / Filer: Name = name; CIK = cik; Entity type = entityType; SIC = sic; Industry = sicDescription; Tickers = tickers list; Exchanges = exchanges list; State of incorporation = stateOfIncorporation; EIN = ein; LEI = lei; Filer category = category; Fiscal year end = fiscalYearEnd; Phone = phone; Business address = addresses.business sec_addr
edgar_filing / Filing: Form = form; Filed = filingDate date; Period = reportDate date; Accepted = acceptanceDateTime date; Accession = accessionNumber; Primary document = primaryDocument; Description = primaryDocDescription; Items = items; File number = fileNumber; Size = size
littlesis_entity / Entity: Name = data.attributes.name; Type = data.attributes.primary_ext; Blurb = data.attributes.blurb; Summary = data.attributes.summary; Website = data.attributes.website; Aliases = data.attributes.aliases list; Types = data.attributes.types list; Start = data.attributes.start_date date; End = data.attributes.end_date date; Updated = data.attributes.updated_at date; Page = data.links.self
littlesis_relationship / Relationship: Description = data.attributes.description; Entity = data.attributes.entity.name; Related = data.attributes.related.name; Category = data.attributes.category_id; Title = data.attributes.extensions.Position.title; Board member = data.attributes.extensions.Position.is_board; Executive = data.attributes.extensions.Position.is_executive; Start = data.attributes.start_date date; End = data.attributes.end_date date; Current = data.attributes.is_current; Page = data.links.self
"""
#: Fixed value: the section of payloads of no known shape.
SOURCE = "Source payload"
AWARD, COMPETITION = "usaspending_award", "Competition"


def probes() -> list[tuple[str, str]]:
    return [tuple(line.split(": ")) for line in PROBES.strip().splitlines()]


def field_rows() -> list[tuple[str, str, int, str, str, str | None]]:
    """(shape, section, at, label, path, format) of all mapped fields; at: their order in the shape, in even numbers."""
    out: list[tuple] = []
    counts: dict[str, int] = {}
    for line in FIELDS.strip().splitlines():
        where, _, rest = line.partition(": ")
        shape, section = where.split(" / ")
        for one in rest.split("; "):
            label, _, path = one.partition(" = ")
            path, _, form = path.partition(" ")
            counts[shape] = counts.get(shape, 0) + 2
            out.append((shape, section, counts[shape], label, path, form or None))
    return out


def _at(body: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(body, f"$.{path}", kind)


def shape_of(body: Column) -> Column:
    """The first shape whose path the VARIANT has with a value; null for none."""
    found = [F.when(_at(body, path).isNotNull(), name) for name, path in probes()]
    return F.when(F.schema_of_variant(body).startswith("OBJECT"), F.coalesce(*found))


def _joined(*parts: Column) -> Column:
    return F.nullif(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ", "), F.lit(""))


def _address(raw: Column, names: str) -> Column:
    return _joined(*[_at(raw, n) for n in names.split()])


def shown(raw: Column, text: Column) -> Column:
    """What a value reads as, without a format."""
    kind = F.schema_of_variant(raw)
    whole = F.when(kind == "BOOLEAN", F.when(text == "true", "yes").otherwise("no")).when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.when(~text.isin("{}", "[]"), F.substring(text, 1, NESTED))).otherwise(text)
    return F.when(F.length(whole) > LONG, F.concat(F.substring(whole, 1, LONG), F.lit(" …"))).otherwise(F.nullif(whole, F.lit("")))


def formatted(raw: Column, text: Column, form: Column) -> Column:
    """raw (VARIANT; text: the same cast to string) under a format, or null."""
    listed = F.filter(F.try_variant_get(raw, "$", "array<string>"), lambda x: x.isNotNull())
    more = F.when(F.size(listed) > LISTED, F.concat(F.lit(" (+"), F.size(listed) - LISTED, F.lit(" more)"))).otherwise("")
    named = F.filter(F.transform(F.slice(F.try_variant_get(raw, "$", "array<struct<name: string>>"), 1, NAMES), lambda x: x["name"]), lambda x: x.isNotNull() & (x != ""))
    country = F.when(F.coalesce(_at(raw, "location_country_code"), F.lit("")) != "USA", _at(raw, "country_name"))
    lines = F.try_variant_get(raw, "$.addressLines", "array<string>")
    by = {
        "money": F.concat(F.lit("$"), F.format_number(text.try_cast("double"), 0)),
        "date": F.substring(text, 1, 10),
        "list": F.when(F.size(listed) > 0, F.concat(F.array_join(F.slice(listed, 1, LISTED), ", "), more)),
        "names": F.when(F.size(named) > 0, F.array_join(named, ", ")),
        "addr": _joined(_at(raw, "address_line1"), _at(raw, "city_name"), F.coalesce(F.nullif(_at(raw, "state_code"), F.lit("")), _at(raw, "state_name")), _at(raw, "zip5"), country),
        "gleif_addr": _joined(F.nullif(F.array_join(F.filter(lines, lambda x: x != ""), ", "), F.lit("")), _at(raw, "city"), _at(raw, "region"), _at(raw, "postalCode"), _at(raw, "country")),
        "sec_addr": _address(raw, "street1 street2 city stateOrCountry zipCode"),
    }
    out = F.lit(None).cast("string")
    for name, c in by.items():
        out = F.when(form == name, c).otherwise(out)
    return F.when(form.isNull(), shown(raw, text)).otherwise(F.nullif(out, F.lit("")))


def parsed(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """landed with body (VARIANT; null where the payload isn't JSON) and shape."""
    return landed.withColumn("body", F.try_parse_json(payload)).withColumn("shape", shape_of(F.col("body")))


class _Flatten:
    """A table function of (payload[, href]): at, label, value, and where they are asked for, links."""

    @staticmethod
    def analyze(payload: AnalyzeArgument, links: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(payload.dataType, StringType):
            raise ValueError("flatten takes JSON text")
        columns = [StructField("at", IntegerType()), StructField("label", StringType()), StructField("value", StringType())]
        return AnalyzeResult(StructType(columns + [StructField("href", StringType())] * bool(links.value)))

    def eval(self, payload: str, links: bool) -> Iterator[tuple]:
        try:
            body = json.loads(payload or "null", parse_float=str)
        except ValueError:
            return
        for at, (label, value) in enumerate(flattened(body, "", 0)):
            yield (at + 1, label, value, href_of(value)) if links else (at + 1, label, value)


flatten = F.udtf(_Flatten)


def href_of(value: str) -> str | None:
    return value if value.startswith(("http://", "https://")) and " " not in value else None


def flattened(body: object, above: str, depth: int) -> list[tuple[str, str]]:
    """(label, value) of the scalars of a JSON value, then of what is nested in it; labels name the way down."""
    entries = body.items() if isinstance(body, dict) else ((str(i), x) for i, x in enumerate(body[:ITEMS])) if isinstance(body, list) else ()
    here, below = [], []
    for key, x in entries:
        name = key.replace("_", " ").strip().capitalize()
        label = f"{above} › {name}" if above else name
        if isinstance(x, dict | list) and depth < DEPTH:
            below.append((label, x))
        elif x not in (None, "", [], {}) or x is False or (x == 0 and isinstance(x, int)):
            text = ("yes" if x else "no") if isinstance(x, bool) else json.dumps(x, separators=(",", ":"), ensure_ascii=False)[:NESTED] if isinstance(x, dict | list) else str(x)
            here.append((label, text[:LONG] + " …" if len(text) > LONG else text))
    for label, x in below:
        if len(here) < MOST:
            here += flattened(x, label, depth + 1)
    return here[:MOST]


def _mapped(known: DataFrame) -> DataFrame:
    fields: dict[str, list[Column]] = {}
    for shape, section, at, label, path, form in field_rows():
        one = F.struct(F.lit(section).alias("section"), F.lit(at).alias("at"), F.lit(label).alias("label"), F.lit(form).cast("string").alias("form"), _at(F.col("body"), path, "variant").alias("raw"))
        fields.setdefault(shape, []).append(one)
    every = F.coalesce(*[F.when(F.col("shape") == shape, F.array(*some)) for shape, some in fields.items()])  # paths that are literals are parsed once, not once a row
    met = known.select("*", F.explode(F.filter(every, lambda x: x["raw"].isNotNull())).alias("f")).select(*[c for c in known.columns if c != "body"], "f.*")
    raw = met.withColumn("text", F.col("raw").cast("string"))
    return raw.withColumn("value", formatted(F.col("raw"), F.col("text"), F.col("form"))).where("value is not null")


def payload_fields(landed: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """(key, shape, section, at, label, value, href) of landed payloads (key, JSON text). Awards say, before their other fields of
    competition, whether they have a sole source."""
    rows = parsed(landed.select(key, F.col(payload).cast("string").alias("payload")))
    none = F.lit(None).cast("string")
    known = rows.where("shape is not null")
    mapped = _mapped(known.select(key, "body", "shape")).select(key, "shape", "section", "at", "label", "value")
    deal = "latest_transaction_contract_data."
    extent, way, offers = _at(F.col("body"), deal + "extent_competed_description"), _at(F.col("body"), deal + "solicitation_procedures_description"), _at(F.col("body"), deal + "number_of_offers_received")
    first = min(r[2] for r in field_rows() if r[:2] == (AWARD, COMPETITION))
    said = F.lit(False)
    for r in field_rows():
        if r[:2] == (AWARD, COMPETITION):
            said = said | (F.coalesce(_at(F.col("body"), r[4]), F.lit("")) != "")
    sole = known.where((F.col("shape") == AWARD) & said).select(
        key, "shape", F.lit(COMPETITION).alias("section"), F.lit(first - 1).alias("before"), F.lit("Sole source").alias("label"), F.when(is_sole_source(extent, offers, way), "yes").otherwise("no").alias("value")
    ).withColumnRenamed("before", "at")
    other = rows.where("shape is null and body is not null").lateralJoin(flatten(F.col("payload").outer(), F.lit(False)))
    flat = other.select(key, none.alias("shape"), F.lit(SOURCE).alias("section"), "at", "label", "value")
    every = mapped.unionByName(sole).unionByName(flat)
    return every.withColumn("href", F.when(F.col("value").rlike(r"^https?://[^ ]*$"), F.col("value")))
