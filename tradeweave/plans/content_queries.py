"""Queries of landed payloads and documents: what is in them, over payloads that each event stands for and over all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import read_page
from ..sources import shapes as S
from .registry import ORACLES, QUERIES

#: What the event of each number by ten stands for: a payload of each shape, one of none, one that isn't JSON. {e} is the event, {u}
#: its user, {t} its type, {v} its value in cents.
PAYLOADS = (
    '{"generated_unique_award_id": "CONT_{e}", "piid": "P{e}", "type_description": "{t}", "category": "", "total_obligation": {v}, "base_and_all_options": null, "date_signed": "2024-01-0{k}T10:00:00", "subaward_count": {u}, '
    '"recipient": {"recipient_name": "Acme {u}", "location": {"address_line1": "{u} Main St", "city_name": "Town", "state_code": "", "state_name": "Texas", "zip5": "7{e}", "country_name": "UNITED STATES", "location_country_code": "USA"}, '
    '"business_categories": ["b1","b2","b3","b4","b5","b6","b7","b8","b9","b10","b11","b12","b13","b{e}"]}, "latest_transaction_contract_data": {"extent_competed_description": "Not Competed", "number_of_offers_received": "{k}", "commercial_item_acquisition_description": true}, '
    '"place_of_performance": {"city_name": "Lyon", "country_name": "FRANCE", "location_country_code": "FRA"}, "parent_award": {}}',
    '{"recipient_level": "R", "name": "Firm {u}", "uei": "U{e}", "total_prime_amount": "{v}", "total_prime_awards": 0, "business_types": [], "location": {"city_name": "Bonn", "location_country_code": "DEU"}}',
    '{"data": {"attributes": {"lei": "LEI{e}", "entity": {"legalName": {"name": "Legal {u}"}, "otherNames": [{"name": "One", "language": "en"}, {"language": "de"}, {"name": "Two {e}"}], "jurisdiction": "US-DE", "legalAddress": {"addressLines": ["1 Road", "Floor {k}"], "city": "Dover", "country": "US"}, '
    '"creationDate": "2001"}, "registration": {"status": "{t}", "nextRenewalDate": "2025-06-15T00:00:00Z"}, "conformityFlag": false}}}',
    '{"entityRegistration": {"ueiSAM": "S{e}", "legalBusinessName": "Legal \\u00e9 {u}", "registrationStatus": "{t}", "registrationDate": "2020-02-0{k}"}, "coreData": {"businessTypes": {"businessTypeList": [{"businessTypeCode": "2X"}]}, "generalInformation": {"stateOfIncorporationCode": "TX"}}}',
    '{"cik": {e}, "name": "Filer {u}", "tickers": ["T{u}", null, "T{k}"], "exchanges": ["NYSE"], "addresses": {"business": {"street1": "{k} Way", "street2": null, "city": "Reno", "stateOrCountry": "NV", "zipCode": "89{u}"}}, "filings": {"recent": {"accessionNumber": ["{e}"]}}}',
    '{"primaryDocument": "d{e}.htm", "form": "{t}", "filingDate": "2024-03-1{k}", "items": "", "size": {v}}',
    '{"data": {"attributes": {"related": {"name": "R{u}"}, "primary_ext": "Org", "entity": {"name": "E{e}"}, "category_id": {k}, "is_current": true, "extensions": {"Position": {"title": "{t}", "is_board": false}}}, "links": {"self": "https://example.org/r/{e}"}}}',
    '{"data": {"attributes": {"primary_ext": "Person", "name": "N{u}", "aliases": ["A{k}"], "website": "http://example.org/{u}", "start_date": "1999-01-01", "blurb": null}}}',
    '{"widget_kind": {"name": "{t}", "count": 0, "nested": {"deep_er": {"most": [{k}, "x"]}, "flag": false}}, "ok": true, "page": "https://example.org/{e}", "none": null, "list": [{"a": {u}}, "second"], "primaryDocument": null}',
    '{"bad": {e}',
)
#: What the payloads of no shape give, in order.
FLAT = (("Ok", "yes"), ("Page", "https://example.org/{e}"), ("Widget kind › Name", "{t}"), ("Widget kind › Count", "0"), ("Widget kind › Nested › Deep er", '{"most":[{k},"x"]}'), ("Widget kind › Nested › Flag", "no"), ("List › 1", "second"), ("List › 0 › A", "{u}"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, payload): what each event stands for."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.element_at(F.array(*map(F.lit, PAYLOADS)), (F.col("event_id") % 10 + 1).cast("int"))
    for name, c in (("e", F.col("event_id")), ("u", F.col("user_id")), ("t", F.col("event_type")), ("v", F.round(F.col("value") * 100).cast("long")), ("k", F.col("event_id") % 7)):
        text = F.replace(text, F.lit(f"{{{name}}}"), F.coalesce(c.cast("string"), F.lit("")))
    return e.select(F.concat(F.lit("pay_"), "event_id").alias("id"), text.alias("payload"))


def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.payload_fields(payloads(spark, sf_dir))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, title, n_chars, n_lines, text_md5, markup_md5): each page read as a document."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", read_page("html").alias("p"))
    lines = F.when(F.col("p.text") == "", 0).otherwise(F.size(F.split("p.text", "\n")))
    return pages.select("page_id", "p.title", F.length("p.text").alias("n_chars"), lines.alias("n_lines"), F.md5("p.text").alias("text_md5"), F.md5("p.markup").alias("markup_md5"))


QUERIES["payload_fields"] = payload_fields
QUERIES["page_texts"] = page_texts

_q = lambda x: "null" if x is None else "'" + str(x).replace("'", "''") + "'"
_fill = lambda c: f"replace(replace(replace(replace(replace({c}, '{{e}}', event_id::varchar), '{{u}}', user_id::varchar), '{{t}}', event_type), '{{v}}', round(value * 100)::bigint::varchar), '{{k}}', (event_id % 7)::varchar)"
_j = lambda p, c="raw": f"json_extract_string({c}, '$.{p}')"
_joined = lambda *parts: f"nullif(array_to_string(list_filter([{', '.join(parts)}], lambda x: x <> ''), ', '), '')"
_strings = "list_filter(case when json_type(raw) = 'ARRAY' then json_extract_string(raw, '$[*]') end, lambda x: x is not null)"
_has = " or ".join(f"coalesce({_j(r[4], 'j')}, '') <> ''" for r in S.field_rows() if r[:2] == (S.AWARD, S.COMPETITION))
_deal = "latest_transaction_contract_data."
ORACLES["payload_fields"] = f"""
with t(n, template) as (values {", ".join(f"({k}, {_q(p)})" for k, p in enumerate(PAYLOADS))}),
p as (select 'pay_' || event_id as id, event_id % 10 as n, events.*, {_fill("template")} as payload from events join t on n = event_id % 10),
j as (select id, payload::json as j from p where json_valid(payload)),
s as (select *, case {" ".join(f"when {_j(path, 'j')} is not null then '{name}'" for name, path in S.probes())} end as shape from j),
f(shape, section, at_, label, path, form) as (values {", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _q(x) for x in r) + ")" for r in S.field_rows())}),
r as (select id, f.*, json_extract(j, '$.' || path) as raw, json_extract_string(j, '$.' || path) as txt from s join f using (shape)),
mapped as (select id, shape, section, at_, label, nullif(case
    when form is null then case json_type(raw) when 'BOOLEAN' then case txt when 'true' then 'yes' else 'no' end when 'OBJECT' then nullif(raw::varchar, '{{}}') when 'ARRAY' then nullif(raw::varchar, '[]') else txt end
    when form = 'money' then '$' || format('{{:,}}', round_even(try_cast(txt as double), 0)::bigint)
    when form = 'date' then txt[:10]
    when form = 'list' then case when len({_strings}) > 0 then array_to_string({_strings}[:12], ', ') || case when len({_strings}) > 12 then ' (+' || (len({_strings}) - 12) || ' more)' else '' end end
    when form = 'names' then array_to_string(list_filter(json_extract_string(raw, '$[*].name')[:6], lambda x: x <> ''), ', ')
    when form = 'addr' then {_joined(_j("address_line1"), _j("city_name"), f"coalesce(nullif({_j('state_code')}, ''), {_j('state_name')})", _j("zip5"), f"case when coalesce({_j('location_country_code')}, '') <> 'USA' then {_j('country_name')} end")}
    when form = 'gleif_addr' then {_joined("array_to_string(json_extract_string(raw, '$.addressLines[*]'), ', ')", _j("city"), _j("region"), _j("postalCode"), _j("country"))}
    when form = 'sec_addr' then {_joined(*[_j(x) for x in "street1 street2 city stateOrCountry zipCode".split()])} end, '') as value from r where raw is not null and json_type(raw) <> 'NULL'),
sole as (select id, shape, '{S.COMPETITION}' as section, {min(r[2] for r in S.field_rows() if r[:2] == (S.AWARD, S.COMPETITION)) - 1} as at_, 'Sole source' as label,
    case when contains(upper(coalesce({_j(_deal + "extent_competed_description", "j")}, '')), 'NOT COMPETED') or contains(upper(coalesce({_j(_deal + "solicitation_procedures_description", "j")}, '')), 'ONLY ONE SOURCE')
      or coalesce({_j(_deal + "number_of_offers_received", "j")}, '') = '1' then 'yes' else 'no' end as value from s where shape = '{S.AWARD}' and ({_has})),
flat(at_, label, text) as (values {", ".join(f"({k + 1}, {_q(a)}, {_q(b)})" for k, (a, b) in enumerate(FLAT))}),
loose as (select id, null as shape, '{S.SOURCE}' as section, at_, label, {_fill("text")} as value from p, flat where n = 8)
select id, shape, section, at_ as "at", label, value, case when regexp_full_match(value, 'https?://[^ ]*') then value end as href from (from mapped where value is not null union all from sole union all from loose)"""
