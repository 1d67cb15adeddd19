"""Landed payloads and lists, on small files."""

import datetime
import json

from pyspark.sql import functions as F

from tradeweave.plans import resolve
from tradeweave.sources import lists, payloads


def facts(df):
    return {(r.subject_id, r.predicate, r.object_id or r.object_value) for r in df.collect()}


def test_headerless_csv(spark, tmp_path):
    (tmp_path / "sdn.csv").write_text('36,"ACME ""X"" TRADING","-0- ","CUBA","","","","","","","","note"\n37,"DOE, John","individual","SDGT","","","","","","","",""\nbad\n\n')
    rows = {r.ref: (r.name, r.kind, r.program, r.remarks) for r in lists.sdn(spark, str(tmp_path / "sdn.csv")).collect()}
    assert rows == {"36": ('ACME "X" TRADING', "entity", "CUBA", "note"), "37": ("DOE, John", "individual", "SDGT", None)}


def test_two_sections_of_xml(spark, tmp_path):
    (tmp_path / "un.xml").write_text(
        "<L><INDIVIDUALS><INDIVIDUAL><DATAID>1</DATAID><FIRST_NAME>Ann </FIRST_NAME><SECOND_NAME>Lee</SECOND_NAME><NATIONALITY><VALUE>X</VALUE></NATIONALITY>"
        "<INDIVIDUAL_ALIAS><ALIAS_NAME>A. Lee</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_ALIAS><ALIAS_NAME/></INDIVIDUAL_ALIAS></INDIVIDUAL></INDIVIDUALS>"
        "<ENTITIES><ENTITY><DATAID>2</DATAID><FIRST_NAME>Front Co</FIRST_NAME><REFERENCE_NUMBER>R2</REFERENCE_NUMBER></ENTITY><ENTITY><DATAID>3</DATAID></ENTITY></ENTITIES></L>"
    )
    rows = {r.name: (r.aliases, r.kind, r.ref, r.nationality) for r in lists.un_list(spark, str(tmp_path / "un.xml")).collect()}
    assert rows == {"Ann Lee": (["A. Lee"], "individual", None, "X"), "Front Co": ([], "entity", "R2", None)}


def test_exclusions(spark, tmp_path):
    head = "Classification,Name,Unique Entity ID,CAGE,Record Status,Excluding Agency,Exclusion Type,Exclusion Program,Active Date,Termination Date,Country,SAM Number"
    body = ["Firm,Acm\xe9 Inc,abc123,,Active,A,T,P,1,2,US,S1", "Firm,Old Co,,,Inactive,,,,,,,S2", "Individual,Jo,,,Active,,,,,,,S3", "Firm,Bolt LLC,,9x9,,,,,,,,S4"]
    (tmp_path / "x.csv").write_bytes("\n".join([head, *body]).encode("latin-1"))
    listed = lists.exclusions(spark, str(tmp_path / "x.csv"))
    assert {(r.name, r.uei, r.cage) for r in listed.collect()} == {("Acm\xe9 Inc", "ABC123", None), ("Bolt LLC", None, "9X9")}
    mine = spark.createDataFrame([("1", "ABC123", None, "z"), ("2", None, "9x9", "Bolt"), ("3", None, None, "BOLT"), ("4", None, None, "Other")], "id string, uei string, cage string, name string")
    assert {(r.id, r.result, r.how) for r in lists.excluded(mine, listed).collect()} == {("1", "hit", "uei"), ("2", "hit", "cage"), ("3", "hit", "norm"), ("4", "clear", None)}


def test_registry_records(spark):
    rows = [("e1", "L1", "US", "US-TX", "Acme", "ACTIVE", ("LP", "Parent", "DE"), ("LU", "Top", "CN"), None), ("e2", "L2", "FR", None, "Solo", None, None, None, 90.0)]
    got = facts(payloads.gleif(spark.createDataFrame(rows, payloads.GLEIF)))
    assert ("e1", "INCORPORATED_IN", "loc_US-TX") in got and ("e1", "PARENT_SEATED_IN", "loc_CN") in got and ("e2", "PARENT_SEATED_IN", "loc_FR") in got
    assert {p for s, p, _ in got if s == "e2"} == {"attr:lei", "attr:legal_name", "INCORPORATED_IN", "PARENT_SEATED_IN"}
    assert {o for s, p, o in got if p in ("OWNS", "ULTIMATE_PARENT_OF")} == {"e1"}


def test_registrations(spark, tmp_path):
    one = {"id": "e1", "entityRegistration": {"ueiSAM": "U1", "registrationStatus": "Active", "exclusionStatusFlag": "Y"}, "coreData": {"physicalAddress": {"countryCode": "USA", "stateOrProvinceCode": "TX"}, "generalInformation": {"countryOfIncorporationCode": "DEU"}},
           "assertions": {"goodsAndServices": {"naicsList": [{"naicsCode": "1"}, {}, {"naicsCode": "2"}]}}}
    (tmp_path / "s.json").write_text(json.dumps(one) + "\n" + json.dumps({"id": "e2"}))
    got = facts(payloads.sam(spark.read.schema(payloads.SAM).json(str(tmp_path / "s.json"))))
    assert {(p, o) for s, p, o in got if s == "e1"} == {("attr:uei", "U1"), ("attr:registration_status", "Active"), ("attr:sam_registered", "true"), ("attr:naics_codes", "1,2"), ("OPERATES_IN", "loc_US-TX"), ("INCORPORATED_IN", "loc_DE"), ("exclusion_screen", "hit")}
    assert {p for s, p, _ in got if s == "e2"} == {"attr:sam_registered"}


def test_filings(spark):
    many = ["8-K"] * 14
    rows = [("a", 7, (["10-K", "4", "NT 10-Q"], ["2024-02-01", "2024-01-01", "2023-12-01"], ["0-1", "0-2", "0-3"], ["x.htm", "y", "z"])), ("b", 8, (["10-K"], ["2020-02-01"], ["1"], ["k"])), ("c", 9, (["10-K"], ["2024-06-01"], ["1"], ["k"])),
            ("d", 10, ([*many, "NT 10-K"], ["2024-01-01"] * 15, ["1"] * 15, ["k"] * 15))]
    got = payloads.edgar(spark.createDataFrame(rows, payloads.EDGAR), datetime.date(2025, 1, 1)).collect()
    assert {r.subject_id: r.object_value for r in got if r.predicate == "financial_screen"} == {"a": "medium", "b": "low", "c": "clear", "d": "low"}
    assert "https://www.sec.gov/Archives/edgar/data/7/01/x.htm" in {r.url for r in got} and sum(r.subject_id == "d" and r.predicate == "mention" for r in got) == 12


def test_articles_tickers_and_keys(spark):
    art = lambda s: ("u" + str(s), "t", "20240131T101500Z", "d", s)
    rows = [("a", [art("negative")] * 3), ("b", [art(None)]), ("c", [])]
    got = payloads.gdelt(spark.createDataFrame(rows, payloads.GDELT)).collect()
    assert {(r.subject_id, r.object_value, r.confidence) for r in got if r.predicate == "adverse_media_screen"} == {("a", "medium", 0.6), ("b", "clear", 0.4)}
    assert {r.published_at for r in got if r.predicate == "mention"} == {"2024-01-31T10:15:00Z"}
    table = spark.createDataFrame([('{"0": {"cik_str": 5, "ticker": "AB", "title": "Ab Co"}, "1": {"cik_str": 6, "ticker": "CD", "title": "Cd"}}',)], "value string")
    assert sorted(map(tuple, payloads.tickers(table).collect())) == [(5, "AB", "Ab Co"), (6, "CD", "Cd")]
    urls = spark.createDataFrame([("get", "https://x/y?api_key=1&a=2"), ("GET", "https://x/y?api_key=9&a=2"), ("GET", "https://x/z")], "m string, u string")
    assert urls.select(payloads.payload_key(F.col("m"), F.col("u"), F.lit(None))).distinct().count() == 2
    landed = spark.createDataFrame([("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-02 00:00:00", 2), ("old", "2020-01-01 00:00:00", 3)], "key string, t string, v int").withColumn("fetched_at", F.to_timestamp("t"))
    assert [r.v for r in payloads.latest_payloads(landed, F.to_timestamp(F.lit("2024-01-02 01:00:00")), 86_400).collect()] == [2]


def test_awards(spark):
    rows = [("p", "A1", "Acme Inc", "U1", 10.0, "5821", "NOT COMPETED", "3", None), ("p", "A2", "Acme Inc", "u1", 30.0, "J012", None, "2", "x"), ("p", "A3", "Bolt", None, 5.0, None, None, "1", None), ("p", "A4", " ", None, 99.0, None, None, None, None), ("p", "A5", "Cog", None, 1.0, "99", "Full", "4", "Only one source")]
    got = {r.name: r for r in payloads.usaspending(spark.createDataFrame(rows, payloads.AWARDS)).collect()}
    assert set(got) == {"Acme Inc", "Bolt", "Cog"} and got["Cog"].sole_source and got["Cog"].category == "cat_other_goods" and got["Acme Inc"].amount == 40.0 and got["Acme Inc"].contract_ref == "A2" and got["Acme Inc"].category == "cat_maintenance"
    assert got["Bolt"].sole_source and not got["Acme Inc"].sole_source and got["Bolt"].category is None


def test_resolution_and_screening(spark):
    entity = spark.createDataFrame([("e1", "Acme Industries Inc.", "L1", ["AI Works"]), ("e2", "Acme Industrial Supplies LLC", None, []), ("e3", "Bolt & Nut Company", None, None)], "id string, name string, lei string, aliases array<string>")
    asked = spark.createDataFrame([("a", "l1", "zzz"), ("b", None, "ACME INDUSTRIES"), ("c", None, "ai works ltd"), ("d", None, "Acme Industriess"), ("e", None, "Bolts"), ("f", None, None)], "key string, lei string, name string")
    got = {r.key: (r.id, r.method) for r in resolve.find_entity(entity, asked).collect()}
    assert got == {"a": ("e1", "lei"), "b": ("e1", "name_exact"), "c": ("e1", "alias_exact"), "d": ("e1", "name_fuzzy")}
    cands = resolve.fuzzy_candidates(entity, asked.where("key = 'd'")).collect()
    assert [r.id for r in sorted(cands, key=lambda r: r["rank"])][0] == "e1"
    listed = spark.createDataFrame([("ACME INDUSTRIES", "P1"), ("BOLT", "P2"), ("Doe, John Q", "P3")], "name string, program string")
    got = {r.id: (r.result, r.hits) for r in resolve.screened(entity.drop("aliases"), listed).collect()}
    assert got["e1"] == ("hit", ["ACME INDUSTRIES"]) and got["e2"][0] == got["e3"][0] == "clear"
    people = spark.createDataFrame([("p1", "Mr. John Q. Doe"), ("p2", "John")], "id string, name string")
    assert {r.id: r.result for r in resolve.screened(people, listed, people=True).collect()} == {"p1": "hit", "p2": "clear"}
    person = spark.createDataFrame([("p1", "John Doe", "ref1"), ("p2", "Ann Lee", None)], "id string, name string, source_ref string")
    want = spark.createDataFrame([("x", "Nobody", "ref1"), ("y", "Dr. ANN LEE", None), ("z", "Ann", None)], "key string, name string, source_ref string")
    assert {r.key: (r.id, r.method) for r in resolve.find_person(person, want).collect()} == {"x": ("p1", "source_ref"), "y": ("p2", "name_exact")}
