"""Linked resources on pages made by hand."""

import json

import pytest

from tradeweave.sources import linked as L


def ent(n, name, ext="Org", types=(), **more):
    return {"type": "entities", "id": n, "attributes": {"id": n, "name": name, "primary_ext": ext, "types": list(types), **more}}


def rel(n, category, one, two, **more):
    return {"type": "relationships", "id": n, "attributes": {"id": n, "category_id": category, "entity1_id": one, "entity2_id": two, **more}}


BOARD, CHIEF = {"is_board": True}, {"is_executive": True}
PAGES = [
    {"data": ent(1, "Acme Corp", types=["Business", "Public Company"], website="https://acme.test", aliases=["AC", "", "AC", "Acme"], tags=["defense"], extensions={"PublicCompany": {"ticker": "ACM", "sec_cik": 77}, "Org": {"revenue": 5000000.0, "employees": 0}})},
    {"data": [rel(11, 1, 21, 1, category_attributes=BOARD, start_date="2019-00-00", description="Director of Acme"), rel(12, 1, 22, 1, category_attributes={**BOARD, **CHIEF}, description1="Chair", end_date="2020-05"), rel(13, 1, 23, 1, category_attributes={}), rel(14, 1, 24, 1, category_attributes=BOARD, is_current=False), rel(15, 1, 99, 1, category_attributes=BOARD)], "included": [ent(21, "Jo Doe", "Person", ["Lobbyist"]), ent(22, "Ann Lee", "Person")]},
    {"data": [rel(11, 1, 21, 1, category_attributes=CHIEF), rel(16, 1, 21, 31), rel(17, 1, 21, 32), rel(18, 1, 21, 1)], "included": [ent(31, "Agency", types=["Government Body"]), ent(32, "School", types=["School"]), ent(24, "Ed Ray", "Person"), ent(1, "Acme Corp")]},
    {"data": [rel(40, 3, 1, 31), rel(41, 10, 33, 1, category_attributes={"percent_stake": 40.5}), rel(42, 10, 22, 1, category_attributes={"percent_stake": 3}), rel(43, 10, 21, 1), rel(44, 11, 1, 33, start_date="0000-01-01"), rel(45, 6, 34, 1, amount=1000, is_current=True, end_date="2021-01-01"), rel(46, 7, 1, 98), rel(47, 3, 1, 1)], "included": [ent(33, "Parent"), ent(34, "Buyer")]},
    "not json",
    {"data": []},
]


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(k, p if isinstance(p, str) else json.dumps(p)) for k, p in enumerate(PAGES)]
    recs = L.records(spark.createDataFrame(rows, "page int, body string"))
    return spark.createDataFrame([("ent_acme", 1, "Acme")], "id string, number long, name string"), L.entities(recs), L.relationships(recs)


def test_records_of_all_pages(parts):
    _, ents, rels = parts
    got = {r.number: r for r in ents.collect()}
    assert set(got) == {1, 21, 22, 24, 31, 32, 33, 34} and got[1].ticker == "ACM"  # the richest copy
    of = {r.number: r for r in rels.collect()}
    assert len(of) == 16 and of[11].board and not of[11].executive and of[11]["from"] == "2019-01-01"  # the first page's
    assert of[12].to == "2020-05-01" and not of[12].current and of[44]["from"] is None and of[45].current and not of[14].current


def test_roles_and_other_seats(parts):
    got = {(r.src_name, r.dst_name, r.title, r.role_type, r.current, r.confidence) for r in L.roles(*parts).collect()}
    assert got == {("Jo Doe", "Acme", "Director", "board", True, 0.85), ("Ann Lee", "Acme", "Chair", "both", False, 0.85), ("Ed Ray", "Acme", "Director", "board", False, 0.85), ("Jo Doe", "Agency", "Position", "position", True, 0.8)}


def test_six_kinds_of_ties(parts):
    got = {(r.src_name, r.type, r.dst_name, r.pct, r.amount, r.via, r.confidence) for r in L.ties(*parts).collect()}
    assert got == {
        ("Acme", "MEMBER_OF", "Agency", None, None, None, 0.8), ("Parent", "OWNS", "Acme", 40.5, None, None, 0.8), ("Ann Lee", "BENEFICIAL_OWNER_OF", "Acme", 3.0, None, None, 0.75),
        ("Parent", "OWNS", "Acme", None, None, "hierarchy", 0.7), ("Buyer", "TRANSACTS_WITH", "Acme", None, 1000.0, None, 0.8),
    }


def test_attributes(parts):
    got = {(r.subject_id == "ent_acme", r.predicate, r.object_value) for r in L.facts(*parts).collect()}
    assert got == {
        (True, "attr:littlesis_id", "1"), (True, "attr:ticker", "ACM"), (True, "attr:public", "true"), (True, "attr:cik", "77"), (True, "attr:revenue", "5000000"), (True, "attr:website", "https://acme.test"), (True, "attr:aliases_text", "AC | Acme"),
        (True, "attr:org_types", "Business | Public Company"), (True, "attr:littlesis_tags", "defense"), (True, "attr:board_size", "2"), (False, "attr:public_official", "true"),
    }


def test_no_more_than_are_asked_for(spark, monkeypatch):
    page = {"data": [rel(100 + k, 3, 1, 50 + k) for k in range(20)], "included": [ent(50 + k, f"Club {k:02}") for k in range(20)]}
    recs = L.records(spark.createDataFrame([(1, json.dumps(page))], "page int, body string"))
    subjects = spark.createDataFrame([("e", 1, "E")], "id string, number long, name string")
    got = sorted(r.dst_name for r in L.ties(subjects, L.entities(recs), L.relationships(recs)).collect())
    assert got == [f"Club {k:02}" for k in range(12)]
    empty = L.records(spark.createDataFrame([], "page int, body string"))
    assert L.ties(subjects, L.entities(empty), L.relationships(empty)).count() == L.roles(subjects, L.entities(empty), L.relationships(empty)).count() == 0
