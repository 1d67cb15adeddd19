"""Typed searches over an index, on a few names."""

import pytest

from tradeweave.plans import search as S

NAMES = "id string, label string, name string, uei string, cage string, lei string, text string"


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("e1", "Entity", "Société L-3 Harris, Inc.", "ABC123", None, None, "Société L-3 Harris, Inc. Troy Works"), ("e2", "Entity", "Harris Bolt", None, "9X9", None, "Harris Bolt"), ("e3", "Entity", "Raytheon/Technologies", None, None, None, "Raytheon/Technologies"),
        ("p1", "Person", "PAMELA a. Wickham", None, None, None, "PAMELA a. Wickham"), ("p2", "Person", "Pamela Harris", None, None, None, "Pamela Harris"), ("p3", "Person", None, None, None, None, ""), ("x", "Entity", "... !", None, None, None, "... !"),
    ]
    return S.index_of(spark.createDataFrame(rows, NAMES))


@pytest.mark.parametrize(
    ("query", "kind", "want"),
    [
        ("abc-123", "any", ["e1"]),
        ("9x9", "any", ["e2"]),
        ("societe harris", "any", ["e1"]),
        ("troy", "any", ["e1"]),  # of an alias
        ("harris", "any", ["e2", "p2", "e1"]),
        ("harirs", "any", ["e2", "p2", "e1"]),  # two letters swapped
        ("haris", "any", ["e2", "p2", "e1"]),
        ("harrris", "any", ["e2", "p2", "e1"]),
        ("hbrris", "any", ["e2", "p2", "e1"]),
        ("hbrriss", "any", []),
        ("pame wick", "any", ["p1"]),
        ("pam", "any", ["p1", "p2"]),
        ("a", "any", ["p1"]),
        ("ytheon", "any", ["e3"]),  # a substring alone
        ("Raytheon/Technologies", "any", ["e3"]),
        ("harris", "person", ["p2"]),
        ("harris", "entity", ["e2", "e1"]),
        ("", "any", []),
        ("  ... ", "any", []),
        ('(bad "syntax) ~ *', "any", []),
    ],
)
def test_search(index, query, kind, want):
    assert [r.id for r in S.search_entities(index, query, kind).orderBy("rank").collect()] == want


def test_limits_and_scores(index):
    assert [r.id for r in S.search_entities(index, "harris", "any", 1).collect()] == ["e2"]
    assert S.search_entities(index, "harris", "entity", 0).count() == 1
    got = {r.id: (r.score, r.step) for r in S.search_entities(index, "pamela harri").collect()}
    assert got == {"p2": (round((3 + 2) / 6, 4), "words")}
    assert [(r.score, r.step) for r in S.search_entities(index, "ABC 123").collect()] == [(1.0, "identifier")]
    assert [(r.score, r.step) for r in S.search_entities(index, "ytheon").collect()] == [(0.5, "substring")]


def test_keys_of_a_word(spark):
    got = spark.createDataFrame([("abca",), ("a",), ("éé",)], "w string").select(S.less_one(S.F.col("w")).alias("k")).collect()
    assert [sorted(r.k) for r in got] == [["aba", "abc", "abca", "aca", "bca"], ["", "a"], ["é", "éé"]]
