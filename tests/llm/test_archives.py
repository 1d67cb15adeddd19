import base64
import hashlib
import random
import struct

import pytest

from tradeweave.llm import warc
from tradeweave.llm.common import Scratch, table
from tradeweave.llm.queries import ORACLES, QUERIES

from ..oracle import SMALL, same

PAGES = "page_id long, url string, html string, sha1 string, first long, payload string, size int"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y", 2) for i, u, h in rows], PAGES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_its_sql_gives(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLES[name])


def test_round_trip(spark):
    rows = [(1, None, None), (2, "https://a.example/x y\n", ""), (3, "", ""), (4, "u", "é" * 70_000), (9, "u", "p"), (8, "u", "p"), (8, "u", "p"), (None, "u", "p"), (None, "u", "q"), (11, "u", "\x00\r\n\r\nx")]
    rows += [(100 + i, f"https://h/{i}", f"<p>{random.Random(i % 40).random()}</p>" * 50) for i in range(200)]
    folder = Scratch(spark, "w").path
    archives = warc.write(pages_of(spark, rows), folder)
    got = warc.read(archives, archives.count()).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    text = {}
    for i, _, h in rows:
        text.setdefault(i, []).append(h or "")
    for r in got:
        match = [h for h in text[r.page_id] if base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() == r.payload_digest]
        assert match and r.payload_bytes == len(match[0].encode())
        at = first.get(match[0])
        assert (r.record_type, r.refers_to) == (("response", None) if at is None or r.page_id == at else ("revisit", at))


def test_damage_is_found(spark, tmp_path):
    archives = warc.write(pages_of(spark, [(i, "u", f"page {i} " * 30) for i in range(20)]), f"file://{tmp_path}").collect()
    data = open(archives[0].path.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_FRAME and len(list(warc.frames(data))) == archives[0].n_records
    with pytest.raises(ValueError):
        list(warc.frames(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.frames(data[8 + size :]))
    good = warc.record(1, "u", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None)
    assert warc.parse(good)["payload_bytes"] == 3
    for bad in (good.replace(b"WARC/1.1", b"WARC/0.9"), good.replace(b"abc", b"abd"), good[:-1], good.replace(b"WARC-Date: ", b"X-Date: ")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_no_pages(spark):
    archives = warc.write(pages_of(spark, []), Scratch(spark, "w").path)
    assert warc.read(archives, archives.count()).collect() == []


def test_hosts_and_rules(spark):
    from tradeweave.llm import urls

    rows = [(1, "http://A.Example.NET/en/x?q#f", ""), (2, "https://www.example.com/de/", ""), (3, "ftp://x.org/fr/1", ""), (4, "mailto:a@b.net", ""), (5, None, ""), (6, "http://notexample.com/de/", ""), (7, "http://net", ""), (8, "http://net/?", ""), (9, "a://b://c/d", ""), (10, "http://É.net/\n/x", ""), (11, "", "")]
    labels = spark.createDataFrame([], "page_id long, good long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages_of(spark, rows), labels).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("www.example.com", "/de/", "example.com/de/", "block"), 3: ("x.org", "/fr/1", "org/fr/", "allow"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("notexample.com", "/de/", None, "allow"), 7: ("net", "", None, "allow"), 8: ("net", "/", "net/", "block"),
        9: ("b:", "//c/d", None, "allow"), 10: ("É.net", "/\n/x", "net/", "block"), 11: ("", "", None, "allow"),
    }


def test_reputation_shrinks(spark):
    from tradeweave.llm import urls

    rows = [("bad.example.com", 0)] * 60 + [("new.example.com", 0)] + [("good.example.org", 1)] * 200
    got = {r.host: r for r in urls.reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert got["bad.example.com"]["upper"] < urls.FLOOR < got["good.example.org"]["upper"]
    assert got["bad.example.com"]["mean"] < got["new.example.com"]["mean"] < got["good.example.org"]["mean"]
