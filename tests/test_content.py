"""Landed payloads read as fields, documents read as text."""

import json
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from tradeweave.functions import html as H
from tradeweave.plans import content_queries as C
from tradeweave.sources import documents, payloads, shapes

from .oracle import SMALL


def shown(spark, *bodies):
    rows = spark.createDataFrame([(str(k), b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "id string, payload string")
    out = {}
    for r in shapes.payload_fields(rows).orderBy("id", "at").collect():
        out.setdefault(r.id, {}).setdefault(r.section, {})[r.label] = r.value
    return out


def test_each_shape_has_its_probe_and_fields():
    names = [n for n, _ in shapes.probes()]
    assert len(names) == 8 == len(set(names)) and {r[0] for r in shapes.field_rows()} == set(names)
    assert all(r[5] in (None, "money", "date", "list", "addr", "gleif_addr", "sec_addr", "names") for r in shapes.field_rows())


def test_the_first_probe_with_a_value_decides(spark):
    got = shown(spark, {"primaryDocument": "x", "generated_unique_award_id": None, "form": "8-K"}, {"recipient_level": "C", "primaryDocument": "x", "name": "N"}, {"data": {"attributes": {"lei": "L", "primary_ext": "Org"}}})
    assert got["0"]["Filing"] == {"Form": "8-K", "Primary document": "x"} and got["1"]["Recipient"] == {"Name": "N", "Level": "C"} and got["2"]["Entity"] == {"LEI": "L"}


def test_values_read_as_they_should(spark):
    award = {"generated_unique_award_id": "C1", "piid": "", "total_obligation": -1234567.5, "description": "x" * 5000, "date_signed": "2024", "latest_transaction_contract_data": {"solicitation_procedures_description": "Only One Source", "commercial_item_acquisition_description": False}}
    got = shown(spark, award, {"generated_unique_award_id": "C2", "subaward_count": 0, "total_obligation": "n/a"})
    assert got["0"]["Award"] == {"Unique ID": "C1", "Description": "x" * 4000 + " …", "Obligated": "$-1,234,568", "Signed": "2024"}
    assert list(got["0"]["Competition"].items()) == [("Sole source", "yes"), ("Solicitation procedures", "Only One Source"), ("Commercial item", "no")]
    assert got["1"] == {"Award": {"Unique ID": "C2", "Sub-awards": "0"}}


def test_other_payloads_are_flattened_in_their_order(spark):
    body = {"widget": {"name": "Acme", "count": 3, "nested": {"deep": "value", "deeper": {"x": [1, 2]}}}, "ok": True, "n": 5.0, "gone": None, "none": [], "site": "https://x.test/p"}
    got = shown(spark, body, [{"a": 1}, "b"], "not json", "5", "", {f"k{i}": i for i in range(300)}, {"long": [list(range(40))], "many": list(range(40))})
    assert list(got["0"][shapes.SOURCE].items()) == [("Ok", "yes"), ("N", "5.0"), ("Site", "https://x.test/p"), ("Widget › Name", "Acme"), ("Widget › Count", "3"), ("Widget › Nested › Deep", "value"), ("Widget › Nested › Deeper", '{"x":[1,2]}')]
    assert got["1"][shapes.SOURCE] == {"1": "b", "0 › A": "1"}
    assert not {"2", "3", "4"} & got.keys() and len(got["5"][shapes.SOURCE]) == 120
    assert len(got["6"][shapes.SOURCE]) == 40 and "Many › 19" in got["6"][shapes.SOURCE]


def test_flatten_asks_for_text_and_can_give_links(spark):
    rows = spark.createDataFrame([('{"a": "https://x.test", "b": "https://x.test and more"}',), (None,)], "p string")
    got = rows.lateralJoin(shapes.flatten(F.col("p").outer(), F.lit(True))).collect()
    assert [(r.label, r.href) for r in got] == [("A", "https://x.test"), ("B", None)]
    with pytest.raises(Exception, match="flatten takes JSON text"):
        spark.range(1).lateralJoin(shapes.flatten(F.col("id").outer(), F.lit(False))).collect()


def test_categories_of_codes(spark):
    rows = spark.createDataFrame([("5821", "cat_avionics"), ("j012", "cat_maintenance"), ("99", "cat_other_goods"), ("1", "cat_other_goods"), ("I1", "cat_other_services"), ("", None), (None, None)], "c string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", payloads.psc_category(F.col("c"))).collect())


# documents


def plain(raw: str) -> str:
    """The text of a simple page (no odd quotes, all its scripts and comments closed), by cutting at tags one by one."""
    out, at, silent, aside = [], 0, 0, 0
    while at < len(raw):
        if raw.startswith("<!--", at):
            at = raw.index("-->", at) + 3
        elif raw[at] == "<":
            end = raw.index(">", at)
            word = re.split(r"[ />]", raw[at + 1 : end + 1].lstrip("/"))[0].lower()
            closing = raw[at + 1] == "/"
            if word in ("script", "style") and not closing:
                end = raw.lower().index(f"</{word}>", at) + len(word) + 2
            elif word in ("title", "form", "button", "select", "iframe"):
                silent += -1 if closing else 1
            elif word in ("nav", "header", "footer", "aside"):
                aside += -1 if closing else 1
            elif word in H.LINES and not silent:
                out.append("\n")
            at = end + 1
        else:
            end = raw.find("<", at)
            end = len(raw) if end < 0 else end
            if not silent and not aside and raw[at:end].strip():
                out.append(unescape(raw[at:end]))
            at = end
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", re.sub(r"[ \t\xa0]+", " ", "".join(out))).strip()


def test_all_pages_read_as_a_plain_parser_reads_them(spark):
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()}
    from hashlib import md5

    got = C.page_texts(spark, SMALL).collect()
    assert len(got) == len(raw)
    for r in got:
        want = plain(raw[r.page_id] or "")
        assert (r.n_chars, r.text_md5) == (len(want), md5(want.encode()).hexdigest())


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        ('<p title="a>b">x</p><script>var q=1;', "x"),
        ("<p>a<!-- <p>no</p> -->b</p>", "ab"),
        ("<p>Caf&eacute; &lt;not a tag&gt; &#x41;&amp;", "Café <not a tag> A&"),
        ("<head><link rel=x><meta charset=utf-8></head><p>kept", "kept"),
        ("<nav><a href=/>Menu</a></nav><article><p>The story.</p></article><footer>(c)</footer>", "The story."),
        ("<script>if (a < b) { x = '</p>' }</script>after", "after"),
        ("<ix:header><ix:hidden>tags</ix:hidden></ix:header><h1>Title</h1>", "Title"),
        ("a\xa0 \t b<br>c<p></p><p></p><p></p>d", "a b\nc\n\nd"),
        ("<style>p{}</style><title>T</title>x", "x"),
        ("", ""),
        ("<", "<"),
        ("</p></script>x<noscript>y", "x"),
    ],
)
def test_text_of_pages(raw, text):
    assert H.page(raw)[1] == text


def test_markup_has_no_scripts():
    raw = '<title> Form </title><body onload="steal()"><a href="javascript:alert(1)">bad</a><a href="/x?a=1&amp;b=2" target>good</a><img src="l.gif" onerror="no()"/><script>alert(2)</script><style>a[b="</p>"]{}</style><iframe src=x></iframe>&lt;i&gt;'
    title, _, markup = H.page(raw)
    assert title == "Form"
    assert markup == '<title> Form </title><body><a>bad</a><a href="/x?a=1&amp;b=2" target>good</a><img src="l.gif" /><style>a[b="<\\/p>"]{}</style>&lt;i&gt;'


@pytest.mark.parametrize(
    ("body", "kind", "text"),
    [
        ("é".encode(), "", "é"),
        ("é".encode("latin-1"), "", "é"),
        ("é€".encode("cp1252"), "text/html", "é€"),
        ("é".encode("latin-1"), "text/html; charset=ISO-8859-1", "é"),
        ("é".encode("utf-16"), "", "é"),
        ("é".encode("utf-16-be"), 'text/html; charset="utf-16-be"', "é"),
        ("é".encode("utf-8-sig"), "", "é"),
        ('<meta charset="koi8-r">ж'.encode("koi8-r"), "text/html", '<meta charset="koi8-r">ж'),
        ("é".encode(), "text/html; charset=nonsense", "é"),
        (b"\x81\xff", "", "��"),
        (b"", "", ""),
    ],
)
def test_charsets(body, kind, text):
    assert H.decoded(body, kind) == text


def test_landed_documents(spark, tmp_path):
    def land(key, body, **note):
        (tmp_path / f"{key}.doc").write_bytes(body)
        if note:
            (tmp_path / f"{key}.doc.json").write_text(json.dumps({"url": f"https://x.test/{key}", "_ts": 1700000000.5, **note}))

    land("page", "<title>Ä</title><p>ö".encode("latin-1"), content_type="Text/HTML; charset=latin-1", truncated=True)
    land("pdf", b"%PDF", content_type="application/pdf")
    land("img", b"\x89", content_type="image/png")
    land("json", b'{"a": 1}', content_type="application/json")
    land("xml", b"<a/>", content_type="application/rss+xml")
    land("bare", b"??")
    land("long", b"x" * 90_000, content_type="text/plain")
    got = {r.key: r for r in documents.read(documents.landed(spark, str(tmp_path))).collect()}
    assert {k: r.render for k, r in got.items()} == {"page": "html", "pdf": "pdf", "img": "image", "json": "text", "xml": "text", "bare": "binary", "long": "text"}
    assert (got["page"].title, got["page"].text, got["page"].mime, got["page"].capped) == ("Ä", "ö", "text/html", True)
    assert got["pdf"].text is None and got["bare"].bytes == 2 and got["json"].text == '{"a": 1}'
    assert len(got["long"].text) == 80_000 and got["long"].text_truncated and not got["page"].text_truncated


def test_urls_without_a_document(spark):
    rows = spark.createDataFrame([("https://www.usaspending.gov/award/1", "unavailable"), ("https://sam.gov/x", "unavailable"), ("https://notsam.gov/x", "ok"), ("", "unavailable"), (None, "unavailable"), ("no url", "unavailable"), ("https://x.test/a", "ok")], "url string, want string")
    assert all(r.status == r.want for r in documents.servable(rows).collect())
    framed = spark.createDataFrame([("<p>x</p>", 'https://x.test/a"onload="evil')], "m string, u string").select(H.frame(F.col("m"), F.col("u")).alias("f")).first().f
    assert 'onload="evil' not in framed and framed.endswith("<body><p>x</p></body></html>")
