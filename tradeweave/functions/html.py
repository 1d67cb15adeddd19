"""Documents read: charset of their bytes, and a page as title, plain text and markup that can be shown in a frame without scripts.

The page is tokenised as HTML, attribute values, comments, raw text and character references included; nothing is matched by
patterns over markup. A tag in DROPPED silences all up to its end, to the end of the page if that never comes.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Tags that begin and end a line of text; that go with all they hold, and those of them that hold nothing; that have
#: no end; whose text isn't the page's own; what a link may begin with.
LINES = frozenset("p div br tr li h1 h2 h3 h4 h5 h6 table section article hr td th".split())
DROPPED = frozenset("script noscript iframe object embed applet form input button select textarea link meta base svg canvas audio video source track template ix:header ix:hidden".split())
EMPTY_DROPPED = frozenset("link meta base input source track".split())
ENDLESS = frozenset("area br col hr img wbr".split())
FURNITURE = frozenset("nav header footer aside".split())
LINK = re.compile(r"^(https?:|mailto:|#|/|\.|[^:]*$|data:image/)", re.I)
UNSAFE = ("srcset", "formaction")
#: Blanks that are drawn together, lines that are left empty.
BLANKS, EMPTY_LINES = re.compile(r"[ \t\xa0]+"), re.compile(r"\n\s*\n\s*\n+")
#: Text cut to LONG characters, markup to WIDE, where a document is shown.
LONG, WIDE = 80_000, 400_000
PAGE = StructType([StructField(n, StringType()) for n in ("title", "text", "markup")])


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.markup: list[str] = []
        self.text: list[str] = []
        self.title: list[str] = []
        self.within = dict.fromkeys(("dropped", "furniture", "title", "style"), 0)

    @staticmethod
    def _role(tag: str) -> str | None:
        if tag in DROPPED:
            return None if tag in EMPTY_DROPPED else "dropped"
        return "furniture" if tag in FURNITURE else tag if tag in ("title", "style") else None

    def _tag(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        safe = [(k, v) for k, v in attrs if not k.startswith("on") and k not in UNSAFE and not (v and k in ("href", "src", "action") and not LINK.match(v.strip()))]
        return " ".join([tag, *[k if v is None else f'{k}="{escape(v)}"' for k, v in safe]])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        role = self._role(tag)
        if role == "dropped" or (role and not self.within["dropped"]):
            self.within[role] = 1 if role in ("title", "style") else self.within[role] + 1
        if tag not in DROPPED and not self.within["dropped"]:
            self.markup.append(f"<{self._tag(tag, attrs)}>")
            if tag in LINES:
                self.text.append("\n")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in DROPPED and not self.within["dropped"]:
            self.markup.append(f"<{self._tag(tag, attrs)} />")

    def handle_endtag(self, tag: str) -> None:
        role, silent = self._role(tag), self.within["dropped"]
        if role == "dropped" or (role and not silent):
            self.within[role] = max(0, self.within[role] - 1)
        if tag not in DROPPED and not silent:
            if tag not in ENDLESS:
                self.markup.append(f"</{tag}>")
            if tag in LINES:
                self.text.append("\n")

    def handle_data(self, data: str) -> None:
        if self.within["dropped"]:
            return
        if self.within["style"]:  # a sheet as it stands, but nothing in it can end its element
            self.markup.append(data.replace("</", "<\\/"))
            return
        self.markup.append(escape(data, quote=False))
        if self.within["title"]:
            self.title.append(data)
        elif data.strip() and not self.within["furniture"]:
            self.text.append(data)


def tidy(text: str) -> str:
    """Blanks drawn together, at most one empty line between two lines."""
    return EMPTY_LINES.sub("\n\n", BLANKS.sub(" ", text)).strip()


def page(raw: str) -> tuple[str | None, str, str]:
    """(title, text, markup) of a page; no title: None. The whole text."""
    p = _Page()
    p.feed(raw)
    p.close()
    return "".join(p.title).strip() or None, tidy("".join(p.text)), "".join(p.markup)


def decoded(body: bytes, content_type: str = "") -> str:
    """By the charset of the content type, a byte order mark, UTF-8, the charset that the head of the page names, Windows' Latin-1;
    what fits none of these is UTF-8 with replacements."""
    named = re.search(r"charset=[\"']?([\w-]+)", content_type, re.I)
    marks = [name for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")) if body.startswith(mark)]
    meta = re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", body[:2048], re.I)
    for charset in (named and named[1], *marks[:1], "utf-8", meta and meta[1].decode("ascii", "replace"), "cp1252"):
        try:
            if charset:
                return body.decode(charset)
        except (UnicodeDecodeError, LookupError):
            continue
    return body.decode("utf-8", "replace")


@F.pandas_udf(PAGE)
def read_page(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """title, text and markup of HTML; null: of an empty page."""
    for s in pages:
        yield pd.DataFrame([page(x) for x in s.fillna("")], columns=PAGE.names)


@F.pandas_udf(StringType())
def decode(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for body, kind in parts:
        yield pd.Series([None if b is None else decoded(bytes(b), k or "") for b, k in zip(body, kind, strict=True)], dtype=object)


def frame(markup: Column, base_url: Column) -> Column:
    """A document that shows the markup; its relative links follow base_url."""
    from .text import html_escape

    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><base href="'), html_escape(F.coalesce(base_url, F.lit(""))), F.lit('"></head><body>'))
    return F.concat(head, F.substring(markup, 1, WIDE), F.lit("</body></html>"))
