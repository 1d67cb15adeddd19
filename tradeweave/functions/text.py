"""Names, identifiers, dates and similar scalars, as column expressions; similarity of names as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .dims import HONORIFICS, SUFFIXES


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(c: Column) -> Column:
    """Organisation names for matching: lower case, no punctuation, no legal form."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "&", " and ")
    s = F.regexp_replace(s, r"(?U)[^\w\s]", " ")
    return squeeze(F.regexp_replace(s, rf"(?U)\b({'|'.join(SUFFIXES)})\b", " "))


def normalize_person(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"(?U)\b({'|'.join(HONORIFICS)})\b\.?", " ")
    return squeeze(F.regexp_replace(s, r"(?U)[^\w\s]", " "))


def folded(x: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^\w\s]|_", " ", flat).split())


@F.pandas_udf(StringType())
def fold_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Without case, accents and punctuation; Spark has no function for Unicode decomposition."""
    for s in texts:
        yield s.fillna("").map(folded)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))), 1, 12))


def entity_id(uei: Column, lei: Column, cage: Column, name: Column) -> Column:
    """By the first identifier there is: uei, lei, cage, name."""
    some = lambda c: c.isNotNull() & (c != "")
    out = stable_id("ent", F.lit("name"), normalize_name(name))
    for kind, c in (("cage", cage), ("lei", lei), ("uei", uei)):
        out = F.when(some(c), stable_id("ent", F.lit(kind), F.upper(c))).otherwise(out)
    return out


def person_id(name: Column, ref: Column) -> Column:
    return stable_id("per", normalize_person(name), ref)


def location_id(code: Column) -> Column:
    return F.concat(F.lit("loc_"), F.regexp_replace(F.upper(code), " ", "_"))


def day_of(c: Column) -> Column:
    """The date that an ISO string begins with, or null."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def whole_date(c: Column) -> Column:
    """2019-00-00 and 2019-05 become 2019-01-01 and 2019-05-01."""
    part = lambda i: F.get(F.split(c, "-"), F.lit(i))
    fill = lambda p: F.when(p.isNull() | (p == "") | (p == "00"), "01").otherwise(F.lpad(p, 2, "0"))
    return F.when(c.rlike(r"^[0-9]{4}"), F.concat_ws("-", part(0), fill(part(1)), fill(part(2))))


def scrub_url(c: Column) -> Column:
    """Without credentials in its query."""
    return F.regexp_replace(c, r"(?i)([?&](?:api_?key|key|token|access_token|subscription-key)=)[^&#]*", "$1REDACTED")


def country_code(country: Column, state: Column) -> Column:
    c = F.upper(F.trim(country))
    two = F.when(c.isin("USA", "US"), "US").when(F.length(c) == 3, F.substring(c, 1, 2)).otherwise(c)
    return F.when((two == "US") & state.isNotNull() & (state != ""), F.concat(F.lit("US-"), F.upper(state))).otherwise(two)


def is_sole_source(extent: Column, offers: Column, solicitation: Column) -> Column:
    """An award that wasn't competed, was solicited from one source, or got one offer."""
    says = lambda c, words: F.upper(F.coalesce(c, F.lit(""))).contains(words)
    return says(extent, "NOT COMPETED") | says(solicitation, "ONLY ONE SOURCE") | F.coalesce(offers.cast("string") == "1", F.lit(False))


def _indel(a: str, b: str) -> float:
    """100 times the share of characters in a longest common subsequence (bits of a number stand for places in a)."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & at.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return 200.0 * (len(a) - open_.bit_count()) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return _indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of: common words against either side's words, and either side's against the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max(_indel(left, right), *((_indel(both, left), _indel(both, right)) if both else ()))


def match_score(a: str, b: str) -> float:
    """Of two normalised names. The set score counts only for names of like length: else a part would match its whole."""
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    low, high = sorted((len(a), len(b)))
    return max(token_sort(a, b), token_set(a, b)) if low / high >= 0.6 else token_sort(a, b)


@F.pandas_udf(DoubleType())
def name_score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([match_score(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def person_score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Both names need two words."""
    for a, b in pairs:
        yield pd.Series([token_sort(x, y) if x and y and " " in x and " " in y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
