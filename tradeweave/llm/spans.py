"""Spans in texts: (kind, start, end) in code points, end exclusive, and the columns that queries derive from them."""

from __future__ import annotations

import hashlib

from pyspark.sql.types import LongType, StringType, StructField, StructType

Span = tuple[str, int, int]


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then kind as listed."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def counted(kinds: tuple[str, ...]) -> StructType:
    """The columns n_<kind> and base_sha256."""
    return StructType([*(StructField(f"n_{k}", LongType()) for k in kinds), StructField("base_sha256", StringType())])


def counts(base: list[Span], kinds: tuple[str, ...]) -> tuple:
    """The values of counted(kinds) for the ordered base spans."""
    return (*(sum(k == s[0] for s in base) for k in kinds), digest(base))
