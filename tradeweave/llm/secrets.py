"""Secret scans with multipart credential linking.

Base patterns are reported by themselves. Beyond them a text has parts of credentials that prove nothing alone: identifiers
(a login, a client id), weak secrets (a short value, a value under a vague name) and endpoints. Within a scope (a paragraph)
they are joined as intervals: a weak candidate is reported only when complementary parts lie within REACH of it, that is an
identifier or a weak secret near a part of another class. The join is by sorted ends in numpy, inside the row: scopes never
cross documents, so no row leaves its task, and parts are counted, never paired.

Every pattern scans a text once, in linear time; a text is scanned only if it holds what the pattern needs. Null and empty
texts have no spans. Repeated rows are scanned one by one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_rows, own, table
from .spans import Span, counted, counts, joined, ordered

#: Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
BASE = ("assign", "access", "hex")

#: The method's own patterns: a name, then a value.
KINDS = (*BASE, "login", "weak")
LOGIN = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.ASCII | re.IGNORECASE)
WEAK = re.compile(r"""\b(?:pwd|pass(?:phrase)?|credentials?|private_?key|auth(?:_?key)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", re.ASCII | re.IGNORECASE)
ENDPOINT = re.compile(r"""https?://[^\s"'<>]{3,}|\b(?:host(?:name)?|endpoint|server|database)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{3,}""", re.ASCII | re.IGNORECASE)
#: A weak value under a base name has at least so many characters.
WEAK_LEAST = 6
#: Characters between complementary parts of one credential, at most.
REACH = 300
SCOPE = re.compile(r"\n[ \t\r]*\n")

_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_RUN = b"x" * LEAST["hex"]
_NAMES, _LOGINS, _WEAKS = ("passw", "secret", "token", "api"), ("user", "login", "account", "client", "access"), ("pwd", "pass", "credential", "private", "auth")


def base_spans(text: str, low: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The base spans, and the assignments whose value is too short for one."""
    found: list[Span] = []
    short = []
    if any(n in low for n in _NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append(("assign", *m.span()))
            elif m.end(2) - m.start(2) >= WEAK_LEAST:
                short.append(m.span())
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if _RUN in text.encode("utf-8", "surrogatepass").translate(_HEX):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return ordered(found, BASE), short


def _near(at: np.ndarray, scope: np.ndarray, to: np.ndarray, to_scope: np.ndarray) -> np.ndarray:
    """Which of the intervals at (start, end) have one of to within REACH, in their scope."""
    if not len(at) or not len(to):
        return np.zeros(len(at), bool)
    far = int(max(at.max(), to.max())) + REACH + 1  # scopes are set apart by this, so one sorted array holds all
    starts, ends = np.sort(to[:, 0] + to_scope * 2 * far), np.sort(to[:, 1] + to_scope * 2 * far)
    lo, hi = at[:, 0] - REACH + scope * 2 * far, at[:, 1] + REACH + scope * 2 * far
    return np.searchsorted(starts, hi, "right") > np.searchsorted(ends, lo, "left")  # begun by hi, more than ended before lo


def linked(text: str, low: str, base: list[Span], short: list[tuple[int, int]]) -> list[Span]:
    """The weak candidates that complementary parts support."""
    logins = [m.span() for m in LOGIN.finditer(text)] if any(n in low for n in _LOGINS) else []
    weak = short + ([m.span() for m in WEAK.finditer(text)] if any(n in low for n in _WEAKS) else [])
    if not logins and not weak:
        return []
    ends = [("://" in low or "host" in low or "endpoint" in low or "server" in low or "database" in low) and m.span() for m in ENDPOINT.finditer(text)]
    cuts = np.array([m.start() for m in SCOPE.finditer(text)], np.int64)
    array = lambda spans: np.array(spans, np.int64).reshape(-1, 2)
    of = lambda a: np.searchsorted(cuts, a[:, 0], "right").astype(np.int64)
    L, W, E = array(logins), array(weak), array([x for x in ends if x])
    S = array([s[1:] for s in base if s[0] != "access"] + weak)
    I = array([s[1:] for s in base if s[0] == "access"] + logins)  # noqa: E741
    keep_login = _near(L, of(L), S, of(S))
    keep_weak = _near(W, of(W), I, of(I)) | _near(W, of(W), E, of(E))
    out = [("login", *x) for x, k in zip(logins, keep_login, strict=True) if k] + [("weak", *x) for x, k in zip(weak, keep_weak, strict=True) if k]
    taken = array(sorted(s[1:] for s in base))
    if len(taken):
        reach = np.maximum.accumulate(taken[:, 1])
        free = lambda a, b: (i := int(np.searchsorted(taken[:, 0], b))) == 0 or reach[i - 1] <= a
        out = [s for s in out if free(s[1], s[2])]
    return out


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each ordered."""
    if not text:
        return [], []
    low = text.lower()
    base, short = base_spans(text, low)
    more = linked(text, low, base, short)
    return base, ordered(base + more, KINDS) if more else base


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row."""
    schema = StructType([docs.schema["doc_id"], *counted(BASE).fields, StructField("spans", StringType())])

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [(*counts(base, BASE), joined(full)) for base, full in map(scan, cols["text"])]
        return {"doc_id": cols["doc_id"]} | dict(zip(schema.names[1:], map(list, zip(*rows)), strict=True))

    return map_rows(own(docs, "doc_id", "text"), run, schema)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The rows with each span (overlapping ones as one) of their text replaced; all columns stay. n_chars follows the text."""
    schema = docs.schema

    def hide(text: str | None) -> str | None:
        spans = scan(text)[1]
        if not spans:
            return text
        out, at = [], 0
        for _, a, b in spans:
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(cols: dict[str, list]) -> dict[str, list]:
        new = [hide(t) for t in cols["text"]]
        sizes = [None if n is None or t is None else len(t) for n, t in zip(cols["n_chars"], new, strict=True)] if "n_chars" in cols else None
        return cols | {"text": new} | ({"n_chars": sizes} if sizes is not None else {})

    return map_rows(docs, run, schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
