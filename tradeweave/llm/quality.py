"""Repetition coverage: how much of a text lies in n-grams and lines that it repeats.

For each text, in one pass and without a shuffle: word windows of several lengths get rolling hashes in numpy; windows
whose hash occurs twice or more are duplicated; the characters of words inside them are measured. A window of n words can
only be duplicated where both its (n-1)-windows are, so after the shortest length only those places are hashed and sorted.

Null and empty texts have no words: all measures are 0 and the text is rejected (too few words). Repeated rows are judged
one by one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import filter_rows, map_rows, own, table

#: Fixed values of the base rule.
MIN_WORDS, WINDOW, REPEAT_PERCENT, SYMBOLS = 10, 5, 20, "#*$%&|<>"
#: Share of word characters inside duplicated n-grams above which a text is rejected, by n; and inside repeated lines.
LIMITS = {5: 0.35, 6: 0.34, 7: 0.33, 8: 0.32, 9: 0.31, 10: 0.30}
LINE_LIMIT = 0.30

SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^ \t-\r]+")
_C = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads small integers over all bits."""
    x = (x + np.uint64(1)) * _C
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _twice(h: np.ndarray, at: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Those of the places at whose windows of n ids occur twice or more; h: their hashes."""
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return at[:0]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    if all((ids[a + k] == ids[b + k]).all() for k in range(n)):
        return np.union1d(a, b)
    seen = Counter(ids[p : p + n].tobytes() for p in at)  # two windows share a hash: count the windows themselves
    return at[[seen[ids[p : p + n].tobytes()] > 1 for p in at]]


def _windows(v: np.ndarray, n: int) -> np.ndarray:
    """A rolling hash of each window of n values."""
    h = v[: len(v) - n + 1].copy()
    for k in range(1, n):
        h *= _C
        h += v[k : k + len(h)]
    return h


def duplicated(ids: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each n of lengths (rising by one): a mask of the words inside n-windows that occur twice or more."""
    size, out = len(ids), {n: np.zeros(len(ids), bool) for n in lengths}
    if size <= lengths[0]:
        return out
    v = mix(ids.astype(np.uint64))
    h = _windows(v, lengths[0])
    at = np.arange(len(h))
    for n in lengths:
        if n > lengths[0]:
            pair = np.flatnonzero(at[1:] == at[:-1] + 1)  # where both shorter windows are duplicated
            h, at = h[pair], at[pair]
            h = h * _C + v[at + n - 1]
        if len(at) < 2:
            break
        two = _twice(h, at, ids, n)
        h = h[np.searchsorted(at, two)]
        at = two
        edges = np.bincount(at, minlength=size + 1) - np.bincount(at + n, minlength=size + 1)
        out[n] = np.cumsum(edges[:size]) > 0
    return out


def repeats(words: list[bytes]) -> bool:
    """Whether a window of WINDOW words may occur twice: never False where one does."""
    if len(words) <= WINDOW:
        return False
    h = np.sort(_windows(np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64), WINDOW))
    return bool((h[1:] == h[:-1]).any())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, then the characters by n of LIMITS."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly SPACES
    chars = len(text) - sum(text.count(c) for c in SPACES)
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if bare := line.strip(SPACES):
            if line in seen:
                dup_lines += 1
                dup_chars += len(bare) - sum(bare.count(c) for c in SPACES)
            seen.add(line)
    covered, repeat = [0] * len(LIMITS), 0
    if repeats(words):
        number = dict(zip(dict.fromkeys(words), range(len(words))))
        masks = duplicated(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), tuple(LIMITS))
        if repeat := int(masks[WINDOW].sum()):
            size = np.fromiter(map(len, WORD.findall(text)), np.int64, len(words))
            covered = [int(size[m].sum()) for m in masks.values()]
    return (len(words), chars, sum(text.count(c) for c in SYMBOLS), dup_lines, repeat, dup_chars, *covered)


def verdict(m: tuple) -> tuple[bool, bool]:
    """(base_failed, kept) for what measure() gives."""
    n, chars, _, _, repeat, lines, *covered = m
    failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
    over = lines > LINE_LIMIT * chars or any(c > limit * chars for c, limit in zip(covered, LIMITS.values(), strict=True))
    return failed, not failed and not over


def quality(docs: DataFrame, *keep: str) -> DataFrame:
    """The measures and the verdict of each row, beside its columns keep."""
    fields = [f for f in own(docs, *keep).schema.fields]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in LIMITS)]
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    schema = StructType(fields + [StructField(n, LongType()) for n in names if n not in keep] + [StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [measure(t) for t in cols["text"]]
        out = {k: cols[k] for k in keep} | dict(zip(names, map(list, zip(*rows)), strict=True))
        out["base_failed"], out["kept"] = map(list, zip(*map(verdict, rows)))
        return out

    return map_rows(own(docs, *dict.fromkeys([*keep, "text"])), run, schema)


def kept(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, that the rules keep. No shuffle."""
    return filter_rows(docs, lambda texts: [verdict(measure(t))[1] for t in texts])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), "doc_id")
