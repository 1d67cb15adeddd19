"""Personal data: exact base patterns, and weak supervision for what patterns alone can't decide.

Base spans (email, ip, card, phone) are reported by themselves. Other candidates (identity numbers, bank accounts, local
phone numbers, people after a title or a label, street addresses, dates of birth) get votes of labelers: the regex labeler
checks their inner form, the gazetteers know names, streets and places, the context labelers read the characters before and
after and look for base spans nearby. Votes are for, against or none.

All candidates of the corpus are counted by their votes and features (a bounded set of patterns; counts are summed in the
tasks first). From those counts, with no row sampled, expectation-maximisation estimates how reliable each labeler is and
how likely each pattern is personal data; a logistic classifier over votes, kind, length and position is trained on these
soft labels, and its decision for each pattern is what adds spans to the base ones.

Patterns take linear time on any text: runs are consumed whole, an email is found from its at sign. Null and empty texts
have no spans. Repeated rows are scanned one by one. Without candidates nothing is trained; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import Scratch, map_rows, own, table
from .spans import Span, counted, counts, joined, ordered

#: Fixed values of the base patterns.
BASE = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")

#: Candidates beyond them, by kind.
CANDIDATES = {
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "local": re.compile(r"(?<![0-9A-Za-z+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"),
    "person": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Name|Contact)[.:]\x20?[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20}){1,2}\b"),
    "street": re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}\x20(?:[A-Z][a-z]{1,20}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b"),
    "birth": re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9A-Za-z])"),
}
KINDS = (*BASE, *CANDIDATES)
#: Words of the gazetteers and of the contexts that speak for a kind, or against any.
FIRST_NAMES = frozenset("alice anna ben bob carlos carol claire david elena emma eva frank george hans helen ivan jack james jane john jose julia karl laura linda lucas maria mark mary michael nina olga paul peter robert sara sarah sofia susan thomas tom william".split())
STREETS = frozenset("street st avenue ave road rd lane ln drive dr boulevard blvd".split())
CONTEXT = {
    "ssn": ("ssn", "social security", "tax id"),
    "iban": ("iban", "account", "bank", "transfer"),
    "local": ("phone", "telephone", "tel", "call", "mobile", "fax", "cell", "cellphone"),
    "person": ("contact", "name", "dear", "signed", "by"),
    "street": ("address", "addresses", "lives", "reside", "resident", "residence", "residing", "residential", "ship to", "home"),
    "birth": ("born", "birth", "birthday", "birthdate", "dob"),
}
AGAINST = ("version", "isbn", "order", "ref", "reference", "item", "invoice", "#", "$", "page", "figure", "table")
BEFORE, NEAR = 32, 120


def _words(of: tuple[str, ...]) -> re.Pattern:
    """Any of these as whole words, or a plural; signs anywhere."""
    return re.compile("|".join(rf"(?<![a-z0-9]){w}s?(?![a-z0-9])" if w[0].isalpha() else re.escape(w) for w in of), re.IGNORECASE | re.ASCII)


_CONTEXT, _AGAINST = {k: _words(v) for k, v in CONTEXT.items()}, _words(AGAINST)
LABELERS = ("form", "gazetteer", "context", "against", "nearby")
#: Candidates that the counts of patterns stand for in training, whatever their number.
WEIGHT = 10_000
#: A pattern adds its spans when the classifier gives it at least this probability.
DECIDE = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each at sign: the whole run before it, not into the last match, and the longest domain after it."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = start < at and DOMAIN.match(text, at + 1)
        if m:
            out.append(("email", start, done := m.end()))
        else:
            done = max(done, at)  # the run is not looked through again
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in DOTTED.finditer(text):
        run = m.group()
        if run.count(".") >= 3:
            parts, a = run.split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = a + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append(("ip", a, end))
                a = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return ordered(out, BASE)


def form(kind: str, s: str) -> int:
    """The regex labeler: whether the inner form holds."""
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "ssn":
        return 1 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else -1
    if kind == "iban":
        flat = s.replace(" ", "")
        return 1 if 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    if kind == "local":
        return 1 if digits[0] not in "01" and digits[3] not in "01" else -1
    if kind == "birth":
        year = int(digits[:4] if s[4:5] == "-" else digits[-4:])
        return 0 if 1900 <= year <= 2020 else -1
    return 0


def votes(kind: str, text: str, a: int, b: int, base: np.ndarray) -> str:
    """A letter for each labeler: + for, - against, 0 none."""
    s = text[a:b]
    since, after = max(0, a - BEFORE), text[b : b + 2]
    words = set(re.findall(r"[a-z]+", s.lower()))
    known = 1 if words & (FIRST_NAMES if kind == "person" else STREETS if kind == "street" else frozenset()) else 0  # a name that the gazetteer lacks says nothing
    near = len(base) and np.searchsorted(base, b + NEAR) > np.searchsorted(base, a - NEAR)
    says = (form(kind, s), known, int(bool(_CONTEXT[kind].search(text, since, a) or _CONTEXT[kind].search(text, a, min(b, a + 8)))), -int(bool(_AGAINST.search(text, since, a)) or after[:1] in ("%", "€", "$")), int(bool(near)))
    return "".join("0+-"[v] for v in says)


def scan(text: str | None) -> tuple[list[Span], list[tuple[str, int, int, str]]]:
    """(ordered base spans, candidates with their pattern: kind, votes, length)."""
    if not text:
        return [], []
    base = base_spans(text)
    found: list[tuple[str, int, int, str]] = []
    digits = bool(_DIGIT.search(text))
    taken, reach = np.array([s[1] for s in base], np.int64), np.maximum.accumulate(np.array([s[2] for s in base] or [0], np.int64))
    for kind, pattern in CANDIDATES.items():
        if not (digits if kind != "person" else (". " in text or ": " in text)):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            i = int(np.searchsorted(taken, b))
            if i and reach[i - 1] > a:
                continue  # a base span has it
            found.append((kind, a, b, f"{kind}|{votes(kind, text, a, b, taken)}|{min((b - a) // 8, 3)}"))
    return base, found


def reliabilities(says: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Expectation-maximisation over patterns (rows of votes 1, -1, 0; n: how often): the probability that each is personal data.

    A labeler has, for either truth, a probability of each vote; it is taken to err independently of the others. Begins at the
    votes' majority; one pseudo-count a vote keeps probabilities off 0."""
    p = 1 / (1 + np.exp(-says.sum(1)))
    for _ in range(rounds):
        prior = ((p * n).sum() + 1) / (n.sum() + 2)
        log = np.tile(np.log([prior, 1 - prior]), (len(n), 1))
        for k in range(says.shape[1]):
            for v in (1, -1, 0):
                hit = says[:, k] == v
                for c, w in enumerate((p * n, (1 - p) * n)):
                    log[hit, c] += np.log((w[hit].sum() + 1) / (w.sum() + 3))
        p = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))
    return p


def classifier(x: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft labels p of rows that occur n times (Newton steps)."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - q)) - ridge * w
        w = w + np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), g)
    return w


def train(patterns: dict[str, int]) -> set[str]:
    """The patterns whose spans are personal data."""
    if not patterns:
        return set()
    names = sorted(patterns)
    n = np.array([patterns[x] for x in names], float)
    n = n * (WEIGHT / n.sum())  # shares, so that prior and ridge weigh the same at every size of corpus
    split = [x.split("|") for x in names]
    says = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in v] for _, v, _ in split])
    p = reliabilities(says, n)
    kinds, sizes = sorted(CANDIDATES), range(4)
    x = np.array([[1.0, *v, *(k == kind for k in kinds), *(int(size) == s for s in sizes)] for v, (kind, _, size) in zip(says, split, strict=True)])
    q = 1 / (1 + np.exp(-np.clip(x @ classifier(x, p, n), -30, 30)))
    return {name for name, a in zip(names, q, strict=True) if a >= DECIDE}


def personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row."""
    spark = docs.sparkSession
    span = StructType([StructField("kind", StringType()), StructField("a", LongType()), StructField("b", LongType()), StructField("pattern", StringType())])
    schema = StructType([docs.schema["doc_id"], *counted(BASE).fields, StructField("base", StringType()), StructField("found", ArrayType(span))])

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [(*counts(base, BASE), joined(base), [dict(zip(("kind", "a", "b", "pattern"), f, strict=True)) for f in found]) for base, found in map(scan, cols["text"])]
        return {"doc_id": cols["doc_id"]} | dict(zip(schema.names[1:], map(list, zip(*rows)), strict=True))

    scanned = Scratch(spark, "pii").keep(map_rows(own(docs, "doc_id", "text"), run, schema), "scanned")
    tally = scanned.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    yes = train({r["pattern"]: r["n"] for r in tally.collect()})  # kinds x votes x lengths at most
    kept = F.filter("found", lambda f: f["pattern"].isin(*sorted(yes))) if yes else F.array().cast(ArrayType(span))
    extra = F.transform(kept, lambda f: F.concat_ws(":", f["kind"], f["a"], f["b"]))
    rank = F.create_map(*[F.lit(x) for k, i in zip(KINDS, range(len(KINDS)), strict=True) for x in (k, i)])
    key = lambda s: F.struct(F.split(s, ":")[1].cast("long"), rank[F.split(s, ":")[0]], F.split(s, ":")[2].cast("long"))
    every = F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ",")), extra)
    spans = F.array_join(F.transform(F.array_sort(F.transform(every, lambda s: F.struct(key(s).alias("k"), s.alias("s")))), lambda t: t["s"]), ",")
    return scanned.select("doc_id", *counted(BASE).names, F.when(F.size(kept) == 0, F.col("base")).otherwise(spans).alias("spans"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(table(spark, sf_dir, "documents"))
