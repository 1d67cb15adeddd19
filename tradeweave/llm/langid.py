"""Language identification by a linear-chain conditional random field over the words of code-switched text.

1. The lexicon: for all documents to learn from, in how many of each language each word is (counted in the task, then by shuffle). Words
   of LEX_DOCS documents or more with one leading language are listed, the LEXICON most frequent of each language at most.
2. The sample: up to SAMPLE distinct texts of each language, chosen by hash, give up to EXCERPTS excerpts of WINDOW words.
3. Training, in EPOCHS jobs: each of SLICES slices of the sample starts from the same weights, joins excerpts of several languages into
   code-switched sequences, climbs their conditional log-likelihood (AdaGrad), and the weights are averaged (iterative
   parameter mixing). Weights: hashed character n-grams, affixes, the lexicon's verdict, first labels and transitions.
4. Labelling: forward-backward over every word of every whole text. A document's language is the one with the most
   letters, each word weighing by its posterior; the score is its share of them.

A word is a run of letters, case folded. Null text, or text without letters: `und`, score 0; so is every text if there is nothing to learn
from. A null doc_id is neither held out nor learnt from. Null lang isn't learnt from. Ties go to the language first by name. Repeated
rows are labelled one by one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, own, parts, ship, table

#: Documents that hold a listed word, listed words of a language, steps of the lead of its first language (share of relative frequency).
LEX_DOCS, LEXICON, LEADS = 5, 20_000, (0.6, 0.8, 0.95)
#: Distinct texts of a language that are learnt from (the bound of the fit), excerpts of each, their words.
SAMPLE, EXCERPTS, WINDOW = 600, 3, 40
SLICES, EPOCHS, BATCH, RATE, DECAY = 6, 3, 32, 0.3, 1e-5
#: Hashed n-grams and affixes, their greatest length, weights of a row that is averaged.
BUCKETS, GRAM, AFFIX, BLOCK = 1 << 16, 3, 3, 1 << 14
#: Languages up to which long texts are cut into chunks that are multiplied out side by side; words of a chunk.
FEW, CHUNK = 12, 32
#: Words a task remembers, and words that are labelled at once (a longer text alone).
ENTRIES, AT_ONCE = 200_000, 200_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
_P = np.uint64(0x100000001B3)
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The runs of letters, case folded; none if there is no letter."""
    found = WORD.findall(text.lower()) if text else []
    return found if text and (text.isascii() or any(c.isalpha() for w in found for c in w)) else []


@dataclass
class Model:
    langs: list[str]
    lexicon: dict[str, int] = field(default_factory=dict)  # 1 + language * len(LEADS) + step
    weights: np.ndarray | None = None  # of BUCKETS + 1 + len(langs) * len(LEADS) features
    edges: np.ndarray | None = None  # first labels, then transitions from each label

    def __post_init__(self) -> None:
        n = len(self.langs)
        if self.weights is None:
            self.weights, self.edges = np.zeros((BUCKETS + 1 + n * len(LEADS), n), np.float32), np.zeros((n + 1, n), np.float32)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, word) of all features of the words, ordered by word: n-grams and affixes each weigh one in all."""
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    begin, of = end - size, np.repeat(np.arange(len(words)), size)
    h, where, who, kind = c.copy(), [], [], []
    for n in range(1, GRAM + 1):
        if n > 1:
            h = h[:-1] * _P + c[n - 1 :]
        at = np.arange(len(h))
        inside = at + n <= end[of[: len(h)]]
        at = at[inside]
        for k, pick in ((0, slice(None)), (1, begin[of[at]] == at), (2, end[of[at]] == at + n)):
            if k == 0 or n <= AFFIX:
                x = (h[at[pick]] + np.uint64(n * 3 + k)) * _M
                where.append(((x ^ (x >> np.uint64(29))) * _M >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64))
                who.append(of[at[pick]])
                kind.append(np.full(len(who[-1]), k > 0))
    where, who, kind = np.concatenate(where), np.concatenate(who), np.concatenate(kind)
    many = np.bincount(who * 2 + kind, minlength=2 * len(words))
    value = (1 / many[who * 2 + kind]).astype(np.float32)
    known = BUCKETS + np.fromiter((lexicon.get(w, 0) for w in words), np.int64, len(words))
    where, who, value = np.concatenate((where, known)), np.concatenate((who, np.arange(len(words)))), np.concatenate((value, np.ones(len(words), np.float32)))
    order = np.argsort(who, kind="stable")
    return where[order], value[order], who[order]


def emissions(words: list[str], model: Model) -> np.ndarray:
    where, value, who = features(words, model.lexicon)
    return np.add.reduceat(model.weights[where] * value[:, None], np.searchsorted(who, np.arange(len(words))), axis=0)


def _unit(m: np.ndarray, axes: tuple[int, ...] = (-1,)) -> np.ndarray:
    return m / m.sum(axis=axes, keepdims=True)


def _vectors(psi: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors, each scaled to sum 1, of chunks psi (chunk, place, label) of the given sizes. left: the message
    into a chunk's first place; right: into its last."""
    forward, backward = np.empty_like(psi), np.empty_like(psi)
    now = left
    for t in range(psi.shape[1]):
        now = _unit((now if t == 0 else now @ step) * psi[:, t])
        forward[:, t] = now
    now = right
    for t in range(psi.shape[1] - 1, -1, -1):
        if t + 1 < psi.shape[1]:
            now = np.where((t + 1 < size)[:, None], _unit((psi[:, t + 1] * now) @ step.T), right)
        backward[:, t] = now
    return forward, backward


def posteriors(scores: np.ndarray, lengths: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The posterior of each label at each word of texts of the given lengths (1 at least), whose scores stand one after another."""
    n = scores.shape[1]
    first, step = np.exp(edges[0] - edges[0].max()).astype(np.float64), np.exp(edges[1:] - edges[1:].max()).astype(np.float64)
    width = min(CHUNK, int(lengths.max())) if n <= FEW else int(lengths.max())
    chunks = -(-lengths // width)
    base = np.cumsum(chunks) - chunks
    size = np.full(int(chunks.sum()), width)
    size[base + chunks - 1] = lengths - (chunks - 1) * width
    inside = np.arange(width) < size[:, None]
    psi = np.ones((len(size), width, n))
    psi[inside] = np.exp(scores - scores.max(axis=1, keepdims=True))
    left, right = np.tile(_unit(first), (len(size), 1)), np.full((len(size), n), 1 / n)
    if (chunks > 1).any():
        many = np.repeat(chunks, chunks) > 1
        whole = np.zeros((len(size), n, n))
        m = psi[many, 0][:, :, None] * np.eye(n)
        for t in range(1, width):
            m = np.where((t < size[many])[:, None, None], _unit((m.reshape(-1, n) @ step).reshape(m.shape) * psi[many, t][:, None, :], (1, 2)), m)
        whole[many] = m
        order = np.argsort(-chunks, kind="stable")
        for j in range(1, int(chunks.max())):
            at = base[order[: int((chunks > j).sum())]] + j
            left[at] = _unit(np.einsum("dl,dlm->dm", left[at - 1], whole[at - 1]) @ step)
        for j in range(int(chunks.max()) - 1, 0, -1):
            at = base[order[: int((chunks > j).sum())]] + j
            right[at - 1] = _unit(np.einsum("dlm,dm->dl", whole[at], right[at]) @ step.T)
    forward, backward = _vectors(psi, size, left, right, step)
    return _unit((forward * backward)[inside])


def gradient(scores: np.ndarray, gold: np.ndarray, length: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the conditional log-likelihood of padded sequences (sequence, place, label): by scores, and by edges."""
    first, step = np.exp(edges[0] - edges[0].max()).astype(np.float64), np.exp(edges[1:] - edges[1:].max()).astype(np.float64)
    n, inside = scores.shape[2], np.arange(scores.shape[1]) < length[:, None]
    psi = np.where(inside[:, :, None], np.exp(scores - scores.max(axis=2, keepdims=True)), 1.0)
    forward, backward = _vectors(psi, length, np.tile(_unit(first), (len(psi), 1)), np.full((len(psi), n), 1 / n), step)
    truth = np.eye(n)[gold]
    by_score = np.where(inside[:, :, None], truth - _unit(forward * backward), 0.0)
    pair = inside[:, 1:]
    expected = _unit((forward[:, :-1, :, None] * step * (psi * backward)[:, 1:, None, :])[pair], (1, 2)).sum(axis=0)
    seen = np.einsum("kl,km->lm", truth[:, :-1][pair], truth[:, 1:][pair])
    return by_score, np.concatenate((by_score[:, 0].sum(axis=0)[None], seen - expected))


def switched(texts: list[tuple[int, list[str]]], r: random.Random) -> list[list[tuple[str, int]]]:
    """Sequences of about WINDOW words that join pieces of several texts: half of them change language now and then."""
    out = []
    for label, words in r.sample(texts, len(texts)):
        if r.random() < 0.5:
            out.append([(w, label) for w in words])
        else:
            line: list[tuple[str, int]] = []
            while len(line) < WINDOW:
                label, words = r.choice(texts)
                take = min(len(words), 3 + int(r.expovariate(1 / 8)))
                at = r.randrange(len(words) - take + 1)
                line += [(w, label) for w in words[at : at + take]]
            out.append(line)
    return out


def climb(model: Model, texts: list[tuple[int, list[str]]], seed: int) -> Model:
    """One epoch over the texts (label, words), from the weights of model."""
    lines = switched(texts, random.Random(seed))
    words = sorted({w for line in lines for w, _ in line})
    number, n = {w: k for k, w in enumerate(words)}, len(model.langs)
    where, value, who = features(words, model.lexicon)
    cut = np.searchsorted(who, np.arange(len(words) + 1))
    weights, edges = model.weights.astype(np.float64), model.edges.astype(np.float64)
    speed, edge_speed = np.full(weights.shape, 1e-2), np.full(edges.shape, 1.0)
    for k in range(0, len(lines), BATCH):
        some = lines[k : k + BATCH]
        length = np.array([len(x) for x in some])
        ids, gold = np.zeros((len(some), length.max()), np.int64), np.zeros((len(some), length.max()), np.int64)
        for i, line in enumerate(some):
            ids[i, : len(line)], gold[i, : len(line)] = [number[w] for w, _ in line], [label for _, label in line]
        used, at = np.unique(ids, return_inverse=True)
        rows = np.concatenate([np.arange(cut[u], cut[u + 1]) for u in used])
        mine = np.repeat(np.arange(len(used)), cut[used + 1] - cut[used])
        scores = np.zeros((len(used), n))
        np.add.at(scores, mine, weights[where[rows]] * value[rows, None])
        by_score, by_edge = gradient(scores[at.reshape(ids.shape)], gold, length, edges)
        of_word = np.zeros((len(used), n))
        np.add.at(of_word, at.reshape(-1), by_score.reshape(-1, n))
        touched, to = np.unique(where[rows], return_inverse=True)
        g = np.zeros((len(touched), n))
        np.add.at(g, to, of_word[mine] * value[rows, None])
        g -= DECAY * weights[touched]
        speed[touched] += g * g
        weights[touched] += RATE * g / np.sqrt(speed[touched])
        by_edge = by_edge - DECAY * edges
        edge_speed += by_edge**2
        edges += RATE * by_edge / np.sqrt(edge_speed)
    return Model(model.langs, model.lexicon, weights.astype(np.float32), edges.astype(np.float32))


def learnable(docs: DataFrame) -> DataFrame:
    """(lang, text) of the documents to learn from: labelled and not held out."""
    return docs.where(~F.col("held_out") & F.col("known_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): of each task, in how many of its documents of lang the word is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(c)), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["lang", "word", "n"])
            seen.clear()

        held = 0
        for batch in parts(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = seen.setdefault(lang, Counter())
                held -= len(c)
                c.update(set(words_of(text)))
                held += len(c)
                if held > 2 * ENTRIES:
                    yield from out()
                    held = 0
        yield from out()

    return docs.mapInArrow(run, "lang string, word string, n long")


def lexicon_of(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(word, lang, step) of the listed words; sizes: (lang, n_docs), a row for each language."""
    counts = word_counts(docs).groupBy("lang", "word").agg(F.sum("n").alias("n")).join(F.broadcast(sizes), "lang")
    words = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("n_docs")).alias("all"), F.max(F.struct((F.col("n") / F.col("n_docs")).alias("share"), "lang")).alias("lead"))
    share = F.col("lead.share") / F.col("all")
    listed = words.where((F.col("n") >= LEX_DOCS) & (share >= LEADS[0])).select("word", F.col("lead.lang").alias("lang"), "n", sum((share >= x).cast("int") for x in LEADS[1:]).alias("step"))
    order = W.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    return listed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= LEXICON).select("word", "lang", "step")


def sample_of(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(slice, h, lang, words) of up to SAMPLE distinct texts of each language; texts stay in their tasks, excerpts go on."""
    h = F.xxhash64("text").alias("h")
    chosen = docs.select("lang", "text", h).join(F.broadcast(sizes), "lang").where(F.pmod(F.col("h"), F.lit(1_000_003)) * F.col("n_docs") <= 2 * SAMPLE * 1_000_003).select("lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            lang, hs, texts = [c.to_pylist() for c in batch.columns]
            out = []
            for at, text in zip(hs, texts, strict=True):
                words, r = words_of(text), random.Random(at)
                begins = [0] if len(words) <= WINDOW else [r.randrange(len(words) - WINDOW + 1) for _ in range(min(EXCERPTS, len(words) // WINDOW))]
                out.append([" ".join(words[b : b + WINDOW]) for b in begins] if words else [])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(hs, pa.int64()), pa.array(out, pa.list_(pa.string()))], names=["lang", "h", "words"])

    cut = chosen.mapInArrow(run, "lang string, h long, words array<string>").where(F.size("words") > 0).groupBy("lang", "h").agg(F.min("words").alias("words"))
    ordered = cut.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= SAMPLE)
    return ordered.select(F.pmod("h", F.lit(SLICES)).alias("slice"), "h", "lang", "words")


def _learner(sent: Broadcast, place: dict[str, int], epoch: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """One epoch over a slice, from the weights sent; gives them in blocks."""

    def learn(key: tuple, rows: pa.Table) -> pa.Table:
        got = sorted(zip(*[rows.column(c).to_pylist() for c in ("h", "lang", "words")], strict=True), key=lambda r: r[:2])
        model = climb(sent.value, [(place[lang], x.split(" ")) for _, lang, words in got for x in words], 1000 * epoch + key[0].as_py())
        flat = np.concatenate((model.edges.ravel(), model.weights.ravel()))
        return pa.table({"block": pa.array(range(0, len(flat), BLOCK), pa.int64()), "v": pa.array([flat[k : k + BLOCK] for k in range(0, len(flat), BLOCK)], pa.list_(pa.float32()))})

    return learn


def _mean(key: tuple, rows: pa.Table) -> pa.Table:
    """Sorted before it is summed up: the order of slices doesn't count."""
    v = np.sort(np.stack([np.array(x, np.float32) for x in rows.column("v").to_pylist()]), axis=0).mean(axis=0, dtype=np.float64)
    return pa.table({"block": [key[0].as_py()], "v": pa.array([v.astype(np.float32)], pa.list_(pa.float32()))})


def train(docs: DataFrame) -> Model | None:
    """The model learnt from documents (lang, text); None if no language has words."""
    spark = docs.sparkSession
    ship(spark)
    work = Scratch(spark, "langid")
    sizes = work.keep(docs.groupBy("lang").agg(F.count("*").alias("n_docs")), "sizes")
    sample = work.keep(sample_of(docs, sizes), "sample")
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not langs:
        return None
    place = {lang: k for k, lang in enumerate(langs)}
    listed = work.keep(lexicon_of(docs, sizes), "lexicon").collect()  # LEXICON words of a language at most
    model = Model(langs, {r.word: 1 + place[r.lang] * len(LEADS) + r.step for r in listed if r.lang in place})
    if len(langs) == 1:
        return model
    for epoch in range(EPOCHS):
        learnt = sample.repartition(SLICES, "slice").groupBy("slice").applyInArrow(_learner(spark.sparkContext.broadcast(model), place, epoch), "block long, v array<float>")
        rows = learnt.groupBy("block").applyInArrow(_mean, "block long, v array<float>").collect()
        flat = np.concatenate([np.array(r.v, np.float32) for r in sorted(rows, key=lambda r: r.block)])
        n = model.edges.size
        model = Model(langs, model.lexicon, flat[n:].reshape(model.weights.shape), flat[:n].reshape(model.edges.shape))
    return model


class Labeller:
    """Posteriors of whole texts; the scores of words are remembered up to ENTRIES."""

    def __init__(self, model: Model):
        self.model, self.known, self.scores = model, {}, np.empty((0, len(model.langs)), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > ENTRIES:
            self.known, self.scores, new = {}, self.scores[:0], list(set(words))
        if new:
            n = len(self.known)
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
            if len(self.scores) < n + len(new):
                more = np.empty((max(2 * len(self.scores), n + len(new)), self.scores.shape[1]), np.float32)
                more[:n] = self.scores[:n]
                self.scores = more
            for k in range(0, len(new), 8192):
                self.scores[n + k : n + k + 8192][: len(new) - k] = emissions(new[k : k + 8192], self.model)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def posteriors(self, texts: list[list[str]]) -> np.ndarray:
        """Of all words of the texts, none of them empty, one after another."""
        return posteriors(self.scores_of([w for t in texts for w in t]), np.array([len(t) for t in texts]), self.model.edges)

    def scores_of(self, words: list[str]) -> np.ndarray:
        ids = self._ids(words)
        return self.scores[ids]

    def shares(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """For each text the share of its letters by language; None without letters."""
        out: list[np.ndarray | None] = [None] * len(texts)
        group, at, held = [], [], 0

        def flush() -> None:
            if group:
                size = np.fromiter((len(w) for t in group for w in t), np.float64, held)
                sums = np.add.reduceat(self.posteriors(group) * size[:, None], np.cumsum([0, *map(len, group[:-1])]), axis=0)
                for k, s in zip(at, sums, strict=True):
                    out[k] = s / s.sum()

        for k, text in enumerate(texts):
            if words := words_of(text):
                if held and held + len(words) > AT_ONCE:
                    flush()
                    group, at, held = [], [], 0
                group.append(words)
                at.append(k)
                held += len(words)
        flush()
        return out


def identify(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """lang_pred and score of each text, beside the columns keep."""
    ship(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([docs.schema[k] for k in keep] + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    arrow, sent = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value) if sent.value else None
        for batch in parts(batches):
            texts = batch.column(len(keep)).to_pylist()
            found = labeller.shares(texts) if labeller else [None] * len(texts)
            best = [(UNKNOWN, 0.0) if s is None else (labeller.model.langs[int(s.argmax())], float(min(1.0, s.max()))) for s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())], schema=arrow)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def runs(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang): the runs of words that are labelled alike, in code points of the text; lower case that changes a
    text's length is left as it is there."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for batch in parts(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not words_of(text):
                    continue
                spans = [m.span() for m in WORD.finditer(text)]
                words = ["".join(WORD.findall(text[a:b].lower())) or text[a:b] for a, b in spans]
                best = labeller.posteriors([words]).argmax(axis=1)
                turn = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(spans)]
                out += [(doc_id, spans[a][0], spans[b - 1][1], sent.value.langs[best[a]]) for a, b in zip(turn[:-1], turn[1:], strict=True)]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "start", "end", "lang"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, lang string")


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, held_out, known_id): a document is held out if crc32 of its doc_id leaves 2 by 4."""
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return own(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(left == 2, F.lit(False)).alias("held_out"), F.col("doc_id").isNotNull().alias("known_id"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(table(spark, sf_dir, "documents"))
    return identify(docs, train(learnable(docs)), "doc_id", "held_out")
