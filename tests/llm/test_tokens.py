import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tradeweave.llm import packing, tokenfile
from tradeweave.llm.common import Scratch, table
from tradeweave.llm.tokens import encoder, vocabulary

from ..oracle import SMALL
from .util import ODD, docs_of, words


def plain(path, text):
    from tokenizers import Tokenizer

    global _cache
    if path not in _cache:
        _cache[path] = Tokenizer.from_file(path)
        _cache[path].encode_special_tokens = True  # as in the vocabularies' own guide: their strings in a text are ordinary text
    return _cache[path].encode(text or "", add_special_tokens=False).ids


_cache = {}


def noise(seed):
    r = random.Random(seed)
    parts = ["the", " Cat", ".", ",", "a.", "U.S.", "it's", "I'M", "  ", "\n", " \n ", "\t", "\r\n", "é", "Éa", "ß", "ж", "中文", "\U0001f600", "12,345.67", "x" * 30, "_", " ", "​", "é", "</s>", "<s>", "don't", "end.\n", "\x00", "İ", "ﬁ"]
    return "".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randrange(1, 50)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(spark, name):
    path = vocabulary(name)
    texts = [t for _, t in ODD] + [noise(i) for i in range(3000)] + [r.text for r in table(spark, SMALL, "documents").select("text").collect()]
    for t in texts:
        got = np.frombuffer(encoder(path).ids(t), "<u4").tolist()
        assert got == plain(path, t), (t or "")[:300]


def test_token_files_round_trip(spark):
    path = vocabulary("word_bpe_49k.json")
    rows = [*ODD, *((100 + i, noise(i)) for i in range(200))]
    random.Random(1).shuffle(rows)
    shards = tokenfile.write(docs_of(spark, rows), path, Scratch(spark, "t").path, shards=5)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read(shards, shards.count()).collect())
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        ids = np.array([*plain(path, t), 2], "<u4").tobytes()
        want[i].append((len(ids) // 4, zlib.crc32(ids)))
    at = 0
    for start, doc, n, crc in got:
        assert start == at and (n, crc) in want[doc]
        want[doc].remove((n, crc))
        at += n
    ids = [d for _, d, _, _ in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_no_documents_no_files(spark):
    shards = tokenfile.write(docs_of(spark, []), vocabulary("word_bpe_49k.json"), Scratch(spark, "t").path)
    assert tokenfile.read(shards, shards.count()).collect() == []


def check_packing(rows, got, path):
    docs = defaultdict(list)
    for i, t in rows:
        ids = np.array([*plain(path, t), 0], "<u4")
        docs[i].append(ids)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert 1 <= r.length and r.offset + r.length <= 1024
    for d, ids in docs.items():
        want = Counter((a, min(1024, len(x) - a), zlib.crc32(x[a : a + 1024].tobytes()), len(x)) for x in ids for a in range(0, len(x), 1024))
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[d]) == want
    for at in by_seq.values():
        end = 0
        for o, n in sorted(at):
            assert o == end
            end = o + n
    assert sorted(by_seq) == list(range(len(by_seq)))
    for r in got:
        ids = sum(n for _, n in by_seq[r.sequence_id])
        assert r.sequence_length == (ids if ids.bit_count() == 1 else 1024)
    return sum(n for at in by_seq.values() for _, n in at) / (1024 * max(1, len(by_seq)))


def test_packing(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = [*ODD, *((100 + i, words(i, i % 400)) for i in range(300)), *((2000 + i, "same text again") for i in range(700))]
    assert check_packing(rows, packing.pack(docs_of(spark, rows), path).collect(), path) > 0.97
    small = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    check_packing(small, packing.op1_packing(spark, SMALL).collect(), path)
    assert packing.pack(docs_of(spark, []), path).collect() == []


def test_patterns_hold_every_piece():
    for seed in range(50):
        r = random.Random(seed)
        counts = {r.randrange(1, 65): r.randrange(1, 500) for _ in range(r.randrange(1, 40))}
        found = packing.patterns(counts, 64)
        assert all(sum(p) <= 64 for p, _ in found)
        total = Counter()
        for p, n in found:
            for x in p:
                total[x] += n
        assert dict(total) == counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_hold_when_known_chunks_are_let_go(monkeypatch, name):
    from tradeweave.llm import tokens

    monkeypatch.setattr(tokens, "KNOWN", 400)
    small = tokens.Encoder(vocabulary(name))
    for i in range(300):
        t = words(i % 40, 60) + ". Über déjà-vu " + noise(i)
        assert np.frombuffer(small.ids(t), "<u4").tolist() == plain(vocabulary(name), t)
    assert small.older
