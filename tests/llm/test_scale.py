"""Long, crowded and skewed inputs; results that don't depend on how rows are dealt out."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tradeweave.llm import common, decontaminate, neardup, pii, quotes, tokens
from tradeweave.llm.common import Scratch, meet

from ..oracle import SMALL
from .util import docs_of, words


def test_a_megabyte_of_dotted_digits():
    began = time.process_time()
    assert len(pii.base_spans("1." * 500_000)) == 125_000
    assert time.process_time() - began < 30


def test_a_message_of_a_hundred_thousand_quoted_lines():
    began = time.process_time()
    text = "\n".join(f"{'>' * (1 + i % 3)} line {i}" for i in range(100_000)) + "\nOn Monday A wrote:" * 50_000
    own_text, n, _, asked = quotes.parse(text)
    assert n == 100_000 and len({p for p, _, _ in asked}) == 100_000 and own_text.count("wrote") == 50_000
    assert time.process_time() - began < 30


@pytest.mark.parametrize("size", [decontaminate.SEGMENT + decontaminate.STEP - 1, 120])
def test_every_verbatim_excerpt_is_found(size):
    item = decontaminate.plain(words(60_000, 80))
    index = decontaminate.Index([(1, item.decode())])
    for at in range(len(item) - size):
        doc = words(at, 30) + " " + item[at : at + size].decode() + " " + words(at + 1, 30)
        assert (0, 1) in decontaminate.rows_with(index, [doc])


def test_every_eighth_word_replaced_is_found():
    for seed in range(40):
        text = " ".join(f"{w}ab" for w in words(70_000 + seed, 60).split())  # six letters, about
        changed = text.split(" ")
        changed[seed % 8 :: 8] = [f"q{i}" for i in range(len(changed[seed % 8 :: 8]))]
        index = decontaminate.Index([(1, text)])
        assert decontaminate.rows_with(index, [words(seed, 50) + " " + " ".join(changed)])


def test_short_items_match_whole_texts_only():
    index = decontaminate.Index([(1, "Yes!"), (2, "no")])
    assert set(decontaminate.rows_with(index, ["yes", "yes or no", "NO.", None])) == {(0, 1), (2, 2)}


def test_a_sentence_that_items_share_is_counted_in_parts(monkeypatch):
    shared = words(80_000, 30)
    items = [(i, f"{words(i, 2 + i % 5)} {shared} {words(i + 1, 20)}") for i in range(60)]
    index = decontaminate.Index(items)
    text = decontaminate.plain(" ".join([items[7][1], shared, shared, items[9][1]]))
    whole = sorted(index.search(text))
    monkeypatch.setattr(decontaminate, "CROWD", 500)
    assert sorted(index.search(text)) == whole


def test_frequencies_do_not_depend_on_layout(spark):
    rows = [(i, words(5, 60) + " " + words(100 + i, 40)) for i in range(400)]
    found = []
    for parts, batch in ((1, 10_000), (8, 100), (64, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found.append(neardup.idf_table(docs_of(spark, rows).repartition(parts)))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((f == found[0]).all() for f in found[1:]) and 56 <= (found[0][: len(found[0]) // 2] < 1).sum() <= 60


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = decontaminate.plain(words(3, 5000) + " " + "x" * 3000 + " " + words(4, 100))
    whole = neardup.word_hashes(text)
    assert len(whole) == text.count(b" ") + 1 and len(np.unique(whole)) == len(set(text.split()))
    neardup._powers.cache_clear()
    monkeypatch.setattr(neardup, "BLOCK", 700)
    assert (neardup.word_hashes(text) == whole).all()
    neardup._powers.cache_clear()


def test_differing_counts_samples(spark):
    r = random.Random(4)
    rows = []
    for _ in range(50):
        a = [[r.randrange(16) for _ in range(16)] for _ in range(neardup.PRINTS)]
        b = [[x if r.random() < 0.5 else r.randrange(16) for x in row] for row in a]
        pack = lambda v: [(x - (1 << 64) if x >> 63 else x) for x in (sum(d << 4 * i for i, d in enumerate(row)) for row in v)]
        rows.append((*pack(a), *pack(b), sum(x != y for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))))
    n = neardup.PRINTS
    df = spark.createDataFrame(rows, ", ".join(f"c{i} long" for i in range(2 * n)) + ", want int")
    got = df.select(neardup.differing([F.col(f"c{i}") for i in range(n)], [F.col(f"c{n + i}") for i in range(n)]).alias("got"), "want")
    assert got.where("got <> want").count() == 0


def test_meet_is_a_join(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    keys = Scratch(spark, "t").keep(keys, "keys")
    got = meet(rows, keys, "k")
    assert got.count() == 20_000 and got.where("v <> 2 * k").count() == 0


def test_long_chunks_are_not_kept():
    path = tokens.vocabulary("byte_bpe_50k.json")
    e = tokens.Encoder(path)
    text = "a " + "xyz" * 1000 + " b " + "q" * 500 + "."
    assert e.ids(text) == e.direct(text) and max(map(len, e.spaced)) <= tokens.LONG


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, name, default):
            return default

    class Far:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Far())


def test_results_of_one_run_outlive_the_next(spark):
    first = corpus_pipeline.run(spark, SMALL)
    n = first.count()
    assert corpus_pipeline.run(spark, SMALL).count() == n == first.count()


def test_searching_holds_little_beside_the_texts():
    """Benchmark passages everywhere, 3 MB of texts."""
    import tracemalloc

    items = [(i, words(i, 60)) for i in range(100)]
    index, texts = decontaminate.Index(items), [words(i, 300) + " " + items[i % 100][1] for i in range(1000)]
    decontaminate.rows_with(index, texts[:10])
    tracemalloc.start()
    found = decontaminate.rows_with(index, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {r for r, _ in found} == set(range(1000)) and peak < 48e6


def test_batches_of_long_rows_are_bounded(spark):
    rows = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('x', 5000) text")
    common.ship(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})

    got = rows.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(x.rows for x in got) == 4000 and max(x.size for x in got) <= common.BATCH_BYTES + 10_000
