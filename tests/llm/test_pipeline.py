import corpus_pipeline
from tradeweave.llm import decontaminate, quality, secrets
from tradeweave.llm.common import table

from ..oracle import SMALL
from .test_duplicates import brute, classes
from .util import words


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    columns, all_rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, fn in corpus_pipeline.STAGES:
        out = fn(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["quality_rules"]) == {i for i, t in all_rows.items() if quality.verdict(quality.measure(t))[1]}
    rows = list(kept["quality_rules"].items())
    groups = classes(brute(rows), [i for i, _ in rows])
    stay = kept["near_duplicates"]
    assert len({groups[i] for i in stay}) >= len(set(groups.values())) - 1 and abs(len(stay) - len(set(groups.values()))) <= 2
    index = decontaminate.Index([(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()])
    assert set(kept["decontamination"]) == {i for i, t in stay.items() if not index.search(decontaminate.plain(t))}
    for i, t in kept["secret_scans"].items():
        assert not secrets.scan(t)[0] and (t == kept["decontamination"][i] or "[SECRET]" in t)
    packed = docs.groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in packed} == set(kept["secret_scans"])


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scans", "packing"]


def test_odd_tables(spark, tmp_path):
    """Nulls, empty and equal texts, equal rows and ids, extra columns with names that operators use inside; and no rows at all."""
    text = words(1, 80)
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (4, text), (5, text), (None, words(2, 60)), (None, words(3, 60)), (6, words(4, 50) + " password=abcdefghijkl1234"), (6, words(5, 50)), (7, words(6, 40) + " " + words(7, 60)), (8, "short text")]
    schema = "doc_id long, text string, lang string, n_chars long, node string, row string, piece int, bucket long, h binary, source string"
    benchmark = spark.createDataFrame([(1, words(7, 60)), (2, None), (3, "")], "item_id long, text string")
    for name, some in (("odd", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        docs = spark.createDataFrame([(i, t, "en", len(t) if t else None, "n", "r", 1, 2, None, "s") for i, t in some], schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        packed = corpus_pipeline.run(spark, folder)
        ends = {(r.doc_id, r.doc_tokens) for r in packed.collect()}
        if not some:
            assert not ends
            continue
        assert sorted(i for i, _ in ends if i is not None) in ([4, 6, 6], [5, 6, 6]) and sum(i is None for i, _ in ends) == 2
