"""Claims that come in files, decided with what was said before."""

import json

from pyspark.sql import functions as F

from tradeweave.streaming import claims as S


def claim(i, predicate, value, source, trust="open", status="staged", subject="e1", obj=None, at="2024-01-01T00:00:00"):
    return {"id": i, "predicate": predicate, "subject_id": subject, "object_id": obj, "object_value": value, "source": source, "trust": trust, "confidence": 0.9, "status": status, "retrieved_at": at}


def test_corroboration_across_batches(spark, tmp_path):
    source, folder, seen = tmp_path / "in", f"file://{tmp_path}/state", {}
    source.mkdir()

    def write(name, rows):
        (source / name).write_text("\n".join(map(json.dumps, rows)))
        query = S.follow(spark, f"file://{source}", folder, lambda ids, k: seen.__setitem__(k, {r.id for r in ids.collect()}))
        query.awaitTermination()
        return {r.id: r.status for r in S.current(spark, folder).collect()}

    assert write("1.json", [claim("a", "SUPPLIES", "x", "s1", obj="e2"), claim("b", "OWNS", None, "s1", obj="e1"), claim("c", "sanctions_screen", "hit", "s1", subject="e9")]) == {"a": "staged", "b": "rejected", "c": "committed"}
    assert seen[0] == {"b", "e1", "c", "e9"}
    assert write("2.json", [claim("d", "SUPPLIES", "x", "s1", obj="e2")])["d"] == "staged"  # the same source says it again
    got = write("3.json", [claim("e", "SUPPLIES", "x", "s2", obj="e2"), claim("a", "SUPPLIES", "x", "s1", obj="e2")])
    assert got["a"] == got["d"] == got["e"] == "committed" and seen[2] == {"a", "d", "e", "e1", "e2"}
    assert S.log(spark, folder).where("id = 'c'").count() == 1  # what doesn't change isn't written again


def run(spark, tmp_path, files):
    """The claims as they stand after each file."""
    source, folder, out = tmp_path / "in", f"file://{tmp_path}/state", []
    source.mkdir(exist_ok=True)
    for rows in files:
        (source / f"{len(list(source.iterdir()))}.json").write_text("\n".join(map(json.dumps, rows)))
        query = S.follow(spark, f"file://{source}", folder)  # each call is a restart
        query.awaitTermination()
        out.append({r.id: r for r in S.current(spark, folder).collect()})
    return out, query


def test_an_id_is_taken_once(spark, tmp_path):
    first = [claim("a", "OWNS", None, "s1", trust="authoritative", obj="e2")]
    again = [claim("a", "OWNS", None, "s2", subject="e7", obj="e8"), claim(None, "OWNS", None, "s2"), claim("b", "OWNS", None, "s1", subject="e5", obj="e6"), claim("b", "OWNS", None, "s1", subject="e5", obj="e6")]
    got, _ = run(spark, tmp_path, [first, again])
    assert {i: (r.subject_id, r.status) for i, r in got[1].items()} == {"a": ("e1", "committed"), "b": ("e5", "staged")}


def test_screens_are_superseded_by_later_ones_of_their_source(spark, tmp_path):
    s = lambda i, value, at, source="s1", **k: claim(i, "sanctions_screen", value, source, at=at, **k)
    files = [[s("a", "hit", "2024-01-05"), s("o", "clear", "2024-01-01", "s2")], [s("b", "clear", "2024-01-09")], [s("late", "hit", "2024-01-07"), s("no", "hit", "2025-01-01", status="rejected")], [s("c", "hit", "2024-02-01"), s("d", "clear", "2024-02-01"), s("e", "hit", "2024-01-30")]]
    got, _ = run(spark, tmp_path, files)
    valid = [{i for i, r in g.items() if r.status == "committed" and not r.superseded} for g in got]
    assert valid == [{"a", "o"}, {"b", "o"}, {"b", "o"}, {"c", "o"}] and got[2]["no"].status == "rejected"


def test_the_stream_decides_as_the_whole_table_does(spark, tmp_path):
    import random

    from tradeweave.plans.profiles import decide

    r = random.Random(4)
    rows = [claim(f"c{k}", r.choice(["SUPPLIES", "OWNS", "mention", "attr:lei"]), r.choice([None, "v"]), r.choice(["s1", "s2", "s3", None]), r.choice(["open", "open", "open", "authoritative"]), r.choice(["staged"] * 8 + ["rejected"]), f"e{r.randrange(6)}", r.choice([None, "e1", "e2"])) for k in range(160)]
    got, query = run(spark, tmp_path, [rows[:120], rows[120:159], rows[159:]])
    table = spark.createDataFrame([(*c.values(), None) for c in rows], S.CLAIM)
    want = {x.id: x.decision for x in decide(table).collect()}
    assert {i: x.status for i, x in got[-1].items()} == want
    assert max(sum(o["numRowsUpdated"] for o in p["stateOperators"]) for p in query.recentProgress) < 20  # of one claim, however long the log


def test_a_batch_can_run_again(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    batch = spark.createDataFrame([tuple(claim("a", "OWNS", None, "s1", obj="e2").values()) + (None,)], "id string, predicate string, subject_id string, object_id string, object_value string, source string, trust string, confidence double, status string, retrieved_at string, detail string")
    S.take(batch, 0, folder)
    S.take(batch, 0, folder)
    assert S.current(spark, folder).count() == 1
    other = batch.withColumn("subject_id", F.lit("e5")).unionByName(batch.withColumns({"id": F.lit("b"), "trust": F.lit("authoritative")}))
    S.take(other, 1, folder)
    assert {r.id: (r.subject_id, r.status) for r in S.current(spark, folder).collect()} == {"a": ("e1", "staged"), "b": ("e1", "committed")}


def test_delta_and_days(spark):
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "c", "d")], "id string, src string, dst string")
    ids = spark.createDataFrame([("b",)], "id string")
    assert sorted(r.id for r in S.delta(edges, ids).collect()) == ["1", "2"]
    rows = spark.createDataFrame([("p", "2024-01-01T01:00:00"), ("p", "2024-01-01T23:00:00"), ("p", "2024-01-02T00:00:00"), ("p", None)], "predicate string, retrieved_at string")
    assert {(str(r.day), r.n) for r in S.said_per_day(rows).where(F.col("day").isNotNull()).collect()} == {("2024-01-01", 2), ("2024-01-02", 1)}
