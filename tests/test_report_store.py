"""Reports written over whole, listed and deleted."""

from pyspark.sql import functions as F

from tradeweave.model import landed
from tradeweave.plans import report_store as K

from .oracle import SMALL


def test_reports_are_written_over_whole(spark, tmp_path):
    g, folder = landed(spark, SMALL), f"file://{tmp_path}/reports"
    assert K.stored(spark, folder).count() == 0
    one, two = K.assembled(g, "ent_c0", "2025-01-01T00:00:00Z"), K.assembled(g, "ent_c50", "2025-01-02T00:00:00Z")
    K.save(one.unionByName(two), folder)
    first = {r.subject_id: r for r in K.stored(spark, folder).collect()}
    assert set(first) == {"ent_c0", "ent_c50"} and first["ent_c0"].finding_count == len(first["ent_c0"].findings) > 0
    assert [f["rank"] for f in first["ent_c0"].findings] == list(range(1, first["ent_c0"].finding_count + 1)) and first["ent_c0"].cited_count == len(first["ent_c0"].cites) > 0
    assert first["ent_c0"].summary.startswith(f"{first['ent_c0'].finding_count} suppliers of {first['ent_c0'].coverage.suppliers} stand out, first ")

    calm = g.with_(entity=g.entity.withColumns({"risk_score": F.lit(1), "flagged": F.lit(False)}))  # nothing to find any more
    K.save(K.assembled(calm, "ent_c0", "2025-02-01T00:00:00Z").unionByName(K.assembled(g, "ent_c0", "2024-01-01T00:00:00Z")), folder)
    now = {r.subject_id: r for r in K.stored(spark, folder).collect()}
    assert now["ent_c0"].id == first["ent_c0"].id and (now["ent_c0"].finding_count, now["ent_c0"].cites, now["ent_c0"].top_score) == (0, [], None)
    assert now["ent_c50"] == first["ent_c50"]
    assert {(r.type, r.dst) for r in K.citations(K.stored(spark, folder).where("subject_id = 'ent_c0'")).collect()} == {("REPORTS_ON", "ent_c0")}

    assert [r.subject_id for r in K.listed(K.stored(spark, folder)).collect()] == ["ent_c0", "ent_c50"] and K.listed(K.stored(spark, folder), 1).count() == 1
    assert K.delete(spark, folder, now["ent_c0"].id) and not K.delete(spark, folder, now["ent_c0"].id)
    assert [r.subject_id for r in K.stored(spark, folder).collect()] == ["ent_c50"]
    assert K.assembled(g, "nobody", "2025-01-01T00:00:00Z").count() == 0
