"""Sub-awards rolled up by sub-awardee and prime, on pages made by hand."""

from tradeweave.sources import payloads, subawards


def row(sub, amount, prime=None, rid=None, sub_rid=None, award="A", sub_award="S", about=None):
    return (sub_award, sub, amount, prime, award, None, about, sub_rid, rid, None)


def rolled(spark, pages, recipients=(), primes=(), **k):
    return {
        (r.supplier, r.consumer_id if r.tier == 1 else names.get(r.consumer_id, r.consumer_id)): r
        for names in [{}]
        for r in subawards.rolled_up(
            spark.createDataFrame(pages, subawards.PAGES), spark.createDataFrame(list(recipients), "rid string, name string, uei string"), spark.createDataFrame(list(primes), "program string, prime_key string, node string"), **k
        ).collect()
    }


def test_two_levels_of_grouping(spark):
    pages = [
        ("p", 2, [row("acme  ", "5", "Prime One", "r1", award="A3", sub_award="S9"), row("Bolt", "1e2", "Prime Two")]),
        ("p", 1, [row("Acme", "10.50", "Prime One", "r1", award="A1", sub_award="S1", about="small"), row("ACME", "20", "Prime One", "r1", award="A2", sub_award="S2", about="large"), row("Acme", "oops", "Prime Two", award="A9", sub_award=None), row("", "9", "Prime One", "r1"), row(None, "9", "Prime One"), row("Cog", "1", None)]),
    ]
    got = rolled(spark, pages, [("r1", "Prime One Inc", "u1")], [("p", "r1", "ent_known")])
    acme = got["Acme", "ent_known"]
    assert (acme.tier, acme.amount, acme.award_count, acme.contract_ref, acme.sub_award_ids, acme.detail) == (2, 35.5, 3, "A2", ["S1", "S2", "S9"], "large")
    two = got["Prime Two", "p"]
    assert (two.tier, two.amount, two.contract_ref, two.detail) == (1, None, "A", "prime of a reported sub-award")  # of the sub-awardee with the largest total
    below = {(r.supplier, r.amount, r.award_count) for r in got.values() if r.tier == 2 and r.consumer_id == two.supplier_id}
    assert below == {("Acme", 0.0, 1), ("Bolt", 100.0, 1)} and got["Acme", two.supplier_id].sub_award_ids == []
    assert not any(r.supplier == "Cog" for r in got.values()) and len(got) == 4


def test_identities_and_nobody_supplies_themselves(spark):
    pages = [("p", 1, [row("Acme", "3", "Acme", "r1", sub_rid="r1"), row("Old name", "2", "Prime", sub_rid="r2"), row("Zed", "1", "Prime")])]
    got = rolled(spark, pages, [("r1", "Acme Inc", "u1"), ("r2", "New Name", None)], max_subs=2)
    assert {(r.supplier, r.tier) for r in got.values()} == {("Acme Inc", 1), ("New Name", 2), ("Prime", 1)}


def test_ten_awards_are_named_and_empty_pages_give_nothing(spark):
    many = [("p", 1, [row("Acme", "1", "Prime", sub_award=f"S{k:02}") for k in range(15)])]
    got = rolled(spark, many)
    edge = next(r for r in got.values() if r.tier == 2)
    assert edge.sub_award_ids == [f"S{k:02}" for k in range(10)] and edge.award_count == 15
    assert rolled(spark, [("p", 1, [])]) == {} and rolled(spark, []) == {}


def test_facts_beside_supplies(spark):
    rows = [("p", f"A{k}", f"Firm {k}", f"u{k}" if k else None, float(k), "5821" if k % 2 else None, None, "3", None) for k in range(7)]
    supplied = payloads.usaspending(spark.createDataFrame(rows, payloads.AWARDS))
    facts = subawards.award_facts(supplied).collect()
    assert {r.object_id for r in facts if r.predicate == "PROVIDES"} == {"cat_avionics"} and sum(r.predicate == "PROVIDES" for r in facts) == 3
    assert sorted(r.object_value for r in facts if r.predicate == "mention") == ["A2", "A3", "A4", "A5", "A6"] and {r.subject_id for r in facts if r.predicate == "mention"} == {"p"}
    with_uei = supplied.withColumn("uei", payloads.F.lit("abc"))
    known = supplied.select("id", payloads.F.when(payloads.F.col("name") == "Firm 1", "X").alias("uei"))
    found = [r for r in subawards.award_facts(with_uei, known).collect() if r.predicate == "attr:uei"]
    assert len(found) == 6 and {r.object_value for r in found} == {"ABC"}
