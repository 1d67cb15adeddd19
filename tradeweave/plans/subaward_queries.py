"""Sub-awards over all orders of programs: the supplier of an order's first line is its prime, those of the other lines its sub-awardees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import subawards as S
from .registry import ORACLES, QUERIES

SUBS = 12


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, page, results): the orders of every program, a page for each order."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = t("orders").where("o_custkey % 50 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("ent_c"), "o_custkey").alias("id"))
    line = t("lineitem").join(orders, "l_orderkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    prime = line.where("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("p"), F.col("s_name").alias("p_name"))
    r = line.where("l_linenumber > 1").join(prime, "l_orderkey")
    value = {
        "Sub-Award ID": F.concat("l_orderkey", F.lit("-"), "l_linenumber"), "Sub-Awardee Name": F.concat(F.lit(" "), F.lower("s_name")), "Sub-Award Amount": F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), "Prime Recipient Name": F.col("p_name"), "Prime Award ID": F.concat(F.lit("ord_"), "l_orderkey"),
        "Sub-Award Date": F.lit(None), "Sub-Award Description": F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("line "), "l_linenumber")), "sub_award_recipient_id": F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("r"), "l_suppkey")),
        "prime_award_recipient_id": F.when(F.col("p") % 4 > 0, F.concat(F.lit("r"), "p")), "prime_award_generated_internal_id": F.lit(None),
    }
    one = F.struct(*[c.cast("string").alias(n) for n, c in value.items()])
    listed = r.groupBy("id", "l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("r")))).alias("x"))
    return listed.select("id", F.col("l_orderkey").cast("int").alias("page"), F.transform("x", lambda x: x["r"]).alias("results"))


def subaward_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    recipients = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("r"), key).alias("rid"), F.col("s_name").alias("name"), F.when(key % 2 == 0, F.concat(F.lit("u"), key)).alias("uei"))
    primes = spark.createDataFrame([], "program string, prime_key string, node string")
    out = S.rolled_up(pages(spark, sf_dir), recipients, primes, SUBS)
    return out.withColumn("sub_award_ids", F.array_join("sub_award_ids", ","))


QUERIES["subaward_edges"] = subaward_edges
_norm = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g'))"
_id = lambda uei, name: f"'ent_' || substr(sha1(case when {uei} is not null then 'uei|' || upper({uei}) else 'name|' || {_norm.format(name)} end), 1, 12)"
ORACLES["subaward_edges"] = f"""
with line as (select l.*, 'ent_c' || o_custkey program, s_name from lineitem l join orders on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey where o_custkey % 50 = 0),
r as (select a.program, a.l_orderkey page, a.l_linenumber n, upper(a.s_name) sub_key, lower(a.s_name) sub, a.l_suppkey s, a.l_extendedprice::decimal(18,2) amount, b.l_suppkey p, b.s_name prime,
    case when b.l_suppkey % 4 > 0 then 'r' || b.l_suppkey else 'name:' || upper(b.s_name) end prime_key from line a join line b on a.l_orderkey = b.l_orderkey and a.l_linenumber > 1 and b.l_linenumber = 1),
subs as (select program, sub_key, row_number() over (partition by program order by sum(amount) desc, sub_key) place, any_value(s) s, any_value(sub) sub from r group by program, sub_key qualify place <= {SUBS}),
named as (select *, case when s % 3 > 0 then upper(sub[1]) || sub[2:] else sub end supplier, {_id("case when s % 3 > 0 and s % 2 = 0 then 'u' || s end", "sub")} supplier_id from subs),
g as (select program, sub_key, prime_key, sum(amount)::double amount, count(*) award_count, arg_max(page, [amount, -page, -n]) page, arg_max(n, [amount, -page, -n]) n, any_value(p) p, any_value(prime) prime,
    array_to_string((array_agg(page || '-' || n order by page, n))[:{S.NAMED}], ',') ids from r group by program, sub_key, prime_key),
m as (select g.*, place, supplier, supplier_id, {_id("case when p % 4 > 0 and p % 2 = 0 then 'u' || p end", "prime")} consumer_id from g join named using (program, sub_key))
select supplier_id, supplier, consumer_id, program, 2 tier, amount, award_count, 'ord_' || page contract_ref, ids sub_award_ids, case when n % 2 = 0 then 'line ' || n else 'reported sub-award' end detail from m where supplier_id <> consumer_id
union all select consumer_id, prime, program, program, 1, null, null, 'ord_' || page, '', 'prime of a reported sub-award' from m qualify row_number() over (partition by program, prime_key order by place) = 1"""
