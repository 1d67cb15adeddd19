"""Lists of designated parties from landed files: CSV without a header, XML with two kinds of records, a wide Latin-1 CSV extract.

Each reader names its columns, so a scan parses no others; each gives name, aliases, program, kind (entity, individual) and the list's
own key. Rows without a name are dropped, as they can't be screened against. A missing field is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_name

#: Columns of the headerless list; classes of excluded parties that are organisations.
SDN_COLUMNS = "ent_num string, name string, type string, program string, c4 string, c5 string, c6 string, c7 string, c8 string, c9 string, c10 string, remarks string"
EXCLUDED_CLASSES = ("Firm", "Special Entity Designation")
UN_RECORD = (
    "DATAID string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, REFERENCE_NUMBER string, UN_LIST_TYPE string, LISTED_ON string, "
    "COMMENTS1 string, {0}_ALIAS array<struct<ALIAS_NAME: string>>, NATIONALITY struct<VALUE: array<string>>"
)


def _bare(c: Column | str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def sdn(spark: SparkSession, path: str) -> DataFrame:
    """ref, name, kind, program, remarks of the sanctions list. Short rows are rows of nulls and go."""
    rows = spark.read.schema(SDN_COLUMNS).csv(path, header=False, escape='"')
    kind = F.when(F.lower(F.trim("type")) == "individual", "individual").otherwise("entity")
    return rows.where(_bare("name").isNotNull() & F.col("program").isNotNull()).select(F.col("ent_num").alias("ref"), F.trim("name").alias("name"), kind.alias("kind"), F.trim("program").alias("program"), _bare("remarks").alias("remarks"))


def un_list(spark: SparkSession, path: str) -> DataFrame:
    """ref, name, aliases, kind, program, listed_on, nationality of the two sections of the consolidated list."""
    out = None
    for tag in ("ENTITY", "INDIVIDUAL"):
        rows = spark.read.schema(UN_RECORD.format(tag)).option("rowTag", tag).xml(path)
        name = F.array_join(F.filter(F.transform(F.array("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME"), F.trim), lambda x: x != ""), " ")
        aliases = F.filter(F.transform(F.coalesce(F.col(f"{tag}_ALIAS")["ALIAS_NAME"], F.array().cast("array<string>")), F.trim), lambda x: x != "")
        every = F.concat(F.filter(F.array(name), lambda x: x != ""), aliases)
        one = rows.withColumn("names", every).where(F.size("names") > 0).select(
            _bare("REFERENCE_NUMBER").alias("ref"), F.col("names")[0].alias("name"), F.slice("names", 2, 10_000).alias("aliases"), F.lit(tag.lower()).alias("kind"),
            _bare("UN_LIST_TYPE").alias("program"), _bare("LISTED_ON").alias("listed_on"), _bare(F.get("NATIONALITY.VALUE", F.lit(0))).alias("nationality"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """name, norm, uei, cage, kind, agency, type, program, active, ends, country, ref of organisations that are excluded now."""
    rows = spark.read.csv(path, header=True, encoding="ISO-8859-1", multiLine=False, escape='"')
    c = lambda n: F.col(f"`{n}`")
    live = c("Classification").isin(*EXCLUDED_CLASSES) & (c("Record Status").isNull() | c("Record Status").isin("", "Active")) & _bare(c("Name")).isNotNull()
    return rows.where(live).select(
        F.trim(c("Name")).alias("name"), normalize_name(c("Name")).alias("norm"), F.upper(_bare(c("Unique Entity ID"))).alias("uei"), F.upper(_bare(c("CAGE"))).alias("cage"),
        F.lit("entity").alias("kind"), c("Excluding Agency").alias("agency"), c("Exclusion Type").alias("type"), c("Exclusion Program").alias("program"), c("Active Date").alias("active"),
        c("Termination Date").alias("ends"), c("Country").alias("country"), c("SAM Number").alias("ref"),
    )


def excluded(entities: DataFrame, listed: DataFrame) -> DataFrame:
    """id, result, how: entities (id, uei, cage, name) on the list by uei, else cage, else normalised name; three equi-joins."""
    found = None
    for rank, (mine, its) in enumerate((("uei", "uei"), ("cage", "cage"), ("norm", "norm"))):
        key = normalize_name(F.col("name")) if mine == "norm" else F.upper(mine)
        one = entities.select("id", key.alias("v")).where("v <> ''").join(listed.select(F.col(its).alias("v")).where("v <> ''").distinct(), "v", "left_semi").select("id", F.lit(rank).alias("rank"), F.lit(mine).alias("how"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("id").agg(F.min(F.struct("rank", "how"))["how"].alias("how"))
    return entities.select("id").distinct().join(best, "id", "left").select("id", F.when(F.col("how").isNotNull(), "hit").otherwise("clear").alias("result"), "how")
