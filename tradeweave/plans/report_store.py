"""Reports as they are stored: one row a report, its findings, gaps and citations nested, in a folder partitioned by its id.

A report is written over whole by dynamic partition overwrite, so that it never keeps citations of findings it no longer makes, and other
reports stay as they are; the commit is Spark's, so a lost executor leaves the old report or the new one. Lists read the narrow
columns alone. A subject that isn't in the graph has no report. Reports of one kind and subject share an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..model import Graph
from ..operators.rounds import settle
from . import reports as R

KIND = "risk_assessment"
#: Nodes and edges that a report points at, characters of its summary.
CITED, SUMMARY = 400, 1200
REPORT = (
    "id string, kind string, title string, subject_id string, subject_name string, subject_kind string, generated_at string, summary string, finding_count int, top_score int, cited_count int, "
    "coverage struct<suppliers: bigint, scored: bigint, unscored: bigint, thin: bigint, flagged: bigint>, "
    "findings array<struct<rank: int, id: string, name: string, score: int, flagged: boolean, tier: int, path: string, sole_source: boolean, contracts: string, categories: bigint>>, "
    "gaps array<struct<rank: int, id: string, name: string, consumer: string, contract_ref: string, tier: int>>, cites array<string>"
)
LISTED = ("id", "kind", "title", "subject_id", "subject_name", "subject_kind", "generated_at", "summary", "finding_count", "top_score", "cited_count")


def assembled(g: Graph, subject: str, generated_at: str, kind: str = KIND) -> DataFrame:
    """REPORT, of one row: what supply_findings(), coverage() and unscreened_sole_sources() say of a subject, and the nodes that they rest on."""
    about = g.entity.where(F.col("id") == subject).select(F.col("id").alias("subject_id"), F.coalesce("name", "id").alias("subject_name"), F.coalesce("kind", F.lit("organization")).alias("subject_kind"))
    listed = lambda df: df.groupBy().agg(F.array_sort(F.collect_list(F.struct(*df.columns)))).scalar()  # noqa: E731  (FINDINGS and GAPS rows at most)
    near = R.base_of(g, subject)  # walked once for all three
    findings, gaps = R.supply_findings(g, subject, near=near), R.unscreened_sole_sources(g, subject, near=near)
    cover = R.coverage(g, subject, near=near).select(F.struct("*").alias("coverage"))
    one = about.select("*", listed(findings).alias("findings"), listed(gaps).alias("gaps"), cover.scalar().alias("coverage"))
    on_paths = F.flatten(F.transform("findings", lambda f: F.split(f["path"], ">")))
    cites = F.slice(F.array_remove(F.array_distinct(F.concat(on_paths, F.transform("gaps", lambda x: x["id"]))), F.lit(subject)), 1, CITED)
    n = F.size("findings")
    worst = F.get("findings", F.lit(0))
    text = F.concat(
        n.cast("string"), F.when(n == 1, " supplier of ").otherwise(" suppliers of "), F.col("coverage.suppliers").cast("string"), F.lit(" stand out"), F.when(n > 0, F.concat(F.lit(", first "), F.coalesce(worst["name"], worst["id"]), F.coalesce(F.concat(F.lit(" (risk "), worst["score"].cast("string"), F.lit(")")), F.lit("")))).otherwise(""),
        F.lit("; "), F.col("coverage.unscored").cast("string"), F.lit(" not scored, "), F.size("gaps").cast("string"), F.lit(" sole sources among them."),
    )
    return one.select(
        stable_id("rep", F.lit(kind), "subject_id").alias("id"), F.lit(kind).alias("kind"), F.concat(F.lit("Risk assessment: "), "subject_name").alias("title"), "subject_id", "subject_name", "subject_kind", F.lit(generated_at).alias("generated_at"), F.substring(text, 1, SUMMARY).alias("summary"),
        n.alias("finding_count"), worst["score"].alias("top_score"), F.size(cites).alias("cited_count"), "coverage", "findings", "gaps", cites.alias("cites"),
    )


def save(reports: DataFrame, folder: str) -> None:
    """Writes each of reports (REPORT) over the one of its id; of rows with one id the latest counts."""
    last = reports.groupBy("id").agg(F.max_by(F.struct(*[c for c in reports.columns if c != "id"]), "generated_at").alias("r")).select("id", "r.*")
    last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id").parquet(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """All reports; none yet: no rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], REPORT)
    return spark.read.schema(REPORT).parquet(folder)


def listed(reports: DataFrame, limit: int = 100) -> DataFrame:
    """The narrow columns of the latest reports, latest first."""
    return reports.select(*LISTED).orderBy(F.desc("generated_at"), "id").limit(limit)


def citations(reports: DataFrame) -> DataFrame:
    """(src, type, dst): REPORTS_ON and CITES edges of reports, which are put together once for both."""
    reports = settle(reports.select("id", "subject_id", "cites"))
    on = reports.select(F.col("id").alias("src"), F.lit("REPORTS_ON").alias("type"), F.col("subject_id").alias("dst"))
    return on.unionByName(reports.select(F.col("id").alias("src"), F.lit("CITES").alias("type"), F.explode("cites").alias("dst")))


def delete(spark: SparkSession, folder: str, report_id: str) -> bool:
    """Whether there was one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/id={report_id}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
