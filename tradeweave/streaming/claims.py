"""Claims as a stream: files of claims are taken up as they come, decided with all that was said before, and what changes is passed on.

What was said before is keyed state in RocksDB: for each statement (subject, predicate, object, value) its distinct sources and the
claims that wait for more of them; for each screen of a subject by a source the latest one; and every id that was seen. A batch
looks up the keys of its own claims and no others, however much was said before. State, and the place in the source, live in the
checkpoint folder, so a restart goes on where the stream stopped.

What changes is a log of Parquet folders, one for each micro-batch. A batch that runs again writes the same folder over, so lost
executors and restarts neither lose nor double a claim. An id that comes again, under whatever subject, is dropped: the first stays.
A screen that comes later than a newer one of its source is committed, and superseded at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..model import EDGE_TYPES
from ..plans.claims import endpoints
from ..plans.profiles import SOURCES, TRUSTED_CONFIDENCE, decide

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLAIM = "id string, predicate string, subject_id string, object_id string, object_value string, source string, trust string, confidence double, status string, retrieved_at string, detail string"
COLUMNS = [f.split()[0] for f in CLAIM.split(", ")]


def log(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the log, with their batch; none yet: no rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/log")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{CLAIM}, superseded boolean, batch long")
    return spark.read.schema(f"{CLAIM}, superseded boolean, batch long").parquet(f"{folder}/log")


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """Each claim as it stands (after the batches before `before`)."""
    rows = log(spark, folder)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = Window.partitionBy("id").orderBy(F.desc("batch"))
    return rows.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k", "batch")


def take(batch: DataFrame, number: int, folder: str) -> DataFrame:
    """Decides a table of claims with a log that no stream follows, and writes what changed: a backfill, which scans the ids of the whole
    log. Of rows with one id the least stays; ids of the log are dropped. The ids of what the batch changed in the graph: endpoints
    of claims that are newly committed or newly rejected."""
    spark = batch.sparkSession
    keys = ["subject_id", "predicate"]
    one = batch.where("id is not null").groupBy("id").agg(F.min(F.struct(*[c for c in COLUMNS if c != "id"])).alias("r"))
    before = current(spark, folder, number)
    new = one.select("id", "r.*").join(before.select("id"), "id", "left_anti").withColumn("was", F.lit(None).cast("string"))
    touched = before.join(new.select(*keys).distinct(), keys, "left_semi").withColumn("was", F.col("status"))
    every = touched.drop("superseded").unionByName(new)
    decided = decide(every).select("id", "decision")
    after = every.join(decided, "id").withColumn("status", F.when(F.col("was") == "committed", "committed").otherwise(F.col("decision")))
    changed = after.where(F.col("was").isNull() | (F.col("was") != F.col("status"))).select(*COLUMNS)
    changed.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
    out = spark.read.schema(CLAIM).parquet(f"{folder}/log/batch={number}")
    return endpoints(out.where("status <> 'staged'")).select("id").distinct()


class Statements(StatefulProcessor):
    """Of one key (subject_id, predicate, scope): decides the claims that come, and those that wait for them. The scope of a screen is its
    source, of any other claim what it says. Gives a row for each claim whose status changes, and for each screen that is superseded."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sources = handle.getMapState("sources", "source string", "one int")
        self.count = handle.getValueState("count", "n long")
        self.waiting = handle.getMapState("waiting", "id string", "claim string")
        self.latest = handle.getValueState("latest", "claim string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        claims = [{c: None if v is None or v != v else v for c, v in r.items() if c in COLUMNS} for part in rows for r in part.to_dict("records")]
        claims.sort(key=lambda c: c["id"])
        out = self._screened(claims) if key[1].endswith("_screen") else self._decided(claims, key[1])
        if out:
            yield pd.DataFrame(out, columns=[*COLUMNS, "superseded"]).astype(object)

    def _screened(self, claims: list[dict]) -> list[dict]:
        """Screens are observations: each commits. Only the latest of a source counts, by time (one without is the latest), then the least id."""
        last = json.loads(self.latest.get()[0]) if self.latest.exists() else None
        out = []
        for c in claims:
            c["status"], c["superseded"] = "rejected" if c["status"] == "rejected" else "committed", False
            out.append(c)
            if c["status"] == "rejected":
                continue
            if last is None or _later(c, last):
                if last is not None:
                    last["superseded"] = True
                    if all(x is not last for x in out):
                        out.append(last)
                last = c
            else:
                c["superseded"] = True
        if last is not None and not last["superseded"]:
            self.latest.update((json.dumps(last),))
        return out

    def _decided(self, claims: list[dict], predicate: str) -> list[dict]:
        n, out = self.count.get()[0] if self.count.exists() else 0, []
        for c in claims:
            refused = c["status"] == "rejected"
            if not refused and c["source"] is not None and not self.sources.containsKey((c["source"],)):
                self.sources.updateValue((c["source"],), (1,))
                n += 1
            own = predicate in EDGE_TYPES and c["subject_id"] == c["object_id"]
            trusted = c["trust"] == "authoritative" and (c["confidence"] or 0) >= TRUSTED_CONFIDENCE
            c["status"] = "rejected" if refused or own else "committed" if predicate == "mention" or trusted else "staged"
            c["superseded"] = False
            out.append(c)
        if n:
            self.count.update((n,))
        if n >= SOURCES:
            out += [json.loads(claim) for _, (claim,) in self.waiting.iterator()]
            self.waiting.clear()
            for c in out:
                c["status"] = "committed" if c["status"] == "staged" else c["status"]
        else:
            for c in out:
                if c["status"] == "staged":
                    self.waiting.updateValue((c["id"],), (json.dumps(c),))
        return out


def _later(a: dict, b: dict) -> bool:
    x, y = (((c["retrieved_at"] is None), c["retrieved_at"] or "") for c in (a, b))
    return x > y or (x == y and a["id"] < b["id"])


def decisions(claims: DataFrame) -> DataFrame:
    """CLAIM and superseded, of a stream of claims: what changes, as it changes."""
    said = F.concat_ws("\x1f", F.coalesce("object_id", F.lit("")), F.coalesce("object_value", F.lit("")))
    scope = F.when(F.col("predicate").endswith("_screen"), F.coalesce("source", F.lit(""))).otherwise(said)
    keyed = claims.where("id is not null").dropDuplicates(["id"]).withColumns({"subject_id": F.coalesce("subject_id", F.lit("")), "predicate": F.coalesce("predicate", F.lit("")), "scope": scope})
    return keyed.groupBy("subject_id", "predicate", "scope").transformWithStateInPandas(Statements(), outputStructType=f"{CLAIM}, superseded boolean", outputMode="Append", timeMode="None")


def follow(spark: SparkSession, source: str, folder: str, on_change: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Takes up all files of claims (JSON lines) in source that are there and new, in micro-batches; on_change gets the changed ids: endpoints
    of claims that are newly committed, rejected or superseded."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        if on_change:
            out = spark.read.schema(f"{CLAIM}, superseded boolean").parquet(f"{folder}/log/batch={number}")
            on_change(endpoints(out.where("status <> 'staged'")).select("id").distinct(), number)

    claims = spark.readStream.schema(CLAIM).option("maxFilesPerTrigger", 1).json(source)
    return decisions(claims).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def delta(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ids (id): what a client that holds the rest has to fetch anew."""
    a = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return a.unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*a.columns)).distinct()


def said_per_day(claims: DataFrame, late: str = "2 days") -> DataFrame:
    """day, predicate, n of a stream or table of claims: windows close when claims are `late` behind."""
    at = claims.withColumn("at", F.try_to_timestamp("retrieved_at"))
    return at.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "predicate").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "predicate", "n")
