"""What the operators share: the shared folder, written tables, and batch mapping."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or where it is unset in local mode (tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"tradeweave-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return found.rstrip("/")


#: Bytes of an Arrow batch, about: rows may be long, so a number of rows bounds no memory.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that start elsewhere (local mode from another folder); batches that the session sends
    to them hold BATCH_BYTES at most, or one row."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(bound).removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(bound, BATCH_BYTES)
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, ROOT])


class Scratch:
    """A folder of written tables below the shared one. A written table cuts lineage and outlives lost executors."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        Scratch.made.append(self)
        self.path = f"{shared_dir(spark)}/tradeweave/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        if not name and self in Scratch.made:
            Scratch.made.remove(self)


#: Rows of a batch that are Python objects at once.
ROWS_AT_ONCE = 1024


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ROWS_AT_ONCE rows, none of them empty; memory goes back to the system at the end of the task."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield batch.slice(at, ROWS_AT_ONCE)
    finally:
        give_back()


def give_back() -> None:
    """A reused Python worker keeps no freed memory for itself."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of rounds that are done with: it does when the driver has collected their plans."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: StructType) -> DataFrame:
    """fn gets the columns of a batch as Python lists and returns the columns of schema. Rows stay in their tasks."""
    ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, fn: Callable[[list], list[bool]], column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose value in column fn keeps. fn gets the values of a batch."""
    ship(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.filter(pa.array(fn(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, never reach an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot that has more than one in HOT of all rows: there are fewer than HOT such keys, whatever the data.
HOT = 1000


def meet(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """rows joined with keys (a written table: one row for each value of `on`, and n, how many of rows have it), whatever their skew.

    Rows of hot keys stay where they are, as the fewer than HOT hot keys are broadcast; the others meet in a join that Catalyst plans."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(keys.where(F.col("n") > total / HOT))
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(keys.where(F.col("n") <= total / HOT), on))
