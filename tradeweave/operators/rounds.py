"""Cutting the lineage of loops, where executors can be lost: files in the shared folder, never local ones."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the session names, or in local mode (tests), where it names none, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that the driver and all executors share")
    return (named or "file://" + os.path.join(tempfile.gettempdir(), f"tradeweave-{os.getuid()}")).rstrip("/") + "/tradeweave"


def settle(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder as Parquet: its plan ends there, columns are packed, and later joins know its size."""
    spark = df.sparkSession
    path = f"{shared(spark)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
