"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir; a folder is made only where none is set and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="reachset-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/network/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
