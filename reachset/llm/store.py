"""Tables written to the folder that the whole cluster shares, so that a lost executor costs no recomputation upstream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Shuffle files of a finished write are of no more use and are removed with it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. One is made only where none is set and all runs in one process (tests)."""
    where = spark.conf.get(KEY, None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError(f"{KEY} must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="reachset-")
        spark.conf.set(KEY, where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/reachset/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
