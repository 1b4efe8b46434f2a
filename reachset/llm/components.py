"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, release


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of the component.

    Each round is written to the shared folder; only two numbers a round reach the driver. Null ends and loops are left out.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a > b").distinct()
    e = materialize(e, "cc-0")
    mark = None
    for i in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).distinct()
        last, e = e, materialize(small, f"cc-{i + 1}")
        release(last)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            roots = e.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        mark = now
    raise RuntimeError("components did not settle")
