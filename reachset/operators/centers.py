"""Centres of cells: a cell is the set of nodes that an assignment (node, d, label) gives one label."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import Arrays, best_member

EPSILON = 1e-6


def cell_sizes(assign: DataFrame) -> DataFrame:
    return assign.groupBy("label").agg(F.count("*").alias("size"))


def cell_values(assign: DataFrame) -> DataFrame:
    """Eccentricity and distance sum of each cell's centre."""
    return assign.groupBy("label").agg(F.max("d").alias("ecc"), F.sum("d").alias("total"))


def centers_by_distance(distances: DataFrame, assign: DataFrame, centers: DataFrame, objective: str = "minimax") -> DataFrame:
    """(label, cur, new): best member of each cell by distances on the whole graph.

    The incumbent stays unless a member is better by more than EPSILON; of the best the lowest id is taken.
    """
    a = assign.select(F.col("node").alias("src"), "label")
    pairs = distances.join(a, "src").join(assign.select("node", F.col("label").alias("l2")), "node").filter("label = l2")
    value = F.max("d") if objective == "minimax" else F.sum("d")
    sizes = assign.groupBy("label").agg(F.count("*").alias("size"))
    v = pairs.groupBy("label", "src").agg(value.cast("double").alias("value"), F.count("*").alias("n")).join(sizes, "label").filter("n = size")
    best = v.groupBy("label").agg(F.min(F.struct("value", "src")).alias("m"))
    cur = v.join(F.broadcast(centers.select("label", F.col("src").alias("cur"))), "label").filter("src = cur").select("label", "cur", F.col("value").alias("now"))
    out = cur.join(best, "label")
    return out.select("label", "cur", F.when(F.col("m.value") < F.col("now") - EPSILON, F.col("m.src")).otherwise(F.col("cur")).alias("new"))


def _cell_center(objective: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label, cur = int(pdf["label"].iloc[0]), int(pdf["cur"].iloc[0])
        ids, u = np.unique(pdf["u"].to_numpy(), return_inverse=True)
        net = Arrays(len(ids), u, np.searchsorted(ids, pdf["v"].to_numpy()), pdf["w"].to_numpy())
        new, _ = best_member(net, int(np.searchsorted(ids, cur)), objective, EPSILON)
        return pd.DataFrame([(label, cur, int(ids[new]))], columns=["label", "cur", "new"])

    return run


def centers_in_cells(adj: DataFrame, assign: DataFrame, centers: DataFrame, objective: str = "minimax") -> DataFrame:
    """(label, cur, new) by distances within each cell; cells are searched side by side, one group each."""
    a, b = assign.select(F.col("node").alias("u"), "label"), assign.select(F.col("node").alias("v"), F.col("label").alias("l2"))
    inner = adj.join(a, "u").join(b, "v").filter("label = l2").select("label", "u", "v", F.col("w").cast("double").alias("w"))
    alone = a.select("label", "u", F.col("u").alias("v"), F.lit(0.0).alias("w"))  # a loop changes no distance
    rows = inner.unionByName(alone).join(F.broadcast(centers.select("label", F.col("src").alias("cur"))), "label")
    return rows.groupBy("label").applyInPandas(_cell_center(objective), "label int, cur long, new long")


def sample_members(assign: DataFrame, k: int = 40) -> DataFrame:
    """At most k members of each cell in a fixed pseudorandom order (integer arithmetic on ids)."""
    order = F.pmod(F.col("node") * 7919 + 17, F.lit(10_007))
    return assign.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(order, "node"))).filter(F.col("r") <= k).drop("r")
