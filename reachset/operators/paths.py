"""Shortest paths over an adjacency (u, v, w): bounded many-source reach and block-wise multi-source search."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from . import kernel
from .lineage import settle

#: Nodes whose ids share id div BLOCK_NODES are searched together.
BLOCK_NODES = 4096
STATE = "blk long, node long, d double, label int, pred long, kind int"


def reach(adj: DataFrame, sources: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(src, node, d) for every source and node at most cutoff away (no bound: all that are connected).

    A round extends only what the last one improved, so it is one join on the adjacency and one aggregate.
    """
    wave = settle(sources.select(F.col("node").alias("src"), "node", F.lit(0).cast(adj.schema["w"].dataType).alias("d")).distinct())
    best = wave
    while True:
        step = wave.join(adj, wave["node"] == adj["u"]).select("src", F.col("v").alias("node"), (F.col("d") + F.col("w")).alias("d"))
        if cutoff is not None:
            step = step.filter(F.col("d") <= cutoff)
        step = step.groupBy("src", "node").agg(F.min("d").alias("d"))
        old = best.withColumnRenamed("d", "old")
        wave = settle(step.join(old, ["src", "node"], "left").filter("old is null or d < old").select("src", "node", "d"))
        if wave.isEmpty():
            return best
        best = settle(best.unionByName(wave).groupBy("src", "node").agg(F.min("d").alias("d")))


def _search(cutoff):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        blk = int(key[0])
        best: dict[int, tuple] = {}
        heap = []
        for node, d, label, pred, kind in zip(left["node"], left["d"], left["label"], left["pred"], left["kind"]):
            if kind == 0 and (node not in best or (d, label) < best[node][:2]):
                best[node] = (d, label, pred)
        for node, d, label, pred, kind in zip(left["node"], left["d"], left["label"], left["pred"], left["kind"]):
            if kind == 1 and (node not in best or (d, label) < best[node][:2]):
                best[node] = (d, label, pred)
                heapq.heappush(heap, (d, label, node))
        out: dict[int, list] = {}
        if heap:
            for u, v, w, bv in zip(right["u"], right["v"], right["w"], right["bv"]):
                out.setdefault(u, []).append((v, w, bv))
        sent: dict[tuple, tuple] = {}
        while heap:
            d, label, u = heapq.heappop(heap)
            if (d, label) != best[u][:2]:
                continue
            for v, w, bv in out.get(u, ()):
                nd = d + w
                if cutoff is not None and nd > cutoff:
                    continue
                if bv != blk:
                    if (bv, v) not in sent or (nd, label) < sent[(bv, v)][:2]:
                        sent[(bv, v)] = (nd, label, u)
                elif v not in best or (nd, label) < best[v][:2]:
                    best[v] = (nd, label, u)
                    heapq.heappush(heap, (nd, label, v))
        rows = [(blk, n, *x, 0) for n, x in best.items()] + [(b, n, *x, 1) for (b, n), x in sent.items()]
        return pd.DataFrame(rows, columns=["blk", "node", "d", "label", "pred", "kind"]).astype({"pred": "Int64"})

    return run


_FOUND = StructType().add("node", LongType()).add("d", DoubleType()).add("label", IntegerType()).add("pred", LongType())


def _in_one_task(adj: DataFrame, first: dict[int, int], cutoff: float | None) -> DataFrame:
    def work(net: kernel.Network):
        at = np.searchsorted(net.ids, list(first))
        d, label = net.arrays.nearest(at, kernel.INF if cutoff is None else cutoff)
        pred = net.arrays.before(d, label, at)
        found = np.flatnonzero(label >= 0)
        place, pred = np.array(list(first.values()), np.int32), pred[found]
        columns = [pa.array(net.ids[found], pa.int64()), pa.array(d[found]), pa.array(place[label[found]]), pa.array(net.ids[pred], pa.int64(), mask=pred < 0)]
        rows = pa.RecordBatch.from_arrays(columns, names=_FOUND.names)
        yield from (rows.slice(i, 100_000) for i in range(0, rows.num_rows, 100_000))

    nodes = adj.sparkSession.createDataFrame([(s,) for s in first], "node long")
    return kernel.on_network(nodes, adj, _FOUND, work)


def multi_source(adj: DataFrame, sources: list[int], cutoff: float | None = None, block_nodes: int | None = None) -> DataFrame:
    """(node, d, label, pred): distance to the nearest source and its place in the list; ties go to the smaller place.

    Sources that occur twice count once; nodes that nothing reaches have no row. Up to ``kernel.MOST_EDGES`` directed edges one
    task searches. Larger networks (or any, if block_nodes is given) take supersteps over blocks of nodes: each searches its
    block to a fixpoint and sends only what leaves it.
    """
    spark = adj.sparkSession
    first: dict[int, int] = {}
    for i, s in enumerate(sources):
        first.setdefault(int(s), i)
    if block_nodes is None and first and kernel.fits(adj):
        return _in_one_task(adj, first, cutoff)
    block_nodes = block_nodes or BLOCK_NODES
    seeds = spark.createDataFrame([(s, i) for s, i in first.items()], "node long, label int")
    blk = lambda c: F.floor(F.col(c) / block_nodes).cast("long")
    a = settle(adj.select(blk("u").alias("blk"), "u", "v", F.col("w").cast("double").alias("w"), blk("v").alias("bv")))
    state = seeds.select(blk("node").alias("blk"), "node", F.lit(0.0).alias("d"), "label", F.lit(None).cast("long").alias("pred"), F.lit(1).alias("kind"))
    while True:
        state = settle(state.groupBy("blk").cogroup(a.groupBy("blk")).applyInPandas(_search(cutoff), STATE))
        if state.filter("kind = 1").isEmpty():
            return state.select("node", "d", "label", "pred")
        # of several messages to a node the best goes on; what is known stays
        state = state.groupBy("blk", "node", "kind").agg(F.min(F.struct("d", "label", "pred")).alias("m")).select("blk", "node", "m.d", "m.label", "m.pred", "kind")
        better = state.filter("kind = 1").join(state.filter("kind = 0").select("node", F.struct("d", "label").alias("old")), "node", "left").filter(F.col("old").isNull() | (F.struct("d", "label") < F.col("old")))
        better = better.select("blk", "node", "d", "label", "pred", "kind")
        state = settle(state.filter("kind = 0").unionByName(better))
        if state.filter("kind = 1").isEmpty():
            return state.select("node", "d", "label", "pred")


def masked(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """Adjacency within cells: both ends of an edge have one label. labels(node, label)."""
    a, b = labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    return adj.join(a, "u").join(b, "v").filter("lu = lv").select("u", "v", "w", F.col("lu").alias("label"))


def settled_order(assign: DataFrame) -> DataFrame:
    """(node, pos): order in which a search settles nodes, by distance and id."""
    return assign.select("node", F.row_number().over(Window.orderBy("d", "node")).alias("pos"))


def farthest(assign: DataFrame) -> DataFrame:
    """One row: the node of largest finite distance, the lowest id on ties."""
    return assign.orderBy(F.desc("d"), "node").limit(1)


def diameter_ends(adj: DataFrame, start: int) -> tuple[int, int, float]:
    """Three sweeps: farthest a0 from start, a from a0, b from a; returns (a, b, d(a, b))."""
    a0 = farthest(multi_source(adj, [start])).first()["node"]
    a = farthest(multi_source(adj, [a0])).first()["node"]
    b = farthest(multi_source(adj, [a])).first()
    return a, b["node"], b["d"]


def nearest_of(distances: DataFrame, centers: DataFrame) -> DataFrame:
    """(node, d, label) from a distance relation (src, node, d) and centers (src, label)."""
    return distances.join(F.broadcast(centers), "src").groupBy("node").agg(F.min(F.struct("d", "label")).alias("m")).select("node", "m.d", "m.label")
