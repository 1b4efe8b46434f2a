"""Graph building over nodes(node_id, lon, lat) and edges(edge_id, u, v, length_m)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .lineage import settle


def degree(edges: DataFrame) -> DataFrame:
    """(node_id, degree); a loop counts twice."""
    return edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))


def used_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("node_id")).agg(F.count_distinct("node_id").alias("n"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(u, v, w) in both directions, the shortest of parallel edges, no loops."""
    both = edges.select("u", "v", F.col("length_m").alias("w")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("length_m").alias("w")))
    return both.filter("u <> v").groupBy("u", "v").agg(F.min("w").alias("w"))


def simple_graph(edges: DataFrame) -> DataFrame:
    """One edge per pair of nodes, the shortest (then lowest id); loops are dropped."""
    lo, hi = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    return edges.filter("u <> v").groupBy(lo, hi).agg(F.min(F.struct("length_m", "edge_id")).alias("m")).select("u", "v", "m.edge_id", "m.length_m")


def components(edges: DataFrame) -> DataFrame:
    """(node_id, comp): comp is the smallest node id of the component; isolated nodes are not in it.

    Alternating large-star and small-star rounds: few rounds even for long chains.
    """
    e = settle(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    loops, e = e.filter("a = b").select(F.col("a").alias("node_id")), e.filter("a > b")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        j = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        e = settle(j.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(j.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("b").alias("node_id"), F.col("b").alias("comp")).unionByName(loops.withColumn("comp", F.col("node_id")).join(e, F.col("node_id") == F.col("a"), "left_anti")).distinct()
    return e.select(F.col("a").alias("node_id"), F.col("b").alias("comp")).unionByName(roots)


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the component with most nodes; on ties the one with the smallest id."""
    comp = components(edges)
    top = comp.groupBy("comp").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "comp").limit(1).select("comp")
    keep = comp.join(F.broadcast(top), "comp", "left_semi").select("node_id")  # one row
    return nodes.join(keep, "node_id", "left_semi"), edges.join(keep, edges["u"] == keep["node_id"], "left_semi")


def consolidate(nodes: DataFrame, edges: DataFrame, tol: float) -> tuple[DataFrame, DataFrame]:
    """Merge used nodes within tol metres, transitively, at their centroid; ends are rewritten, loops below 2 tol dropped.

    Neighbours meet by equi-join on grid cells; cells are as wide as tol at the highest latitude, so none is missed.
    """
    used = nodes.join(edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct(), "node_id", "left_semi")
    top = used.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    shrink = max(0.01, __import__("math").cos(__import__("math").radians(top)))
    cell = used.select("node_id", "lon", "lat", F.floor(F.col("lon") * 111_320 * shrink / tol).alias("cx"), F.floor(F.col("lat") * 110_570 / tol).alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = cell.select(F.col("node_id").alias("a"), F.col("lon").alias("x"), F.col("lat").alias("y"), "cx", "cy", around.alias("o")).select("a", "x", "y", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    near = spread.join(cell, ["cx", "cy"]).filter("a < node_id").filter(geo.haversine(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")) <= tol)
    merged = components(near.select(F.col("a").alias("u"), F.col("node_id").alias("v")))
    own = used.join(merged, "node_id", "left").withColumn("new", F.coalesce("comp", "node_id"))
    out = own.groupBy(F.col("new").alias("node_id")).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    to = own.select("node_id", "new")
    at = lambda c: out.select(F.col("node_id").alias(f"n{c}"), F.col("lon").alias(f"x{c}"), F.col("lat").alias(f"y{c}"))
    e = edges.join(to.select(F.col("node_id").alias("u"), F.col("new").alias("nu")), "u").join(to.select(F.col("node_id").alias("v"), F.col("new").alias("nv")), "v")
    # an edge between two nodes is measured anew where an end moved; a loop keeps the length of its way
    e = e.join(at("u"), "nu").join(at("v"), "nv")
    moved = to.groupBy("new").agg((F.count("*") > 1).alias("moved"))
    e = e.join(moved.select(F.col("new").alias("nu"), F.col("moved").alias("mu")), "nu").join(moved.select(F.col("new").alias("nv"), F.col("moved").alias("mv")), "nv")
    length = F.when((F.col("mu") | F.col("mv")) & (F.col("nu") != F.col("nv")), geo.haversine(F.col("xu"), F.col("yu"), F.col("xv"), F.col("yv"))).otherwise(F.col("length_m"))
    e = e.select("edge_id", F.col("nu").alias("u"), F.col("nv").alias("v"), length.cast("double").alias("length_m")).filter((F.col("u") != F.col("v")) | (F.col("length_m") >= 2 * tol))
    return out, e


def simplify(edges: DataFrame) -> DataFrame:
    """Chains through nodes of degree 2 as single edges: (chain, u, v, length_m, n_edges).

    The edges of a chain are a component of the graph whose nodes are edges, joined where they share an inner node. A
    chain's ends are its nodes that are not inner; a pure cycle keeps its smallest node as both ends.
    """
    loops = edges.filter("u = v").select(F.col("u").alias("node_id")).distinct()
    inner = degree(edges).filter("degree = 2").join(loops, "node_id", "left_anti").select("node_id")
    at = edges.select("edge_id", F.explode(F.array("u", "v")).alias("node_id"))
    met = at.join(inner, "node_id").groupBy("node_id").agg(F.min("edge_id").alias("u"), F.max("edge_id").alias("v")).filter("u <> v")
    chain = components(met.select("u", "v"))
    e = edges.join(chain.select(F.col("node_id").alias("edge_id"), F.col("comp").alias("c")), "edge_id", "left").withColumn("chain", F.coalesce("c", "edge_id"))
    sums = e.groupBy("chain").agg(F.sum("length_m").alias("length_m"), F.count("*").alias("n_edges"))
    ends = e.select("chain", F.explode(F.array("u", "v")).alias("node_id")).join(inner, "node_id", "left_anti").groupBy("chain").agg(F.min("node_id").alias("u"), F.max("node_id").alias("v"))
    cycle = e.groupBy("chain").agg(F.min(F.least("u", "v")).alias("lo"))
    out = sums.join(ends, "chain", "left").join(cycle, "chain")
    return out.select("chain", F.coalesce("u", "lo").alias("u"), F.coalesce("v", "lo").alias("v"), "length_m", "n_edges")


def segmentize(edges: DataFrame, most: float) -> DataFrame:
    """Edges cut into ceil(length / most) equal pieces; inner nodes get ids made of (edge_id, piece), negative.

    An edge of 100,000 pieces or more raises an error, as its ids would meet those of the next edge.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("length_m") / most)).cast("long")
    parts = F.when(parts < 100_000, parts).otherwise(F.raise_error(F.lit("an edge has too many pieces")).cast("long"))
    e = edges.withColumn("parts", parts).withColumn("piece", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))))
    inner = lambda i: -(F.col("edge_id") * 100_000 + i)
    return e.select(
        "edge_id", "piece", F.when(F.col("piece") == 1, F.col("u")).otherwise(inner(F.col("piece") - 1)).alias("u"), F.when(F.col("piece") == F.col("parts"), F.col("v")).otherwise(inner(F.col("piece"))).alias("v"), (F.col("length_m") / F.col("parts")).alias("length_m")
    )


def sampled(edges: DataFrame, step: float) -> DataFrame:
    """Edges cut at round(length / step) points (halves to even) that lie evenly, half a step from the ends: (edge_id, u, v, length_m).

    The points have ids made of (edge_id, number), negative; an edge of 100,000 points or more raises an error.
    """
    n = F.bround(F.col("length_m") / step).cast("long")
    n = F.when(n < 100_000, n).otherwise(F.raise_error(F.lit("an edge has too many points")).cast("long"))
    e = edges.withColumn("n", n).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    inner = lambda i: -(F.col("edge_id") * 100_000 + i)
    whole, half = F.col("length_m") / F.col("n"), F.col("length_m") / (2 * F.col("n"))
    length = F.when(F.col("n") == 0, F.col("length_m").cast("double")).when((F.col("piece") == 0) | (F.col("piece") == F.col("n")), half).otherwise(whole)
    return e.select(
        (F.col("edge_id") * 100_000 + F.col("piece")).alias("edge_id"), F.when(F.col("piece") == 0, F.col("u")).otherwise(inner(F.col("piece"))).alias("u"),
        F.when(F.col("piece") == F.col("n"), F.col("v")).otherwise(inner(F.col("piece") + 1)).alias("v"), length.alias("length_m"),
    )


def compact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Used nodes with their rank by id in two levels, so that no window holds all of them: (node_id, new_id)."""
    used = nodes.join(edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct(), "node_id", "left_semi").select("node_id")
    run = F.floor(F.col("node_id") / 4096)
    counts = used.groupBy(run.alias("run")).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("run", "before")
    ranked = used.withColumn("run", run).withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy("node_id")))
    return ranked.join(before, "run").select("node_id", (F.col("before") + F.col("r") - 1).alias("new_id"))


def stats(stages: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """One row per stage: stage, n (used nodes), m, total_km."""
    out = None
    for name, (_, edges) in stages.items():
        n = edges.select(F.explode(F.array("u", "v")).alias("x")).agg(F.count_distinct("x").alias("n"))
        row = edges.agg(F.count("*").alias("m"), (F.sum("length_m") / 1000).alias("total_km")).join(n).select(F.lit(name).alias("stage"), "n", "m", "total_km")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def subdivide(lines: DataFrame) -> DataFrame:
    """Lines (line_id, vertices array) cut at inner vertices that other lines hold or end at: (line_id, part, vertices)."""
    v = lines.select("line_id", F.posexplode("vertices").alias("pos", "vertex"), F.size("vertices").alias("n"))
    cut = v.groupBy("vertex").agg(F.count_distinct("line_id").alias("k")).filter("k > 1").select("vertex", F.lit(True).alias("hit"))
    w = Window.partitionBy("line_id").orderBy("pos")
    v = v.join(cut, "vertex", "left").withColumn("cut", F.coalesce("hit", F.lit(False)) & (F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1))
    v = v.withColumn("part", F.coalesce(F.sum(F.col("cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = v.select("line_id", "part", "pos", "vertex").unionByName(v.filter("cut").select("line_id", (F.col("part") + 1).alias("part"), "pos", "vertex"))
    return both.groupBy("line_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vertex"))), lambda x: x["vertex"]).alias("vertices"))
