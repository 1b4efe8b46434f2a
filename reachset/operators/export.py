"""Result tables, GeoJSON and view data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_table(edges: DataFrame, assign: DataFrame, radius: float) -> DataFrame:
    """Per edge: length, cluster of the nearer end (ties: u), distances of both ends, covered by the nearer one."""
    a = assign.select(F.col("node").alias("u"), F.col("d").alias("dist_u"), F.col("label").alias("lu"))
    b = assign.select(F.col("node").alias("v"), F.col("d").alias("dist_v"), F.col("label").alias("lv"))
    e = edges.join(a, "u", "left").join(b, "v", "left")
    du, dv = F.coalesce("dist_u", F.lit(float("inf"))), F.coalesce("dist_v", F.lit(float("inf")))
    return e.select("edge_id", "u", "v", F.round("length_m", 1).alias("length_m"), F.coalesce(F.when(du <= dv, F.col("lu")).otherwise(F.col("lv")), F.lit(-1)).alias("cluster"), "dist_u", "dist_v", (F.least(du, dv) <= radius).alias("covered"))


def node_table(nodes: DataFrame, assign: DataFrame, radius: float) -> DataFrame:
    n = nodes.join(assign, "node", "left")
    d = F.coalesce(F.col("d").cast("double"), F.lit(float("inf")))
    return n.select("node", F.coalesce("label", F.lit(-1)).alias("cluster"), d.alias("dist"), (d <= radius).alias("covered"))


def center_table(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(step, idx, node, lon, lat) of the centres of every step."""
    c = steps.select("step", F.posexplode("centers").alias("idx", "node"))
    return c.join(nodes, "node").select("step", "idx", "node", "lon", "lat")


def step_points(steps: DataFrame) -> DataFrame:
    """(step, kind, idx, node, is_farthest): centres of each step, and the farthest node of stuck and add steps."""
    c = steps.select("step", "kind", F.posexplode("centers").alias("idx", "node"), F.lit(False).alias("is_farthest"))
    f = steps.filter(F.col("kind").isin("stuck", "add") & F.col("farthest").isNotNull())
    return c.unionByName(f.select("step", "kind", F.lit(-1).alias("idx"), F.col("farthest").alias("node"), F.lit(True).alias("is_farthest")))


def qgis_layers(steps: DataFrame, centers: DataFrame, nodes: DataFrame) -> DataFrame:
    """The layers centers, nodes and steps in one table: layer, step, idx, node, dist, flag (nodes: covered; steps: farthest).

    steps is a log, centers (idx, node) the result, nodes a node table; idx of a node is its cluster.
    """
    none = lambda kind: F.lit(None).cast(kind)
    c = centers.select(F.lit("centers").alias("layer"), none("int").alias("step"), F.col("idx").cast("int").alias("idx"), "node", none("double").alias("dist"), none("boolean").alias("flag"))
    n = nodes.select(F.lit("nodes").alias("layer"), none("int").alias("step"), F.col("cluster").cast("int").alias("idx"), "node", "dist", F.col("covered").alias("flag"))
    s = step_points(steps).select(F.lit("steps").alias("layer"), F.col("step").cast("int").alias("step"), "idx", "node", none("double").alias("dist"), F.col("is_farthest").alias("flag"))
    return c.unionByName(n).unionByName(s)


def sf_layers(edges: DataFrame, centers: DataFrame, nodes: DataFrame) -> DataFrame:
    """The layers edges, nodes and centers in one table: layer, id, cluster, dist, covered.

    An edge of an edge table has the larger distance of its ends and is covered if the edge table says so.
    """
    inf = F.lit(float("inf"))
    far = F.greatest(F.coalesce(F.col("dist_u").cast("double"), inf), F.coalesce(F.col("dist_v").cast("double"), inf))
    e = edges.select(F.lit("edges").alias("layer"), F.col("edge_id").alias("id"), F.col("cluster").cast("int").alias("cluster"), far.alias("dist"), "covered")
    n = nodes.select(F.lit("nodes").alias("layer"), F.col("node").alias("id"), F.col("cluster").cast("int").alias("cluster"), "dist", "covered")
    c = centers.select(F.lit("centers").alias("layer"), F.col("node").alias("id"), F.col("idx").cast("int").alias("cluster"), F.lit(0.0).alias("dist"), F.lit(True).alias("covered"))
    return e.unionByName(n).unionByName(c)


def geojson(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One feature per edge of an edge table, as JSON text in column value; write it with ``write.text``."""
    a, b = (nodes.select(F.col("node").alias(c), F.array("lon", "lat").alias(f"p{c}")) for c in ("u", "v"))
    e = edges.join(a, "u").join(b, "v")
    geometry = F.struct(F.lit("LineString").alias("type"), F.array("pu", "pv").alias("coordinates"))
    props = F.struct("length_m", "cluster", "dist_u", "dist_v", "covered")
    return e.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("value"))


def steps_json(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """One JSON text per step, with the coordinates of its centres."""
    c = center_table(steps, nodes).groupBy("step").agg(F.array_sort(F.collect_list(F.struct("idx", "node", "lon", "lat"))).alias("points"))
    return steps.join(c, "step", "left").select("step", F.to_json(F.struct("step", "kind", "k", "max_dist", "covered", "points", "moved", "added", "removed")).alias("value"))


def marks(steps: DataFrame) -> DataFrame:
    """(step, mark, node): farthest, added and removed nodes of each step."""
    f = steps.filter("farthest is not null").select("step", F.lit("farthest").alias("mark"), F.col("farthest").alias("node"))
    return f.unionByName(steps.select("step", F.lit("added").alias("mark"), F.explode("added").alias("node"))).unionByName(steps.select("step", F.lit("removed").alias("mark"), F.explode("removed").alias("node")))


def moves(steps: DataFrame) -> DataFrame:
    return steps.select("step", F.explode("moved").alias("m")).select("step", F.col("m.from").alias("src"), F.col("m.to").alias("dst"))


def cluster_color(i: Column) -> Column:
    """HSL by golden angle with three bands of saturation and lightness; -1 is grey."""
    hue, band = F.round((i * 137.508) % 360, 1), i % 3
    return F.when(i < 0, F.lit("#bbbbbb")).otherwise(F.format_string("hsl(%.1f,%d%%,%d%%)", hue, (70 - 10 * band).cast("int"), (42 + 9 * band).cast("int")))


def distance_color(d: Column, radius: float) -> Column:
    """Ramp green, yellow, red over 1.5 radii; an infinite distance is black."""
    t = F.least(d / (1.5 * radius), F.lit(1.0))
    lo, mid, hi = (26, 152, 80), (255, 255, 191), (215, 48, 39)
    low = t < 2 / 3
    s = F.when(low, t / (2 / 3)).otherwise((t - 2 / 3) / (1 / 3))
    part = [F.floor(F.when(low, F.lit(a) + (b - a) * s).otherwise(F.lit(b) + (c - b) * s) + 0.5).cast("int") for a, b, c in zip(lo, mid, hi)]
    return F.when(d == float("inf"), F.lit("#000")).otherwise(F.format_string("rgb(%d,%d,%d)", *part))
