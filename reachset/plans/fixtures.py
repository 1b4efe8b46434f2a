"""Networks derived from the test tables by integer arithmetic, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def net(spark: SparkSession, sf_dir: str, below: int | None = None, drop: int = 15) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a grid over customer ids; some right and up edges are left out."""
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("node_id"))
    if below:
        ids = ids.filter(F.col("node_id") < below)
    n = ids.count()
    w = isqrt(n)
    i = F.floor(F.col("node_id") / w).cast("long")
    nodes = ids.select("node_id", (34.75 + 0.0009 * (F.col("node_id") % w)).alias("lon"), (32.05 + 0.0009 * i).alias("lat"))
    right = ids.filter((F.col("node_id") % w + 1 < w) & (F.col("node_id") + 1 < n) & ((F.col("node_id") * 7919 + 17) % 100 >= drop))
    up = ids.filter((F.col("node_id") + w < n) & ((F.col("node_id") * 104_729 + 31) % 100 >= drop))
    e = right.select((2 * F.col("node_id")).alias("edge_id"), F.col("node_id").alias("u"), (F.col("node_id") + 1).alias("v")).unionByName(
        up.select((2 * F.col("node_id") + 1).alias("edge_id"), F.col("node_id").alias("u"), (F.col("node_id") + w).alias("v"))
    )
    return nodes, e.withColumn("length_m", (60 + (7 * F.col("u") + 13 * F.col("v")) % 80).cast("long"))


def net_sql(below: int | None = None, drop: int = 15) -> str:
    where = f" WHERE c_custkey < {below}" if below else ""
    return f"""ids AS (SELECT c_custkey AS id FROM customer{where}), p AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM ids),
nodes AS (SELECT id AS node_id, 34.75 + 0.0009 * (id % w) AS lon, 32.05 + 0.0009 * (id // w) AS lat FROM ids, p),
edges AS (SELECT *, 60 + (7 * u + 13 * v) % 80 AS length_m FROM (
  SELECT 2 * id AS edge_id, id AS u, id + 1 AS v FROM ids, p WHERE id % w + 1 < w AND id + 1 < n AND (id * 7919 + 17) % 100 >= {drop}
  UNION ALL SELECT 2 * id + 1, id, id + w FROM ids, p WHERE id + w < n AND (id * 104729 + 31) % 100 >= {drop})),
adj AS (SELECT u, v, min(w) AS w FROM (SELECT u, v, length_m AS w FROM edges UNION ALL SELECT v, u, length_m FROM edges) WHERE u <> v GROUP BY u, v)"""


def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, nodes): the parts of each order in line order; without a number they come last, as in SQL."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = [F.col("l_linenumber").isNull().alias("a"), "l_linenumber", F.col("l_partkey").isNull().alias("b"), "l_partkey"]  # what the SQL orders by beyond that leaves equal parts
    return li.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x["l_partkey"]).alias("nodes"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One way per order: parts in line order as nodes, tags from the order's priority and status."""
    w = line_parts(spark, sf_dir)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = F.col("o_orderpriority")
    highway = F.when(p.startswith("1"), "residential").when(p.startswith("2"), "motorway_link").when(p.startswith("3"), "footway").when(p.startswith("4"), "service").otherwise(F.lit(None))
    access = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 7 == 0), "private")
    foot = F.when(F.col("o_orderkey") % 11 == 0, "no").when(F.col("o_orderkey") % 13 == 0, "designated")
    tags = F.map_filter(F.create_map(F.lit("highway"), highway, F.lit("access"), access, F.lit("foot"), foot), lambda k, v: v.isNotNull())
    return w.join(o.select(F.col("o_orderkey").alias("way_id"), tags.alias("tags")), "way_id")


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(p.alias("osm_id"), (34.75 + 0.0009 * (p % 100)).alias("lon"), (32.05 + 0.0009 * F.floor(p / 100)).alias("lat"))


WAYS_SQL = """wn AS (SELECT p_partkey AS osm_id, 34.75 + 0.0009 * (p_partkey % 100) AS lon, 32.05 + 0.0009 * (p_partkey // 100) AS lat FROM part),
wp AS (SELECT l_orderkey AS way_id, l_partkey AS node, row_number() OVER o - 1 AS pos, lead(l_partkey) OVER o AS nxt FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
wt AS (SELECT o_orderkey AS way_id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'residential' WHEN '2' THEN 'motorway_link' WHEN '3' THEN 'footway' WHEN '4' THEN 'service' END AS highway,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 = 0 THEN 'private' END AS access, CASE WHEN o_orderkey % 11 = 0 THEN 'no' WHEN o_orderkey % 13 = 0 THEN 'designated' END AS foot
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""

HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"


def hav(x1, y1, x2, y2) -> str:
    return HAVERSINE.format(x1=x1, y1=y1, x2=x2, y2=y2)


SP_SQL = """sp(id, d, lab) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT), lab FROM seeds UNION
 SELECT id, d, lab FROM (SELECT a.v AS id, sp.d + a.w AS d, sp.lab AS lab, r.d AS rd, r.lab AS rl, row_number() OVER (PARTITION BY a.v ORDER BY sp.d + a.w, sp.lab) AS rn
  FROM sp JOIN adj a ON a.u = sp.id LEFT JOIN recurring.sp r ON r.id = a.v {cut}) WHERE rn = 1 AND (rd IS NULL OR d < rd OR (d = rd AND lab < rl)))"""
ALL_SQL = """ap(src, id, d) USING KEY (src, id) AS (SELECT id, id, CAST(0 AS BIGINT) FROM seeds UNION
 SELECT src, id, d FROM (SELECT ap.src, a.v AS id, min(ap.d + a.w) AS d, any_value(r.d) AS rd FROM ap JOIN adj a ON a.u = ap.id LEFT JOIN recurring.ap r ON r.src = ap.src AND r.id = a.v {cut} GROUP BY ap.src, a.v)
 WHERE rd IS NULL OR d < rd)"""
CC_SQL = """cc(id, c) USING KEY (id) AS (SELECT DISTINCT u, u FROM adj UNION
 SELECT id, c FROM (SELECT a.v AS id, min(cc.c) AS c, any_value(r.c) AS rc FROM cc JOIN adj a ON a.u = cc.id JOIN recurring.cc r ON r.id = a.v GROUP BY a.v) WHERE c < rc)"""
