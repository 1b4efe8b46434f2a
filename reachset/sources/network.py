"""Sources: OSM JSON, tag filters, connector segments in Parquet, plain lines, query text, caches and manifests."""

from __future__ import annotations

import hashlib
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import topology
from ..operators.lineage import settle

OSM = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"
# fixed values: words that a tag must not contain, by network type, in the order in which the query text names them
TAG_FILTERS: dict[str, dict[str, str]] = {
    "drive": {
        "access": "private",
        "highway": "abandoned|bridleway|bus_guideway|busway|construction|corridor|cycleway|elevator|escalator|footway|ladder|path|pedestrian|planned|platform|proposed|raceway|razed|service|steps|track",
        "motor_vehicle": "no",
        "motorcar": "no",
        "service": "alley|driveway|emergency_access|parking|parking_aisle|private",
    },
    "drive_service": {
        "access": "private",
        "highway": "abandoned|bridleway|bus_guideway|busway|construction|corridor|cycleway|elevator|escalator|footway|ladder|path|pedestrian|planned|platform|proposed|raceway|razed|steps|track",
        "motor_vehicle": "no",
        "motorcar": "no",
        "service": "emergency_access|parking|parking_aisle|private",
    },
    "walk": {
        "access": "private",
        "highway": "abandoned|bus_guideway|busway|construction|cycleway|motor|planned|platform|proposed|raceway|razed",
        "foot": "no",
        "service": "private",
        "sidewalk": "separate",
        "sidewalk:both": "separate",
        "sidewalk:left": "separate",
        "sidewalk:right": "separate",
    },
    "bike": {
        "access": "private",
        "highway": "abandoned|bus_guideway|busway|construction|corridor|elevator|escalator|footway|ladder|motor|planned|platform|proposed|raceway|razed|steps",
        "bicycle": "no",
        "service": "private",
    },
    "all": {"access": "private", "highway": "abandoned|construction|planned|platform|proposed|raceway|razed", "service": "private"},
    "all_public": {"access": "private", "highway": "abandoned|construction|planned|platform|proposed|raceway|razed", "service": "private"},
    "all_private": {"highway": "abandoned|construction|planned|platform|proposed|raceway|razed"},
}
# fixed values: classes of connector segments left out, by network type
CLASS_FILTERS: dict[str, list[str]] = {
    "walk": ["motorway", "motorway_link", "trunk", "trunk_link", "raceway"],
    "drive": ["footway", "path", "pedestrian", "steps", "cycleway", "track", "bridleway", "raceway"],
    "drive_service": ["footway", "path", "pedestrian", "steps", "cycleway", "track", "bridleway", "raceway"],
    "bike": ["footway", "steps", "motorway", "motorway_link", "raceway"],
    "all": ["raceway"],
    "all_public": ["raceway"],
    "all_private": ["raceway"],
}


def read_osm_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of OSM JSON files; .gz files are read as they are."""
    e = spark.read.schema(OSM).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    nodes = e.filter("type = 'node'").select(F.col("id").alias("osm_id"), "lon", "lat")
    return nodes, e.filter("type = 'way'").select(F.col("id").alias("way_id"), "nodes", "tags")


def way_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between consecutive nodes of ways; unknown and equal ends are left out. nodes(osm_id, lon, lat)."""
    pairs = F.expr("transform(sequence(1, size(nodes) - 1), i -> struct(i - 1 AS pos, nodes[i - 1] AS u, nodes[i] AS v))")
    e = ways.filter(F.size("nodes") > 1).select("way_id", F.explode(pairs).alias("p")).select("way_id", "p.*").filter("u <> v")
    a, b = nodes.select(F.col("osm_id").alias("u"), F.struct("lon", "lat").alias("pu")), nodes.select(F.col("osm_id").alias("v"), F.struct("lon", "lat").alias("pv"))
    e = e.join(a, "u").join(b, "v")
    return e.select("way_id", "pos", "u", "v", geo.distance(F.col("pu"), F.col("pv")).alias("length_m"), F.array("pu", "pv").alias("geom"))


def tag_filter(tags: Column, network_type: str) -> Column:
    """Unanchored regex tests on tags; an absent tag passes, but highway must be there."""
    keep = tags["highway"].isNotNull() & ~F.coalesce(tags["area"].rlike("yes"), F.lit(False))
    for key, words in TAG_FILTERS[network_type].items():
        keep = keep & ~F.coalesce(tags[key].rlike(words), F.lit(False))
    return keep


def exact_class_filter(tags: Column, classes: list[str]) -> Column:
    """Filter by equality, as a plain list of classes asks for; an absent class passes."""
    return ~F.coalesce(tags["highway"].isin(classes), F.lit(False))


def overpass_query(network_type: str, bbox: tuple[float, float, float, float] | None = None, rings: list[list[tuple[float, float]]] | None = None, timeout: int = 180) -> str:
    """Text of a query for ways of a type in a bbox (west, south, east, north) or in polygons, one clause per ring."""
    tags = '["highway"]["area"!~"yes"]' + "".join(f'["{k}"!~"{w}"]' for k, w in TAG_FILTERS[network_type].items())
    if rings:
        areas = ['(poly:"' + " ".join(f"{lat:.6f} {lon:.6f}" for lon, lat in r) + '")' for r in rings]
    else:
        w, s, e, n = (repr(float(x)).removesuffix(".0") for x in bbox)
        areas = [f"({s},{w},{n},{e})"]
    return f"[out:json][timeout:{timeout}];(" + "".join(f"way{tags}{a};" for a in areas) + ");out body;>;out skel qt;"


def parse_geocode(text: Column) -> Column:
    """Display name and bbox (south, north, west, east as strings in the source) of the first hit; no hit raises an error."""
    hits = F.from_json(text, "array<struct<display_name:string,boundingbox:array<string>>>")
    hit = F.get(hits, F.lit(0))
    box = F.transform(hit["boundingbox"], lambda x: x.cast("double"))
    found = F.struct(hit["display_name"].alias("display_name"), box[2].alias("west"), box[0].alias("south"), box[3].alias("east"), box[1].alias("north"))
    return F.when(F.size(hits) > 0, found).otherwise(F.raise_error(F.lit("place not found")).cast("struct<display_name:string,west:double,south:double,east:double,north:double>"))


def outer_rings(text: Column, tol: float = 0.0005) -> Column:
    """Outer rings of the first hit's polygon or polygons, simplified; null where it has none (its bbox is the area then)."""
    kind, held = F.get_json_object(text, "$[0].geojson.type"), F.get_json_object(text, "$[0].geojson.coordinates")
    one = F.array(F.from_json(held, "array<array<array<double>>>"))
    many = F.from_json(held, "array<array<array<array<double>>>>")
    polygons = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    return geo.simplify_rings(F.transform(polygons, lambda rings: F.transform(F.get(rings, 0), lambda p: geo.point(F.get(p, 0), F.get(p, 1)))), tol)


def read_segments(spark: SparkSession, path: str, bbox: tuple[float, float, float, float], network_type: str, limit: int | None = None) -> DataFrame:
    return filter_segments(spark.read.parquet(path), bbox, network_type, limit)


def filter_segments(segments: DataFrame, bbox, network_type: str, limit: int | None = None) -> DataFrame:
    """Road segments that overlap a bbox; a null class stays. The bbox tests are on struct fields, so Parquet takes them over."""
    w, s, e, n = bbox
    box = (F.col("bbox.xmin") <= e) & (F.col("bbox.xmax") >= w) & (F.col("bbox.ymin") <= n) & (F.col("bbox.ymax") >= s)
    out = segments.filter((F.col("subtype") == "road") & box & (F.col("class").isNull() | ~F.col("class").isin(CLASS_FILTERS[network_type])))
    out = out.select("id", "class", F.transform("connectors", lambda c: c["connector_id"]).alias("connector_ids"), F.transform("connectors", lambda c: c["at"]).alias("connector_ats"), "wkt")
    return out.limit(limit) if limit else out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of cities; a missing file is an empty manifest."""
    schema = "slug string, name string, displayName string, bbox array<double>, rawBytes long, gzBytes long, elements long"
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_manifest(cities: DataFrame, path: str) -> None:
    """cities (with the columns that ``read_manifest`` gives) as one JSON array in one file; a manifest has a row a city."""
    whole = cities.agg(F.to_json(F.array_sort(F.collect_list(F.struct("slug", *[c for c in cities.columns if c != "slug"])))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new, key, "left_anti").unionByName(new)


def cached_query(spark: SparkSession, folder: str, query: str, make) -> DataFrame:
    """Result of a query text, kept as Parquet under its hash; only a missing one is made, other errors are raised."""
    path = f"{folder}/{hashlib.sha256(query.encode()).hexdigest()}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def segment_edges(segments: DataFrame) -> DataFrame:
    """Edges of connector segments: cut at interior connectors in order of ``at``; equal ends and zero lengths are left out.

    segments(id, connectors array<struct<connector_id, at>>, geom). Pieces follow the connectors, not rounded cuts.
    """
    s = segments.filter((F.size("connectors") > 1) & (F.size("geom") > 1))
    s = s.withColumn("cs", F.array_sort(F.transform("connectors", lambda c: F.struct(c["at"].alias("at"), c["connector_id"].alias("c")))))
    s = s.withColumn("total", geo.length(F.col("geom")))
    parts = F.expr("transform(sequence(1, size(cs) - 1), i -> struct(i - 1 AS piece, cs[i - 1].c AS u, cs[i].c AS v, cs[i - 1].at AS a, cs[i].at AS b))")
    e = s.select("id", "geom", "total", F.explode(parts).alias("p")).select("id", "geom", "total", "p.*").filter("u <> v and b > a")
    return e.select("id", "piece", "u", "v", ((F.col("b") - F.col("a")) * F.col("total")).alias("length_m"), geo.slice_line(F.col("geom"), F.col("a") * F.col("total"), F.col("b") * F.col("total")).alias("geom"))


def _numbered(keys: DataFrame, name: str) -> DataFrame:
    """Distinct rows of keys with a number from 0, column ``name``: counted by hash bucket, then ranked within each."""
    cols = keys.columns
    k = keys.distinct().withColumn("bucket", F.pmod(F.xxhash64(*cols), F.lit(4096)))
    before = k.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # at most 4096 rows
    k = k.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(*cols)))
    return k.join(F.broadcast(before), "bucket").select(*cols, (F.col("before") + F.col("r") - 1).alias(name))


def snap_lines(lines: DataFrame, tol: float = 0.5, most: float = 0.0, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of planar lines: (node_id, lon, lat) and (line_id, part, piece, u, v, length_m).

    lines(line_id, geom) or, multi-part, lines(line_id, parts). Each part is cut into ceil(length / most) equal pieces (0:
    not cut). Ends are joined on a grid of tol, halves rounded to even (0: only equal points), and a node lies at its first
    point by (line, part, place). Null lines, parts of fewer than two points or without length, loops and empty pieces are left
    out; ``largest`` keeps the largest component.
    """
    parts = F.posexplode("parts") if "parts" in lines.columns else F.posexplode(F.array("geom"))
    x = lines.select("line_id", parts.alias("part", "line")).filter(F.size("line") > 1).withColumn("total", geo.length(F.col("line"), geo.planar)).filter("total > 0")
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / most)) if most > 0 else F.lit(1).cast("long")
    x = x.withColumn("n", n)
    x = x.withColumn("ps", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n")), lambda i: geo.point_along(F.col("line"), F.col("total") * i / F.col("n"), geo.planar)))
    grid = lambda c: F.bround(c / tol) if tol > 0 else c + 0.0
    x = settle(x.select("line_id", "part", F.posexplode("ps").alias("at", "p"), F.col("total").alias("total"), "n").withColumn("gx", grid(F.col("p.lon"))).withColumn("gy", grid(F.col("p.lat"))))
    nodes = settle(_numbered(x.select("gx", "gy"), "node_id"))
    first = x.groupBy("gx", "gy").agg(F.min_by("p", F.struct("line_id", "part", "at")).alias("p"))
    step = x.select("line_id", "part", "at", "total", "n", "gx", "gy").join(nodes, ["gx", "gy"]).select("line_id", "part", "at", "total", "n", "node_id")
    begin = step.select("line_id", "part", (F.col("at") + 1).alias("piece"), F.col("node_id").alias("u"))
    e = step.withColumnRenamed("at", "piece").withColumnRenamed("node_id", "v").join(begin, ["line_id", "part", "piece"])
    e = e.select("line_id", "part", "piece", "u", "v", (F.col("total") / F.col("n")).alias("length_m")).filter("u <> v and length_m > 0")
    out = nodes.join(first, ["gx", "gy"]).select("node_id", "p.lon", "p.lat")
    return topology.largest_component(out, settle(e)) if largest else (out, e)


def prepare_lines(lines: DataFrame, most: float = 150.0, simplify: bool = True) -> DataFrame:
    """(edge_id, u, v, length_m) of planar lines(line_id, geom) that meet at shared vertices.

    Lines are cut at shared inner vertices, nodes of degree 2 are smoothed, round(length / most) points (halves to even) are
    laid evenly on each edge, half a step from its ends (0: none), and become nodes; the largest component stays, without
    loops and with the shortest of parallel edges. The points' ids are negative; null lines and lines of one vertex are left out.
    """
    v = lines.filter(F.size("geom") > 1).select("line_id", F.col("geom").alias("vertices"))
    cut = settle(topology.subdivide(v).withColumn("length_m", geo.length(F.col("vertices"), geo.planar)).withColumn("a", F.element_at("vertices", 1)).withColumn("b", F.element_at("vertices", -1)))
    ids = settle(_numbered(cut.select(F.explode(F.array("a", "b")).alias("p")), "node_id"))
    named = settle(_numbered(cut.select("line_id", "part"), "edge_id"))
    e = cut.join(named, ["line_id", "part"]).join(ids.select(F.col("p").alias("a"), F.col("node_id").alias("u")), "a").join(ids.select(F.col("p").alias("b"), F.col("node_id").alias("v")), "b")
    e = settle(e.select("edge_id", "u", "v", "length_m"))
    if simplify:
        e = settle(topology.simplify(e).select(F.col("chain").alias("edge_id"), "u", "v", "length_m"))
    if most > 0:
        e = settle(topology.sampled(e, most))
    _, e = topology.largest_component(e.select(F.explode(F.array("u", "v")).alias("node_id")).distinct(), e)
    return topology.simple_graph(e).select("edge_id", "u", "v", "length_m")


def check_limits(nodes: int, area_km2: float | None = None, large: int = 60_000) -> None:
    """Warns of networks above ``large`` nodes and of areas above 150 km2; an empty network is an error."""
    if nodes == 0:
        raise ValueError("the network is empty")
    if nodes > large:
        warnings.warn(f"{nodes} nodes: a large network", stacklevel=2)
    if area_km2 is not None and area_km2 > 150:
        warnings.warn(f"{area_km2:.0f} km2: a large area", stacklevel=2)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Column", "DataFrame", "SparkSession", "Window")]
