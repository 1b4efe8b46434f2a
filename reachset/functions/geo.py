"""Geometry as Column expressions; points are structs (lon, lat), lines are arrays of them. Distances are metres."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
POINT = "struct<lon:double,lat:double>"
LINE = f"array<{POINT}>"


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def distance(a: Column, b: Column) -> Column:
    return haversine(a["lon"], a["lat"], b["lon"], b["lat"])


def planar(a: Column, b: Column) -> Column:
    return F.hypot(a["lon"] - b["lon"], a["lat"] - b["lat"])


def segments(line: Column, measure=distance) -> Column:
    """Lengths of the segments of a line."""
    pairs = F.arrays_zip(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))).alias("a"), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))).alias("b"))
    return F.transform(pairs, lambda p: measure(p["a"], p["b"]))


def length(line: Column, measure=distance) -> Column:
    return F.aggregate(segments(line, measure), F.lit(0.0), lambda acc, x: acc + x)


def point_along(line: Column, d: Column, measure=distance) -> Column:
    """Point at distance d from the start, clamped to the ends, linear within a segment."""
    total = length(line, measure)
    at = F.least(F.greatest(d, F.lit(0.0)), total)
    steps = F.arrays_zip(F.slice(line, F.lit(1), F.size(line) - 1).alias("a"), F.slice(line, F.lit(2), F.size(line) - 1).alias("b"), segments(line, measure).alias("l"))

    def walk(acc: Column, s: Column) -> Column:
        here = (acc["left"] <= s["l"]) & (s["l"] > 0) & acc["p"].isNull()
        t = acc["left"] / s["l"]
        p = point(s["a"]["lon"] + (s["b"]["lon"] - s["a"]["lon"]) * t, s["a"]["lat"] + (s["b"]["lat"] - s["a"]["lat"]) * t)
        return F.struct((acc["left"] - s["l"]).alias("left"), F.when(here, p).otherwise(acc["p"]).alias("p"))

    start = F.struct(at.alias("left"), F.lit(None).cast(POINT).alias("p"))
    found = F.aggregate(steps, start, walk)["p"]
    return F.when(at >= total, F.element_at(line, -1)).otherwise(F.coalesce(found, F.element_at(line, -1)))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _places(line: Column, measure) -> Column:
    """Array of (point, distance from the start) of the vertices; the lengths of the segments are measured once."""

    def placed(lengths: Column) -> Column:
        return F.transform(line, lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0.0), lambda s, x: s + x).alias("at")))

    return _let(segments(line, measure), placed)


def _between(places: Column, a: Column, b: Column) -> Column:
    """Part of a placed line from distance a to b: interpolated ends and the vertices strictly between."""

    def end(d: Column) -> Column:
        behind = F.filter(places, lambda x: x["at"] >= d)
        k = F.size(places) - F.size(behind)  # vertices before d
        lo, hi = F.get(places, F.greatest(k - 1, F.lit(0))), F.get(places, F.least(k, F.size(places) - 1))
        span = hi["at"] - lo["at"]
        t = F.when(span > 0, F.least(F.greatest((d - lo["at"]) / span, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        return point(lo["p"]["lon"] + (hi["p"]["lon"] - lo["p"]["lon"]) * t, lo["p"]["lat"] + (hi["p"]["lat"] - lo["p"]["lat"]) * t)

    inner = F.transform(F.filter(places, lambda x: (x["at"] > a) & (x["at"] < b)), lambda x: x["p"])
    return F.concat(F.array(end(a)), inner, F.array(end(b)))


def slice_line(line: Column, a: Column, b: Column, measure=distance) -> Column:
    """Part of a line between distances a and b: interpolated ends and the vertices strictly between."""
    return _let(_places(line, measure), lambda places: _between(places, a, b))


def substring(line: Column, a: Column, b: Column, measure=distance) -> Column:
    """Part of a line between two shares (0 to 1) of its length; a line without length stays as it is."""

    def cut(places: Column) -> Column:
        total = F.element_at(places, -1)["at"]
        return F.when(total > 0, _between(places, a * total, b * total)).otherwise(line)

    return _let(_places(line, measure), cut)


def split_equal(line: Column, parts: Column, measure=distance) -> Column:
    """The line cut into pieces of equal length."""

    def cut(places: Column) -> Column:
        total = F.element_at(places, -1)["at"]
        return F.transform(F.sequence(F.lit(1), parts), lambda i: _between(places, total * (i - 1) / parts, total * i / parts))

    return _let(_places(line, measure), cut)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance in degrees of a point from a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n))).otherwise(F.lit(0.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def bbox_area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    return (east - west) * 111.32 * F.cos(F.radians((south + north) / 2)) * (north - south) * 110.57


def wkt_line(text: Column) -> Column:
    """LINESTRING text as a line; other text raises an error."""
    body = F.regexp_extract(text, r"(?i)^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1)
    points = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda p: point(F.element_at(F.split(F.trim(p), r"\s+"), 1), F.element_at(F.split(F.trim(p), r"\s+"), 2)))
    return F.when(body == "", F.raise_error(F.concat(F.lit("not a LINESTRING: "), F.substring(text, 1, 40))).cast(LINE)).otherwise(points)


def to_wkt(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", "), F.lit(")"))


def inside_ring(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a ring of fixed points."""
    out = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            crosses = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            out = out != crosses
    return out


def _douglas_peucker(points, tol: float):
    if len(points) <= 4:
        return points
    keep = {0, len(points) - 1}
    todo = [(0, len(points) - 1)]
    while todo:
        lo, hi = todo.pop()
        (ax, ay), (bx, by) = points[lo], points[hi]
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        far, at = -1.0, -1
        for i in range(lo + 1, hi):
            px, py = points[i]
            t = min(1.0, max(0.0, ((px - ax) * dx + (py - ay) * dy) / n)) if n else 0.0
            d = ((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2) ** 0.5
            if d > far:
                far, at = d, i
        if far > tol:
            keep.add(at)
            todo += [(lo, at), (at, hi)]
    return [points[i] for i in sorted(keep)]


def simplify_ring(line: Column, tol: float = 0.0005) -> Column:
    """Douglas-Peucker simplification; rings of at most four points stay. Recursive, hence a pandas UDF."""

    @F.pandas_udf(LINE)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda ps: [{"lon": x, "lat": y} for x, y in _douglas_peucker([(p["lon"], p["lat"]) for p in ps], tol)])

    return run(line)


def simplify_rings(lines: Column, tol: float = 0.0005) -> Column:
    """``simplify_ring`` of each line of an array; null stays null."""

    @F.pandas_udf(f"array<{LINE}>")
    def run(rings: pd.Series) -> pd.Series:
        return rings.map(lambda rs: None if rs is None else [[{"lon": x, "lat": y} for x, y in _douglas_peucker([(p["lon"], p["lat"]) for p in ps], tol)] for ps in rs])

    return run(lines)
