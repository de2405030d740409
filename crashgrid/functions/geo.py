"""Planar and geodesic point geometry as column expressions.

Points are two double columns; polygons are arrays of edges ``struct<x1,y1,x2,y2>``.
Small literal polygons unroll into plain arithmetic so that the test stays inside
whole-stage code generation; long ones fold over an edge array.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vertex = Sequence[float]
Edge = tuple[float, float, float, float]

WGS84_A = 6378137.0
WGS84_E2 = 0.0066943799901413165
# Shortest length of one degree on the ellipsoid, for boxes that must not cut corners.
MIN_METERS_PER_DEGREE = 110_574.0
_KM_PER_DEGREE = 111.0

FEW_EDGES = 4
EDGE_DDL = "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
POLYGONS = "array<array<array<array<double>>>>"


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the WGS84 ellipsoid for short ranges (sub-millimetre at five miles).

    Differences are scaled by the two radii of curvature at the middle latitude.
    """
    mid = F.radians((lat1 + lat2) / 2)
    s = F.sin(mid)
    w2 = 1 - WGS84_E2 * s * s
    w = F.sqrt(w2)
    north = WGS84_A * (1 - WGS84_E2) / (w2 * w) * F.radians(lat2 - lat1)
    east = WGS84_A / w * F.cos(mid) * F.radians(lon2 - lon1)
    return F.sqrt(north * north + east * east)


def radius_box(lon: float, lat: float, meters: float) -> tuple[float, float, float, float]:
    """Box (min_lon, min_lat, max_lon, max_lat) that certainly covers a circle."""
    dlat = meters / MIN_METERS_PER_DEGREE
    far_lat = min(abs(lat) + dlat, 90.0)
    shrink = math.cos(math.radians(far_lat))
    dlon = 360.0 if shrink < 1e-6 else meters / (MIN_METERS_PER_DEGREE * shrink)
    return lon - dlon, lat - dlat, lon + dlon, lat + dlat


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Plain range comparisons, so the box reaches the Parquet scan as pushed filters."""
    min_lon, min_lat, max_lon, max_lat = box
    return (lon >= min_lon) & (lon <= max_lon) & (lat >= min_lat) & (lat <= max_lat)


def close_ring(vertices: Sequence[Vertex]) -> list[tuple[float, float]]:
    ring = [(float(v[0]), float(v[1])) for v in vertices]
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def _crosses(lon, lat, x1, y1, x2, y2):
    """Edge crosses the ray that runs east of the point."""
    return ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)


def _touches(lon, lat, x1, y1, x2, y2):
    """Point lies exactly on the edge."""
    on_line = (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) == 0
    return (
        on_line
        & lon.between(F.least(x1, x2), F.greatest(x1, x2))
        & lat.between(F.least(y1, y2), F.greatest(y1, y2))
    )


def ring_edges(ring: Sequence[Vertex]) -> list[Edge]:
    """Edges (x1, y1, x2, y2) of a closed ring."""
    return [(a[0], a[1], b[0], b[1]) for a, b in zip(ring, ring[1:])]


def edges_box(edges: Sequence[Edge]) -> tuple[float, float, float, float]:
    lons, lats = [e[0] for e in edges], [e[1] for e in edges]
    return min(lons), min(lats), max(lons), max(lats)


def in_literal_edges(lon: Column, lat: Column, edges: Sequence[Edge]) -> Column:
    """Strictly inside an area given as numbers; points on the border are outside."""
    crossings, border = F.lit(0), F.lit(False)
    for x1, y1, x2, y2 in edges:
        edge = [F.lit(float(v)) for v in (x1, y1, x2, y2)]
        if y1 != y2:
            crossings = crossings + F.when(_crosses(lon, lat, *edge), 1).otherwise(0)
        border = border | _touches(lon, lat, *edge)
    return (crossings % 2 == 1) & ~border


def in_edges(lon: Column, lat: Column, edges: Column) -> Column:
    """Strictly inside the area bounded by an edge array, holes handled by parity.

    One pass: the fold counts crossings and jumps to a negative number on a border edge.
    """

    def step(acc: Column, e: Column) -> Column:
        y1, y2 = e["y1"], e["y2"]
        # Most edges lie wholly above or below the point and are dismissed at once.
        beside = ((y1 > lat) & (y2 > lat)) | ((y1 < lat) & (y2 < lat))
        parts = (e["x1"], y1, e["x2"], y2)
        return (
            F.when(beside, acc)
            .when((acc < 0) | _touches(lon, lat, *parts), F.lit(-1))
            .when(_safe_crosses(lon, lat, *parts), acc + 1)
            .otherwise(acc)
        )

    crossings = F.aggregate(edges, F.lit(0), step)
    return (crossings > 0) & (crossings % 2 == 1)


def in_few_edges(lon: Column, lat: Column, edges: Column) -> Column:
    """``in_edges`` for arrays that are mostly short, like the edges near one cell.

    Up to ``FEW_EDGES`` edges are plain arithmetic that is compiled; only longer arrays are folded.
    """
    crossings, border = F.lit(0), F.lit(False)
    for i in range(FEW_EDGES):
        e = F.get(edges, F.lit(i))
        parts = (e["x1"], e["y1"], e["x2"], e["y2"])
        crossings = crossings + F.when(_safe_crosses(lon, lat, *parts), 1).otherwise(0)
        border = border | F.coalesce(_touches(lon, lat, *parts), F.lit(False))
    short = (crossings % 2 == 1) & ~border
    return F.when(F.size(edges) <= FEW_EDGES, short).otherwise(in_edges(lon, lat, edges))


def _safe_crosses(lon, lat, x1, y1, x2, y2):
    # A level edge never crosses; nullif keeps ANSI division from raising on it.
    slope = (x2 - x1) * (lat - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
    return ((y1 > lat) != (y2 > lat)) & F.coalesce(lon < slope, F.lit(False))


def edges_of(polygons: Column) -> Column:
    """All edges of a multipolygon (polygons > rings > vertices > [lon, lat])."""

    def edges_of_ring(ring: Column) -> Column:
        starts = F.slice(ring, F.lit(1), F.size(ring) - 1)
        ends = F.slice(ring, F.lit(2), F.size(ring) - 1)
        return F.zip_with(
            starts,
            ends,
            lambda a, b: F.struct(
                a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")
            ),
        )

    return F.flatten(F.transform(F.flatten(polygons), edges_of_ring))


def edge_distance(lon: Column, lat: Column, e: Column) -> Column:
    """Planar distance from a point to one edge, in degrees."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    length2 = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    along = ((lon - e["x1"]) * dx + (lat - e["y1"]) * dy) / length2
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    off_x, off_y = lon - (e["x1"] + t * dx), lat - (e["y1"] + t * dy)
    return F.sqrt(off_x * off_x + off_y * off_y)


def polygon_distance(lon: Column, lat: Column, edges: Column) -> Column:
    """Planar distance in degrees from a point to an area; zero inside."""
    nearest = F.array_min(F.transform(edges, lambda e: edge_distance(lon, lat, e)))
    return F.when(in_edges(lon, lat, edges), F.lit(0.0)).otherwise(nearest)


def make_point(lon: Column, lat: Column) -> Column:
    """Struct of lon and lat; null unless both coordinates are known."""
    both = lon.isNotNull() & lat.isNotNull()
    return F.when(both, F.struct(lon.alias("lon"), lat.alias("lat")))


def point_wkt(lon: str = "longitude", lat: str = "latitude") -> Column:
    """``POINT(lon lat)``, or null when either coordinate is missing."""
    return F.concat(
        F.lit("POINT("), F.col(lon).cast("string"), F.lit(" "), F.col(lat).cast("string"),
        F.lit(")"),
    )


def point_from_wkt(wkt: Column) -> Column:
    """Struct of lon and lat from ``POINT(lon lat)``."""
    parts = F.split(F.regexp_extract(wkt, r"^POINT\s*\(\s*(.*?)\s*\)$", 1), r"\s+")
    return F.struct(
        F.get(parts, F.lit(0)).try_cast("double").alias("lon"),
        F.get(parts, F.lit(1)).try_cast("double").alias("lat"),
    )


def point_geojson(lon: str = "longitude", lat: str = "latitude") -> Column:
    """GeoJSON geometry struct of a point."""
    return F.struct(
        F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")
    )


def polygons_from_geojson(geometry: Column) -> Column:
    """Polygon or MultiPolygon GeoJSON text as nested arrays; other geometry gives null."""
    kind = F.get_json_object(geometry, "$.type")
    coordinates = F.get_json_object(geometry, "$.coordinates")
    multi = F.from_json(coordinates, POLYGONS)
    single = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    return F.when(kind == "MultiPolygon", multi).when(kind == "Polygon", single)


def geojson_from_polygons(polygons: Column) -> Column:
    return F.to_json(
        F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates"))
    )


def circle_ring(lon: Column, lat: Column, radius_km: Column, steps: int = 64) -> Column:
    """Closed ring of [lon, lat] pairs around a centre, at 111 km to the degree."""

    def vertex(i: Column) -> Column:
        angle = i / steps * 2 * math.pi
        dlat = radius_km / _KM_PER_DEGREE * F.sin(angle)
        dlon = radius_km / (_KM_PER_DEGREE * F.cos(F.radians(lat))) * F.cos(angle)
        return F.array(lon + dlon, lat + dlat)

    ring = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), vertex)
    return F.concat(ring, F.slice(ring, 1, 1))


def polygon_feature(ring: Column, properties: Column) -> Column:
    """GeoJSON Feature text of a one-ring polygon."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            geometry.alias("geometry"),
            properties.alias("properties"),
        )
    )
