"""Spatial filters and joins over longitude / latitude columns.

Joins are equi-joins on grid cells followed by the exact test, so no plan ever pairs all
points with all areas.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrid import schemas as S
from crashgrid.functions import geo
from crashgrid.operators.joins import BROADCAST_ROWS, measured_join, salted_join

CELL_DEGREES = 0.02
SMALLEST_CELL = 0.001
UNROLLED_EDGES = 32
# When counting: what a cell of a boundary costs in tests of a point, and how often cells may be halved.
CELL_WORK, HALVINGS = 4, 8
CELLS_PER_TASK = 1_000_000
# Rounding of floor(x / cell) can move a point on a cell border by an ulp.
_PAD = 1e-9


def within_radius(
    points: DataFrame,
    longitude: float,
    latitude: float,
    radius_feet: float,
    lon: str = "longitude",
    lat: str = "latitude",
) -> DataFrame:
    """Points within a ground distance of a centre, border included."""
    if not 0 < radius_feet <= S.MAX_RADIUS_FEET:
        raise ValueError(f"radius_feet must be in (0, {S.MAX_RADIUS_FEET:g}], got {radius_feet}")
    meters = radius_feet * S.FEET_TO_METERS
    x, y = F.col(lon), F.col(lat)
    exact = geo.distance_m(x, y, F.lit(longitude), F.lit(latitude)) <= meters
    return points.where(geo.in_box(x, y, geo.radius_box(longitude, latitude, meters)) & exact)


def within_ring(
    points: DataFrame,
    vertices: Sequence[Sequence[float]],
    lon: str = "longitude",
    lat: str = "latitude",
) -> DataFrame:
    """Points strictly inside a drawn polygon; an open ring is closed."""
    if len(vertices) < 3:
        raise ValueError("a polygon needs at least three vertices")
    return within_edges(points, geo.ring_edges(geo.close_ring(vertices)), lon, lat)


def within_edges(
    points: DataFrame,
    edges: Sequence[geo.Edge],
    lon: str = "longitude",
    lat: str = "latitude",
) -> DataFrame:
    """Points strictly inside one area whose edges the driver knows.

    The bounding box becomes range filters on the scan. Few edges unroll into plain
    arithmetic; many go through the gridded join, so no point meets all of them.
    """
    x, y = F.col(lon), F.col(lat)
    boxed = points.where(geo.in_box(x, y, geo.edges_box(edges)))
    if len(edges) <= UNROLLED_EDGES:
        return boxed.where(geo.in_literal_edges(x, y, edges))
    spark = points.sparkSession
    area = spark.createDataFrame([(list(edges),)], f"edges ARRAY<STRUCT<{geo.EDGE_DDL}>>")
    return within_boundaries(boxed, area, lon=lon, lat=lat)


def with_edges(boundaries: DataFrame, polygons: str = "polygons") -> DataFrame:
    """Replace nested rings by one edge array per boundary."""
    return boundaries.withColumn("edges", geo.edges_of(F.col(polygons))).drop(polygons)


def _extent(pick, axis: str) -> Column:
    return pick(F.transform("edges", lambda e: e[f"{axis}1"]))


def with_extent(boundaries: DataFrame) -> DataFrame:
    """Append the bounding box of every boundary that has edges."""
    return boundaries.where(F.size("edges") > 0).withColumns(
        {
            "_west": _extent(F.array_min, "x"), "_east": _extent(F.array_max, "x"),
            "_south": _extent(F.array_min, "y"), "_north": _extent(F.array_max, "y"),
        }
    )


class Grid(NamedTuple):
    """Cell size for a boundary set and an upper bound of the edges its cells can hold."""

    cell: float
    edge_bound: float


def fitting_grid(boundaries: DataFrame, cell: float | None = None) -> Grid:
    """Measure a boundary set once: how large its cells should be, and how heavy they get.

    Cells are no larger than the middle-sized boundary, or every small boundary of a
    neighbourhood would be compared with every point there. The size only steers the work;
    any size gives the same result.
    """
    width, height = F.col("_east") - F.col("_west"), F.col("_north") - F.col("_south")
    edges = F.size("edges") + 1
    seen = (
        with_extent(boundaries)
        .agg(
            F.percentile_approx(F.greatest(width, height), 0.5).alias("middle"),
            F.sum(edges).alias("edges"),
            F.sum(edges * (width + height)).alias("by_length"),
            F.sum(edges * width * height).alias("by_area"),
        )
        .first()
    )
    if seen["edges"] is None:
        return Grid(cell or CELL_DEGREES, 0.0)
    if cell is None:
        cell = min(CELL_DEGREES, max(SMALLEST_CELL, seen["middle"]))
    # A box spans at most (width / cell + 2) * (height / cell + 2) cells.
    bound = seen["by_area"] / cell**2 + 2 * seen["by_length"] / cell + 4 * seen["edges"]
    return Grid(cell, bound)


def boundary_cells(boundaries: DataFrame, cell: float = CELL_DEGREES) -> DataFrame:
    """Grid cells that each boundary covers, with only the edges a point there can need.

    A cell that no edge enters is decided once at its centre: outside cells disappear and
    inside cells carry no edges at all, so most points of a large area are matched by the
    equi-join alone. In the other cells the bounding box is compared before any edge.
    """
    kept = [c for c in boundaries.columns if c != "edges"]
    box = ["_west", "_east", "_south", "_north"]

    def cells(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))

    gridded = (
        with_extent(boundaries)
        .withColumn("cell_x", cells("_west", "_east"))
        .withColumn("cell_y", cells("_south", "_north"))
    )
    west, east = F.col("cell_x") * cell - _PAD, (F.col("cell_x") + 1) * cell + _PAD
    south, north = F.col("cell_y") * cell - _PAD, (F.col("cell_y") + 1) * cell + _PAD
    # The crossing test looks east: edges wholly west, north or south cannot matter.
    near = F.filter(
        "edges",
        lambda e: (F.greatest(e["x1"], e["x2"]) >= west)
        & (F.greatest(e["y1"], e["y2"]) >= south)
        & (F.least(e["y1"], e["y2"]) <= north),
    )
    trimmed = gridded.select(
        *kept, *box, "cell_x", "cell_y", near.alias("edges"),
        ((west + east) / 2).alias("_x"), ((south + north) / 2).alias("_y"), east.alias("_cell_east"),
    )
    entered = F.exists("edges", lambda e: F.least(e["x1"], e["x2"]) <= F.col("_cell_east"))
    decided = trimmed.withColumn("_entered", entered).withColumn(
        "_inside", ~F.col("_entered") & geo.in_edges(F.col("_x"), F.col("_y"), F.col("edges"))
    )
    return decided.where("_entered OR _inside").select(
        *kept, *box, "cell_x", "cell_y", "_inside",
        F.when(F.col("_entered"), F.col("edges")).alias("edges"),
    )


def within_boundaries(
    points: DataFrame,
    boundaries: DataFrame,
    lon: str = "longitude",
    lat: str = "latitude",
    cell: float | None = None,
    spread_by: Sequence[str] | None = None,
    broadcast_limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Point-in-polygon join: one row per point and boundary that strictly contains it.

    ``boundaries`` carries its own columns plus ``edges``. The cell table is broadcast only
    if the edges it holds stay under ``broadcast_limit``; otherwise both sides shuffle on
    the cell and crowded cells are split.
    """
    cell, edge_bound = fitting_grid(boundaries, cell)
    cells = boundary_cells(boundaries, cell)
    x, y = F.col(lon), F.col(lat)
    located = points.where(x.isNotNull() & y.isNotNull()).withColumns(
        {"cell_x": F.floor(x / cell), "cell_y": F.floor(y / cell)}
    )
    in_box = (
        (x > F.col("_west")) & (x < F.col("_east")) & (y > F.col("_south")) & (y < F.col("_north"))
    )
    contains = F.col("_inside") | (in_box & geo.in_few_edges(x, y, F.col("edges")))
    joined = measured_join(
        located,
        cells,
        on=["cell_x", "cell_y"],
        spread_by=spread_by or [lon, lat],
        condition=contains,
        weight=F.lit(1) + F.coalesce(F.size("edges"), F.lit(0)),
        at_most=edge_bound,
        limit=broadcast_limit,
    )
    return joined.select(*points.columns, *[c for c in boundaries.columns if c != "edges"])


def counting_grid(points: DataFrame, boundaries: DataFrame, lon: str, lat: str) -> Grid:
    """The fitting grid, halved while fewer points near the edges are worth more cells.

    Cells inside a boundary cost one row each however many points they hold; points are met one by
    one only in cells that an edge enters. The size only steers the work.
    """
    grid = fitting_grid(boundaries)
    width, height = F.col("_east") - F.col("_west"), F.col("_north") - F.col("_south")
    box = (
        with_extent(boundaries)
        .agg(F.count("*").alias("n"), F.sum(width + height).alias("length"), F.sum(width * height).alias("area"))
        .first()
    )
    if not box["n"]:
        return grid
    x, y = F.col(lon), F.col(lat)
    seen = points.agg(
        F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("width"), (F.max(y) - F.min(y)).alias("height")
    ).first()
    density = seen["n"] / max((seen["width"] or 0) * (seen["height"] or 0), grid.cell**2)

    def work(cell: float) -> float:
        cells = box["area"] / cell**2 + box["length"] / cell + box["n"]
        return CELL_WORK * cells + 2 * density * cell * (box["length"] + 2 * cell * box["n"])

    cell = min((grid.cell / 2**n for n in range(HALVINGS + 1)), key=work)
    # The bound holds for one size; four times as many cells for each halving at most.
    return Grid(cell, grid.edge_bound * (grid.cell / cell) ** 2)


def count_within(
    points: DataFrame,
    boundaries: DataFrame,
    name: str,
    lon: str = "longitude",
    lat: str = "latitude",
    cell: float | None = None,
    spread_by: Sequence[str] | None = None,
    broadcast_limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Points strictly inside the boundaries of each name that hold any: ``name, points``.

    The counts of ``within_boundaries`` without its pairs. The points of a cell are counted once, and a
    boundary takes that number from every cell that lies wholly inside it; only points in cells
    that an edge enters are tested.
    """
    cell, edge_bound = counting_grid(points, boundaries, lon, lat) if cell is None else fitting_grid(boundaries, cell)
    x, y = F.col(lon), F.col(lat)
    located = points.where(x.isNotNull() & y.isNotNull()).withColumns(
        {"cell_x": F.floor(x / cell), "cell_y": F.floor(y / cell), "_inside": F.lit(False), "_points": F.lit(1).cast("bigint")}
    )
    counted = located.groupBy("cell_x", "cell_y").agg(F.count("*").alias("_points")).withColumn("_inside", F.lit(True))
    both = located.unionByName(counted, allowMissingColumns=True)
    # A boundary file of few bytes is one task, however many cells its rows cover.
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, int(edge_bound // CELLS_PER_TASK))
    cells = boundary_cells(boundaries.select(name, "edges").repartition(tasks), cell)
    in_box = (
        (x > F.col("_west")) & (x < F.col("_east")) & (y > F.col("_south")) & (y < F.col("_north"))
    )
    contains = F.col("_inside") | (in_box & geo.in_few_edges(x, y, F.col("edges")))
    on = ["cell_x", "cell_y", "_inside"]
    if edge_bound <= broadcast_limit:
        joined = both.join(F.broadcast(cells), on).where(contains)
    else:
        # Packed, cells look small; broadcast, they would leave the points to the few tasks that read them.
        joined = salted_join(both, cells, on, spread_by or [lon, lat], contains, way="merge")
    return joined.groupBy(name).agg(F.sum("_points").alias("points"))


def nearest_place(boundaries: DataFrame, longitude: float, latitude: float, key: str) -> DataFrame:
    """The boundary closest to one point, in planar degrees; zero when the point is inside."""
    distance = geo.polygon_distance(F.lit(longitude), F.lit(latitude), F.col("edges"))
    return (
        boundaries.where(F.size("edges") > 0)
        .withColumn("distance", distance)
        .drop("edges")
        .orderBy("distance", key)
        .limit(1)
    )


def near_sites(
    points: DataFrame,
    sites: DataFrame,
    meters: float,
    lon: str = "longitude",
    lat: str = "latitude",
    site_lon: str = "site_longitude",
    site_lat: str = "site_latitude",
    spread_by: Sequence[str] | None = None,
    broadcast_limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pairs of point and site no further apart than ``meters``, with their distance.

    Cells are one search distance tall, and a site is listed in every cell its search box
    touches, computed from its own latitude, so the result is exact anywhere. Distances are
    computed for short ranges, so the search distance is limited like a report's radius.
    """
    longest = S.MAX_RADIUS_FEET * S.FEET_TO_METERS
    if not 0 < meters <= longest:
        raise ValueError(f"meters must be in (0, {longest:g}], got {meters}")
    tall = meters / geo.MIN_METERS_PER_DEGREE
    far_lat = F.least(F.abs(F.col(site_lat)) + tall, F.lit(89.9))
    wide = F.lit(tall) / F.cos(F.radians(far_lat))

    def cells(center: Column, reach: Column) -> Column:
        return F.sequence(F.floor((center - reach) / tall), F.floor((center + reach) / tall))

    spread_sites = (
        sites.where(F.col(site_lon).isNotNull() & F.col(site_lat).isNotNull())
        .withColumn("cell_x", F.explode(cells(F.col(site_lon), wide)))
        .withColumn("cell_y", F.explode(cells(F.col(site_lat), F.lit(tall))))
    )
    located = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumns(
        {"cell_x": F.floor(F.col(lon) / tall), "cell_y": F.floor(F.col(lat) / tall)}
    )
    distance = geo.distance_m(F.col(lon), F.col(lat), F.col(site_lon), F.col(site_lat))
    joined = measured_join(
        located, spread_sites, on=["cell_x", "cell_y"], spread_by=spread_by or [lon, lat],
        condition=distance <= meters, limit=broadcast_limit,
    )
    return joined.withColumn("distance_meters", distance).drop("cell_x", "cell_y")


def rings_to_boundaries(vertices: DataFrame) -> DataFrame:
    """Edge arrays from a long table (place_id, ring_no, seq, lon, lat) of closed rings."""
    packed = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat")))
    rings = vertices.groupBy("place_id", "ring_no").agg(packed.alias("ring"))
    size = F.size("ring") - 1
    edges = F.zip_with(
        F.slice("ring", F.lit(1), size),
        F.slice("ring", F.lit(2), size),
        lambda a, b: F.struct(
            a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")
        ),
    )
    return (
        rings.select("place_id", edges.alias("ring_edges"))
        .groupBy("place_id")
        .agg(F.flatten(F.collect_list("ring_edges")).alias("edges"))
    )
