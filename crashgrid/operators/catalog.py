"""Listing and sampling of spatial tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GEOMETRY_COLUMNS = ("geometry", "geom", "the_geom")
NESTED = "polygons"
POINT_COLUMNS = ("longitude", "latitude")
_POSITION = r"(\[\s*-?[0-9][^\[\]]*\])"  # innermost array of a GeoJSON text


class SpatialTable(NamedTuple):
    rows: DataFrame
    geometry_column: str = "geometry"
    dimensions: int = 2
    srid: int = 4326
    geometry_type: str = "MULTIPOLYGON"


class _Shape(NamedTuple):
    """How a table holds its geometry: the column's name, and per row type and positions (arrays of numbers)."""

    column: str
    kind: Column
    positions: Column


def _shape(rows: DataFrame) -> _Shape | None:
    for field in rows.schema.fields:
        if field.name.lower() in GEOMETRY_COLUMNS and isinstance(field.dataType, T.StringType):
            text = F.col(f"`{field.name}`")
            found = F.regexp_extract_all(text, F.lit(_POSITION), 1)
            numbers = F.transform(found, lambda t: F.from_json(t, "array<double>"))
            return _Shape(field.name, F.upper(F.get_json_object(text, "$.type")), numbers)
    if NESTED in rows.columns:
        nested = F.col(NESTED)
        return _Shape(NESTED, F.when(nested.isNotNull(), "MULTIPOLYGON"), F.flatten(F.flatten(nested)))
    if set(POINT_COLUMNS) <= set(rows.columns):
        lon, lat = map(F.col, POINT_COLUMNS)
        both = lon.isNotNull() & lat.isNotNull()
        return _Shape("longitude, latitude", F.when(both, "POINT"), F.when(both, F.array(F.array(lon, lat))))
    return None


def describe_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Spatial tables by what is stored in them, found in one pass over each; others are left out.

    ``table_name, geometry_column, geometry_type, dimensions, min_lon, min_lat, max_lon, max_lat,
    located, record_count``. Geometry is a GeoJSON text, nested rings, or a pair of coordinate columns. Several
    types in one table are ``GEOMETRY``; type, dimensions and bounds are null where nothing is located.
    """
    listed = None
    for name, rows in tables.items():
        shape = _shape(rows)
        if shape is None:
            continue
        seen = rows.select(shape.kind.alias("kind"), shape.positions.alias("at"))
        axis = lambda pick, i: pick(F.transform("at", lambda p: p[i]))  # noqa: E731, B023
        row = seen.agg(
            F.when(F.min("kind") == F.max("kind"), F.max("kind")).when(F.max("kind").isNotNull(), "GEOMETRY").alias("geometry_type"),
            F.max(F.array_max(F.transform("at", F.size))).alias("dimensions"),
            F.min(axis(F.array_min, 0)).alias("min_lon"), F.min(axis(F.array_min, 1)).alias("min_lat"),
            F.max(axis(F.array_max, 0)).alias("max_lon"), F.max(axis(F.array_max, 1)).alias("max_lat"),
            F.count("kind").alias("located"), F.count(F.lit(1)).alias("record_count"),
        ).select(F.lit(name).alias("table_name"), F.lit(shape.column).alias("geometry_column"), "*")
        listed = row if listed is None else listed.unionByName(row)
    if listed is None:
        raise ValueError("no spatial table")
    return listed.orderBy("table_name")


def list_tables(tables: dict[str, SpatialTable]) -> DataFrame:
    """Spatial tables with their geometry description and row count, by name."""
    listed = None
    for name, table in tables.items():
        row = table.rows.agg(F.count("*").alias("record_count")).select(
            F.lit(name).alias("table_name"),
            F.lit(table.geometry_column).alias("geometry_column"),
            F.lit(table.dimensions).alias("dimensions"),
            F.lit(table.srid).alias("srid"),
            F.lit(table.geometry_type).alias("geometry_type"),
            "record_count",
        )
        listed = row if listed is None else listed.unionByName(row)
    return listed.orderBy("table_name")


def sample_table(rows: DataFrame, limit: int | None = 10, order_by: str | None = None) -> DataFrame:
    """First rows of a table, all for no limit, with geometry abbreviated for reading."""
    if limit is not None and not 1 <= limit <= 100:
        raise ValueError(f"limit must be between 1 and 100, got {limit}")
    shown = [
        F.concat(F.lit("<geometry: "), F.substring(F.col(c).cast("string"), 1, 50), F.lit("...>")).alias(c)
        if c.lower() in GEOMETRY_COLUMNS
        else F.col(c)
        for c in rows.columns
    ]
    ordered = rows.orderBy(order_by) if order_by else rows
    return (ordered if limit is None else ordered.limit(limit)).select(*shown)
