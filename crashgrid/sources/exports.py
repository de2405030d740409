"""CSV and GeoJSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashgrid.functions import geo
from crashgrid.functions.labels import iso_text


def with_wkt_last(rows: DataFrame) -> DataFrame:
    """All stored columns followed by the point as WKT."""
    return rows.select("*", geo.point_wkt().alias("geometry"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One folder of CSV part files, each with a header; quotes are doubled."""
    printed = [
        iso_text(F.col(f.name), " ").alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType)
        else F.col(f.name)
        for f in rows.schema.fields
    ]
    writer = rows.select(*printed).write.mode("errorifexists")
    writer.option("header", "true").option("escape", '"').csv(path)


def crash_feature() -> Column:
    """GeoJSON Feature text of one crash. Counters are zero-filled, other nulls are kept."""

    def counter(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).alias(name)

    properties = F.struct(
        F.col("crash_record_id"),
        iso_text(F.col("crash_date")).alias("crash_date"),
        counter("injuries_total"),
        counter("injuries_fatal"),
        counter("injuries_incapacitating"),
        F.coalesce(F.col("hit_and_run_i") == "Y", F.lit(False)).alias("hit_and_run_i"),
        F.col("crash_type"),
        F.col("street_name"),
        F.col("prim_contributory_cause").alias("primary_contributory_cause"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        geo.point_geojson().alias("geometry"),
        properties.alias("properties"),
    )
    return F.to_json(feature, {"ignoreNullFields": "false"})


def crash_features(points: DataFrame) -> DataFrame:
    """One GeoJSON feature per located crash."""
    located = points.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    return located.select("crash_record_id", crash_feature().alias("feature"))


def write_features(points: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features."""
    crash_features(points).select(F.col("feature").alias("value")).write.mode(
        "errorifexists"
    ).text(path)
