"""Places: native boundaries and uploaded layers under one listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrid import schemas as S
from crashgrid.functions import geo
from crashgrid.functions import labels as L

LAYER_PREFIX = "layer:"


def active_layers(layers: DataFrame) -> DataFrame:
    return layers.where("is_active")


def place_types(native: dict[str, DataFrame], layers: DataFrame) -> DataFrame:
    """Kinds of place on offer: native tables that hold rows, then active layers."""
    listed = None
    for place_type, rows in native.items():
        label = S.NATIVE_PLACES[place_type][0]
        counted = rows.agg(F.count("*").alias("feature_count")).select(
            F.lit(place_type).alias("id"), F.lit(label).alias("name"),
            F.lit("native").alias("source"), "feature_count",
        )
        listed = counted if listed is None else listed.unionByName(counted)
    uploaded = active_layers(layers).select(
        F.concat(F.lit(LAYER_PREFIX), F.col("id").cast("string")).alias("id"),
        "name", F.lit("uploaded").alias("source"),
        F.col("feature_count").cast("bigint").alias("feature_count"),
    )
    if listed is None:
        return uploaded
    return listed.where("feature_count > 0").unionByName(uploaded)


def native_items(rows: DataFrame, place_type: str) -> DataFrame:
    """Places of a native type in key order."""
    key = S.NATIVE_PLACES[place_type][1]
    return rows.orderBy(key).select(
        F.col(key).cast("string").alias("id"),
        L.native_name(place_type).alias("name"),
        L.native_display_name(place_type).alias("display_name"),
    )


def layer_items(
    features: DataFrame, label_field: str | None = None, sort_type: str = "alphabetic"
) -> DataFrame:
    """Named features of one layer in its sort order."""
    name = L.feature_name(F.col("properties"), F.col("id"), label_field)
    named = features.select(F.col("id").cast("string").alias("id"), name.alias("name"))
    ordered = named.orderBy(*L.sort_columns("name", sort_type), "id")
    return ordered.withColumn("display_name", F.col("name"))


def _active_layer(store, layer_id: int):
    layer = active_layers(store.layers()).where(F.col("id") == layer_id).first()
    if layer is None:
        raise LookupError(f"layer not found or inactive: {layer_id}")
    return layer


def items_of_active_layer(store, layer_id: int) -> DataFrame:
    """Items of a stored layer; an unknown or inactive layer is an error."""
    layer = _active_layer(store, layer_id)
    return layer_items(store.features(layer_id), layer["label_field"], layer["sort_type"])


def geometry_of_active_layer(store, layer_id: int, feature_id: int) -> DataFrame:
    """Listed name and GeoJSON geometry of one feature of an active layer."""
    layer = _active_layer(store, layer_id)
    name = L.feature_name(F.col("properties"), F.col("id"), layer["label_field"])
    return (
        store.features(layer_id)
        .where(F.col("id") == feature_id)
        .select(
            F.lit(f"{LAYER_PREFIX}{layer_id}").alias("place_type"),
            F.col("id").cast("string").alias("place_id"), name.alias("name"), "geometry",
        )
    )


def _native(rows: DataFrame, place_type: str, place_id: str) -> DataFrame:
    if place_type not in S.NATIVE_PLACES:
        raise ValueError(f"unknown place type: {place_type}")
    key = S.NATIVE_PLACES[place_type][1]
    value = F.lit(place_id).try_cast(rows.schema[key].dataType)
    # the key itself is compared, so that the test reaches the scan; a text that only casts to it is not its id
    return rows.where((F.col(key) == value) & (value.cast("string") == place_id))


def native_geometry(rows: DataFrame, place_type: str, place_id: str) -> DataFrame:
    """Listed name and GeoJSON geometry of one native place."""
    return _native(rows, place_type, place_id).select(
        F.lit(place_type).alias("place_type"), F.lit(place_id).alias("place_id"),
        L.native_name(place_type).alias("name"),
        geo.geojson_from_polygons(F.col("polygons")).alias("geometry"),
    )


def native_place(rows: DataFrame, place_type: str, place_id: str) -> DataFrame:
    """The boundary of one native place for a report, found by its key as text."""
    geometry = [c for c in ("polygons", "edges") if c in rows.columns]
    return _native(rows, place_type, place_id).select(
        F.lit(place_type).alias("place_type"),
        F.lit(place_id).alias("place_id"),
        L.native_report_name(place_type, place_id).alias("name"),
        *geometry,
    )


def layer_place(features: DataFrame, layer_id: int, feature_id: int) -> DataFrame:
    """The boundary of one layer feature. Reports may use inactive layers."""
    this = (F.col("layer_id") == layer_id) & (F.col("id") == feature_id)
    polygons = geo.polygons_from_geojson(F.col("geometry"))
    return features.where(this).select(
        F.lit(f"{LAYER_PREFIX}{layer_id}").alias("place_type"),
        F.lit(str(feature_id)).alias("place_id"),
        L.report_feature_name(F.col("properties"), F.col("id")).alias("name"),
        polygons.alias("polygons"),
        geo.edges_of(polygons).alias("edges"),
    )
