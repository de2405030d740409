"""GeoJSON uploads and boundary files."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashgrid.operators.joins import fits_broadcast

DOCUMENT_DDL = (
    "type STRING, features ARRAY<STRUCT<geometry: STRING, properties: STRING>>, "
    "_corrupt_record STRING"
)
# Feature numbers of a document start at this multiple of the document number, which counts files by
# path and documents within a file from 0.
_DOCUMENT_STRIDE = 1_000_000_000


class Upload(NamedTuple):
    features: DataFrame
    geometry_type: str
    feature_count: int


def read_documents(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """GeoJSON documents with geometry and properties kept as JSON text.

    One document per file by default; ``multiline=False`` reads one document per line,
    which Spark can split. Documents are numbered by file path and place in the file, whatever the
    split: rows are counted per file and read task, and only these counts are summed up.
    """
    read = (
        spark.read.schema(DOCUMENT_DDL)
        .option("multiLine", str(multiline).lower())
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .withColumns(
            {
                "_file": F.col("_metadata.file_path"),
                "_block": F.col("_metadata.file_block_start"),
                "_row": F.monotonically_increasing_id(),
            }
        )
    )
    blocks = read.groupBy("_file", "_block").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.max("type").alias("_type")
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "_file", "_block", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    blocks = F.broadcast(blocks) if fits_broadcast(blocks) else blocks
    numbered = read.join(blocks, ["_file", "_block"])
    return numbered.withColumn("document", F.col("_row") + F.col("_shift")).drop("_file", "_block", "_row", "_shift")


def all_features(documents: DataFrame) -> DataFrame:
    """Every feature in document order, also those without geometry."""
    return documents.select("document", F.posexplode("features").alias("pos", "feature")).select(
        (F.col("document") * _DOCUMENT_STRIDE + F.col("pos") + 1).alias("id"),
        F.coalesce("feature.properties", F.lit("{}")).alias("properties"),
        "feature.geometry",
    )


def located_features(documents: DataFrame) -> DataFrame:
    """Features that have a geometry."""
    return all_features(documents).where(
        F.col("geometry").isNotNull() & ~F.col("geometry").isin("", "{}", "null")
    )


def read_upload(spark: SparkSession, path: str, multiline: bool = True) -> Upload:
    """Check an upload and return its usable features.

    Raises ValueError for text that is not GeoJSON, is not a FeatureCollection, holds no
    features, or holds none with a geometry.
    """
    documents = read_documents(spark, path, multiline)
    seen = documents.agg(
        F.count_if(F.col("_corrupt_record").isNotNull()).alias("corrupt"),
        F.count_if(~F.col("type").eqNullSafe("FeatureCollection")).alias("other_type"),
        F.count("*").alias("documents"),
        F.coalesce(F.sum(F.greatest(F.size("features"), F.lit(0))), F.lit(0)).alias("features"),
    ).first()
    if seen["documents"] == 0 or seen["corrupt"]:
        raise ValueError("invalid GeoJSON payload")
    if seen["other_type"]:
        raise ValueError("GeoJSON file must be a FeatureCollection")
    if seen["features"] == 0:
        raise ValueError("GeoJSON FeatureCollection contains no features")
    features = located_features(documents)
    kind = F.upper(F.coalesce(F.get_json_object("geometry", "$.type"), F.lit("Geometry")))
    kept = features.agg(F.count("*").alias("n"), F.min_by(kind, "id").alias("kind")).first()
    if kept["n"] == 0:
        raise ValueError("no valid features with geometry found in GeoJSON file")
    return Upload(features, kept["kind"], kept["n"])


def clean_column(name: str) -> str:
    """Lower-case column name without spaces and dashes."""
    return re.sub("[ -]", "_", name.lower())


def read_boundary_file(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A boundary file as a table: one column per property, geometry as GeoJSON text."""
    whole = str(multiline).lower()
    inferred = spark.read.option("multiLine", whole).json(path).schema
    properties = inferred["features"].dataType.elementType["properties"].dataType
    schema = T.StructType(
        [
            T.StructField(
                "features",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("properties", properties),
                            T.StructField("geometry", T.StringType()),
                        ]
                    )
                ),
            )
        ]
    )
    features = spark.read.schema(schema).option("multiLine", whole).json(path).select(
        F.inline("features")
    )
    flat = features.select("properties.*", "geometry")
    return flat.toDF(*[clean_column(c) for c in flat.columns])


class LoadedBoundary(NamedTuple):
    records_loaded: int
    columns: list[str]
    geometry_type: str


def load_boundary(
    spark: SparkSession, path: str, table_path: str, multiline: bool = True
) -> LoadedBoundary:
    """Replace a boundary table by the content of a file."""
    rows = read_boundary_file(spark, path, multiline)
    rows.write.mode("overwrite").parquet(table_path)
    stored = spark.read.parquet(table_path)
    seen = stored.agg(
        F.count("*").alias("n"),
        F.first(F.get_json_object("geometry", "$.type"), ignorenulls=True).alias("kind"),
    ).first()
    return LoadedBoundary(seen["n"], stored.columns, seen["kind"] or "Unknown")
