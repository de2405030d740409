"""Uploaded map layers: storage, field profile, sort-type detection."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashgrid import schemas as S
from crashgrid.functions import labels as L
from crashgrid.functions.predicates import ntz
from crashgrid.sources.geojson import read_upload
from crashgrid.sources.tables import ONE_PART, ConcurrentCommit, PartedTable

Made = TypeVar("Made")
NUMBERS = "layer_ids"
ATTEMPTS = 20

SAMPLES_PER_FIELD = 3
NUMERIC_SHARE = 0.8
_AUDIT = ", created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"


def first_features(features: DataFrame, n: int | None = None) -> DataFrame:
    """The first features of a layer, all for None."""
    return features if n is None else features.orderBy("id").limit(n)


def detect_sort_type(
    features: DataFrame, label_field: str | None, sample: int | None = None
) -> DataFrame:
    """One row: 'numeric' when at least 80 % of the labels hold a digit.

    ``sample`` looks at so many first features only.
    """
    if not label_field:
        return features.sparkSession.range(1).select(F.lit("alphabetic").alias("sort_type"))
    properties = F.col("properties")
    text = L.json_text(properties, label_field)
    bare = text.isin("true", "false") | text.startswith("{") | text.startswith("[")
    truth = text.isin("true", "false")
    quoted = L.is_quoted(properties, label_field)
    numeric = F.when(bare & ~quoted, truth).otherwise(text.rlike(r"\d"))
    share = F.avg(numeric.cast("int"))
    labelled = first_features(features, sample).where(text.isNotNull())
    return labelled.agg(
        F.when(share >= NUMERIC_SHARE, "numeric").otherwise("alphabetic").alias("sort_type")
    )


def profile_fields(features: DataFrame, sample: int | None = None) -> DataFrame:
    """Property names of a layer with up to three sample values each.

    ``suggested`` marks the name that makes the best label. ``sample`` looks at so many first
    features only.
    """
    keyed = first_features(features, sample).select(
        "id", "properties", F.posexplode(F.json_object_keys("properties")).alias("pos", "name")
    )
    values = keyed.select(
        "name",
        F.struct("id", "pos").alias("seen_at"),
        L.json_text(F.col("properties"), F.col("name")).alias("value"),
    )
    distinct = values.groupBy("name", "value").agg(F.min("seen_at").alias("seen_at"))
    # The bound on the rank is applied before the shuffle: a task gets three values of a name at most from each other.
    per_name = Window.partitionBy("name").orderBy("seen_at")
    ranked = distinct.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(per_name))
    shown = ranked.where(F.col("rank") <= SAMPLES_PER_FIELD).groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("samples")
    )
    names = distinct.groupBy("name").agg(F.min("seen_at").alias("seen_at"))
    fields = names.join(shown, "name", "left").withColumn(
        "samples", F.coalesce("samples", F.array().cast("array<struct<rank:int,value:string>>"))
    )
    order = F.struct(L.label_rank(F.col("name")).alias("rank"), F.col("seen_at"))
    best = fields.where(L.label_rank(F.col("name")).isNotNull()).agg(F.min_by("name", order))
    return (
        fields.withColumn("_best", best.scalar())
        .select(
            "name",
            F.transform("samples", lambda s: s["value"]).alias("sample_values"),
            F.coalesce(F.col("name") == F.col("_best"), F.lit(False)).alias("suggested"),
            "seen_at",
        )
        .orderBy("seen_at")
        .drop("seen_at")
    )


def field_names(features: DataFrame, sample: int | None = None) -> DataFrame:
    """Sorted property names of a layer, or of so many first features."""
    return (
        first_features(features, sample)
        .select(F.explode(F.json_object_keys("properties")).alias("name"))
        .distinct()
        .orderBy("name")
    )


def _tried(edit: Callable[[], Made]) -> Made:
    """Do an edit again, from what is stored by then, as often as another writer was faster."""
    for attempt in range(ATTEMPTS):
        try:
            return edit()
        except ConcurrentCommit:
            if attempt == ATTEMPTS - 1:
                raise
    raise AssertionError


class LayerStore:
    """Layer registry and features, features partitioned by layer.

    Every edit of the registry is based on one state of it and published only if that is still the
    latest, else done again from the new one: no writer undoes another's edit. Layer numbers are
    handed out by the same commits and never twice, also after a layer is gone.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self._registry = PartedTable(
            spark, f"{path}/spatial_layers", T.StructType.fromDDL(S.LAYER_DDL + _AUDIT),
            F.lit(ONE_PART), sort=("id",),
        )
        self._features = PartedTable(
            spark, f"{path}/spatial_layer_features",
            T.StructType.fromDDL(S.LAYER_FEATURE_DDL), F.col("layer_id").cast("string"),
            sort=("id",),
        )

    def layers(self) -> DataFrame:
        return self._registry.read()

    def features(self, layer_id: int | None = None) -> DataFrame:
        """Features of one layer (only its directory is listed) or of all layers."""
        return self._features.read(None if layer_id is None else [str(layer_id)])

    def _layer(self, layer_id: int):
        return self.layers().where(F.col("id") == layer_id).first()

    def _edit(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the registry by what ``change`` makes of its latest rows."""

        def once() -> None:
            state = self._registry.state()
            rows = self._registry.read(revision=state["revision"])
            self._registry.rewrite(change(rows), self._registry.directories([ONE_PART], state), based_on=state)

        _tried(once)

    def _new_number(self) -> int:
        def once() -> int:
            state = self._registry.state()
            last = state.get("cursors", {}).get(NUMBERS, {}).get("last", 0)
            stored = self._registry.read(revision=state["revision"]).agg(F.max("id").alias("id")).first()["id"]
            number = max(last, stored or 0) + 1
            self._registry.remember(NUMBERS, {"last": number}, state)
            return number

        return _tried(once)

    def _store_features(self, layer_id: int, features: DataFrame) -> None:
        rows = features.withColumn("layer_id", F.lit(layer_id))
        _tried(lambda: self._features.replace(rows, [str(layer_id)]))

    def _free_slug(self, layers: DataFrame, name: str, layer_id: int) -> Column:
        """Slug of a name; the first free one of ``slug, slug-2, slug-3`` and so on where others have it."""
        base = self.spark.range(1).select(L.slug(F.lit(name)).alias("slug")).first()["slug"]
        like = (F.col("slug") == base) | F.col("slug").startswith(f"{base}-")
        taken = {r["slug"] for r in layers.where(like & (F.col("id") != layer_id)).select("slug").collect()}
        number = 1
        while (slug := base if number == 1 else f"{base}-{number}") in taken:
            number += 1
        return F.lit(slug)

    def create(
        self,
        name: str,
        path: str,
        now: datetime,
        description: str | None = None,
        srid: int = 4326,
        label_field: str | None = None,
        sort_type: str | None = None,
        multiline: bool = True,
        filename: str | None = None,
    ) -> int:
        """Store an uploaded FeatureCollection as a new layer and return its id."""
        upload = read_upload(self.spark, path, multiline)
        if sort_type is None:
            sort_type = detect_sort_type(upload.features, label_field).first()["sort_type"]
        layer_id = self._new_number()
        self._store_features(layer_id, upload.features)
        entry = self.spark.createDataFrame(
            [(layer_id, name, None, description, upload.geometry_type, srid,
              upload.feature_count, filename, True, label_field, sort_type)],
            S.LAYER_DDL,
        ).withColumns({"created_at": ntz(now), "updated_at": ntz(now)})
        self._edit(lambda rows: rows.unionByName(entry.withColumn("slug", self._free_slug(rows, name, layer_id))))
        return layer_id

    def replace(
        self,
        layer_id: int,
        path: str,
        now: datetime,
        srid: int | None = None,
        multiline: bool = True,
        filename: str | None = None,
    ) -> bool:
        """Swap all features of a layer; False when the layer does not exist."""
        if self._layer(layer_id) is None:
            return False
        upload = read_upload(self.spark, path, multiline)
        self._store_features(layer_id, upload.features)
        changes = {
            "geometry_type": F.lit(upload.geometry_type),
            "feature_count": F.lit(upload.feature_count).cast("bigint"),
            "updated_at": ntz(now),
        }
        if srid is not None:
            changes["srid"] = F.lit(srid)
        if filename:
            changes["original_filename"] = F.lit(filename)
        self._update(layer_id, changes)
        return True

    def _update(
        self, layer_id: int, changes: dict[str, Column], more: Callable[[DataFrame], dict[str, Column]] | None = None
    ) -> None:
        """Change columns of one layer; ``more`` works out further ones from the latest registry."""
        this = F.col("id") == layer_id

        def changed(rows: DataFrame) -> DataFrame:
            every = changes | (more(rows) if more else {})
            return rows.withColumns({c: F.when(this, new).otherwise(F.col(c)) for c, new in every.items()})

        self._edit(changed)

    def update(
        self,
        layer_id: int,
        now: datetime,
        name: str | None = None,
        description: str | None = None,
        is_active: bool | None = None,
        label_field: str | None = None,
        sort_type: str | None = None,
    ) -> bool:
        """Change what is given of a layer's entry; False when the layer does not exist.

        A new name gets a new slug of its own. An empty ``label_field`` takes the label away.
        """
        layer = self._layer(layer_id)
        if sort_type is not None and sort_type not in L.SORT_TYPES:
            raise ValueError(f"unknown sort type: {sort_type}")
        if layer is None:
            return False
        given = {"description": description, "is_active": is_active, "sort_type": sort_type}
        changes = {c: F.lit(value) for c, value in given.items() if value is not None} | {"updated_at": ntz(now)}
        if label_field is not None:
            changes["label_field"] = F.lit(label_field or None).cast("string")
        if not name or name == layer["name"]:
            self._update(layer_id, changes)
        else:
            changes["name"] = F.lit(name)
            self._update(layer_id, changes, lambda rows: {"slug": self._free_slug(rows, name, layer_id)})
        return True

    def set_active(self, layer_id: int, active: bool, now: datetime) -> None:
        self._update(layer_id, {"is_active": F.lit(active), "updated_at": ntz(now)})

    def delete(self, layer_id: int) -> bool:
        """Remove a layer and all its features; False when the layer does not exist."""
        if self._layer(layer_id) is None:
            return False
        self._edit(lambda rows: rows.where(F.col("id") != layer_id))
        _tried(lambda: self._features.drop_parts([str(layer_id)]))
        return True
