from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crashgrid.operators import catalog, jobs, layers, places
from crashgrid.plans import location_report as R
from crashgrid.sources import geojson

NOW = datetime(2024, 5, 1)
SQUARE = {"type": "Polygon", "coordinates": [[[-87.7, 41.8], [-87.6, 41.8], [-87.6, 41.9], [-87.7, 41.9], [-87.7, 41.8]]]}


def collection(*properties, geometry=SQUARE):
    return {"type": "FeatureCollection",
            "features": [{"type": "Feature", "properties": p, "geometry": geometry} for p in properties]}


@pytest.fixture
def upload(folder):
    def write(document, name="upload.geojson"):
        path = folder.removeprefix("file://") + "-files"
        os.makedirs(path, exist_ok=True)
        target = f"{path}/{name}"
        with open(target, "w") as handle:
            handle.write(document if isinstance(document, str) else json.dumps(document, indent=1))
        return "file://" + target
    return write


@pytest.mark.parametrize("document, message", [
    ("not-json", "invalid GeoJSON"),
    ({"type": "Feature"}, "must be a FeatureCollection"),
    ({"type": "FeatureCollection", "features": []}, "no features"),
    (collection({"a": 1}, geometry=None), "no valid features"),
])
def test_rejected_uploads(spark, upload, folder, document, message):
    path = upload(document)
    store = layers.LayerStore(spark, folder)
    with pytest.raises(ValueError, match=message):
        store.create("x", path, NOW)
    assert store.layers().count() == 0 and store.features().count() == 0


def test_features_without_geometry_are_dropped(spark, upload):
    document = collection({"district": "Test"}, None)
    document["features"].insert(0, {"type": "Feature", "properties": {"a": 1}, "geometry": None})
    got = geojson.read_upload(spark, upload(document))
    assert (got.geometry_type, got.feature_count) == ("POLYGON", 2)
    stored = got.features.orderBy("id").collect()
    assert [json.loads(r["properties"]) for r in stored] == [{"district": "Test"}, {}]


def test_layer_life_cycle(spark, upload, folder):
    store = layers.LayerStore(spark, folder)
    first = store.create("Test Layer", upload(collection({"name": "B10"}, {"name": "b9"})), NOW, label_field="name")
    second = store.create("Other", upload(collection({"x": 1}), "o.geojson"), NOW, sort_type="natural")
    row = store.layers().where(F.col("id") == first).first()
    assert (row["slug"], row["feature_count"], row["sort_type"], row["is_active"]) == ("test-layer", 2, "numeric", True)
    assert store.features(first).count() == 2 and store.features().count() == 3
    items = places.items_of_active_layer(store, first).collect()
    assert [i["name"] for i in items] == ["b9", "B10"]
    assert store.replace(first, upload(collection({"name": "only"})), NOW, srid=3435)
    row = store.layers().where(F.col("id") == first).first()
    assert (row["feature_count"], row["srid"], row["name"]) == (1, 3435, "Test Layer")
    assert store.features(second).count() == 1
    store.set_active(first, False, NOW)
    with pytest.raises(LookupError):
        places.items_of_active_layer(store, first)
    assert store.delete(first) and not store.delete(first) and not store.replace(99, "nowhere", NOW)
    assert [r["id"] for r in store.layers().collect()] == [second] and store.features().count() == 1


def test_layer_feature_as_a_report_region(spark, upload, folder):
    store = layers.LayerStore(spark, folder)
    layer = store.create("Zones", upload(collection({"name": "Loop"})), NOW)
    store.set_active(layer, False, NOW)
    boundary = places.layer_place(store.features(), layer, 1)
    assert boundary.first()["name"] == "Loop"
    points = spark.createDataFrame([("in", -87.65, 41.85), ("out", -87.5, 41.85), ("rim", -87.7, 41.85), ("none", None, None)],
                                   "crash_record_id STRING, longitude DOUBLE, latitude DOUBLE")
    found = R.in_region(points, R.Place(f"layer:{layer}", "1", boundary)).collect()
    assert [r["crash_record_id"] for r in found] == ["in"]


def test_field_profile(spark):
    rows = spark.createDataFrame(
        [(1, '{"id":1,"Ward_Name":"A","note":null}'), (2, '{"id":2,"Ward_Name":"A","late":"z"}'),
         (3, '{"id":3,"Ward_Name":"B"}'), (4, '{"id":4,"Ward_Name":"C"}'), (5, '{"id":5,"Ward_Name":"D"}')],
        "id BIGINT, properties STRING")
    got = [(r["name"], r["sample_values"], r["suggested"]) for r in layers.profile_fields(rows).collect()]
    assert got == [("id", ["1", "2", "3"], False), ("Ward_Name", ["A", "B", "C"], True), ("note", [], False),
                   ("late", ["z"], False)]
    assert [r["name"] for r in layers.field_names(rows, 1).collect()] == ["Ward_Name", "id", "note"]


def test_native_items_and_lookup(spark):
    wards = spark.createDataFrame([(10, "Lee"), (2, None), (3, "")], "ward INT, alderman STRING")
    got = [tuple(r) for r in places.native_items(wards, "wards").collect()]
    assert got == [("2", "Ward 2", "Ward 2"), ("3", "Ward 3", "Ward 3"), ("10", "Ward 10", "Ward 10 - Lee")]
    senate = spark.createDataFrame([("5", "Kim")], "district STRING, senator_name STRING")
    assert tuple(places.native_items(senate, "senate_districts").first())[2] == "District 5 - Kim"
    assert places.native_place(senate, "senate_districts", "5").first()["name"] == "Senate District 5"
    assert places.native_place(senate, "senate_districts", "6").count() == 0
    with pytest.raises(ValueError):
        places.native_place(senate, "census_tracts", "5")


def test_boundary_file(spark, upload, folder):
    document = collection({"WARD": 1, "Ward Name": "A", "Shape-Len": 1.5}, {"WARD": 2, "Ward Name": None})
    loaded = geojson.load_boundary(spark, upload(document), folder)
    assert (loaded.records_loaded, loaded.geometry_type) == (2, "Polygon")
    assert sorted(loaded.columns) == ["geometry", "shape_len", "ward", "ward_name"]
    again = geojson.load_boundary(spark, upload(collection({"a": 1})), folder)
    assert (again.records_loaded, again.columns) == (1, ["a", "geometry"])


def test_catalog(spark):
    rows = spark.createDataFrame([(2, "POLYGON" * 20), (1, None)], "ward INT, geom STRING")
    listed = catalog.list_tables({"b": catalog.SpatialTable(rows, "geom"), "a": catalog.SpatialTable(rows.limit(0))})
    assert [(r["table_name"], r["record_count"]) for r in listed.collect()] == [("a", 0), ("b", 2)]
    shown = catalog.sample_table(rows, 5, "ward").collect()
    assert [r["geom"] for r in shown] == [None, "<geometry: " + ("POLYGON" * 20)[:50] + "...>"]
    with pytest.raises(ValueError):
        catalog.sample_table(rows, 101)


def test_catalog_from_the_data(spark):
    texts = [json.dumps({"type": "Point", "coordinates": [1.5, -2, 7]}), json.dumps(SQUARE), None]
    shapes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, geom STRING")
    points = spark.createDataFrame([(None, None), (3.0, 4.0)], "longitude DOUBLE, latitude DOUBLE")
    got = {r["table_name"]: tuple(r)[1:] for r in catalog.describe_tables(
        {"s": shapes, "p": points, "n": points.limit(0), "x": spark.range(3), "one": shapes.limit(1)}).collect()}
    assert got["s"] == ("geom", "GEOMETRY", 3, -87.7, -2.0, 1.5, 41.9, 2, 3) and got["one"][1:3] == ("POINT", 3)
    assert got["p"] == ("longitude, latitude", "POINT", 2, 3.0, 4.0, 3.0, 4.0, 1, 2)
    assert got["n"] == ("longitude, latitude", None, None, None, None, None, None, 0, 0) and "x" not in got


def test_jobs(spark, folder):
    registry = spark.createDataFrame([(1, "A", "custom", True), (2, "B", "custom", False)],
                                     "id BIGINT, name STRING, job_type STRING, enabled BOOLEAN")
    runs = spark.createDataFrame(
        [("e1", 1, "failed", datetime(2024, 1, 1)), ("e2", 1, "running", datetime(2024, 1, 2)),
         ("e3", 2, "failed", datetime(2024, 1, 2)), ("e4", 9, "failed", datetime(2024, 1, 3))],
        "execution_id STRING, job_id BIGINT, status STRING, started_at TIMESTAMP_NTZ")
    assert tuple(jobs.job_summary(registry, runs, datetime(2024, 1, 3)).first()) == (2, 1, 1, 2, datetime(2024, 1, 3))
    assert [r["execution_id"] for r in jobs.job_history(runs, registry).collect()] == ["e2", "e3", "e1"]
    assert [r["execution_id"] for r in jobs.job_history(runs, registry, job_id=1, limit=1, offset=1).collect()] == ["e1"]
    latest = {r["job_id"]: (r["execution_id"], r["already_running"]) for r in jobs.latest_execution_per_job(runs).collect()}
    assert latest == {1: ("e2", True), 2: ("e3", False), 9: ("e4", False)}
    jobs.record_run(spark, folder, "x", 1, "completed", NOW, datetime(2024, 5, 1, 0, 0, 59, 900000), 4, 3, 1, 0)
    stored = spark.read.parquet(folder).first()
    assert (stored["duration_seconds"], stored["records_processed"]) == (59, 4)
    with pytest.raises(ValueError):
        jobs.job_history(runs, registry, limit=201)


def test_features_keep_their_numbers_over_many_files(spark, folder):
    """Numbers follow the file and the place in it, however many files an upload has."""
    import json

    from crashgrid.sources import geojson

    made = [
        json.dumps({"type": "FeatureCollection", "features": [
            {"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 0]}, "properties": {"n": str(i)}}]})
        for i in range(40)
    ]
    lines = spark.createDataFrame(list(enumerate(made)), "i int, value string")
    lines.repartitionByRange(16, "i").sortWithinPartitions("i").select("value").write.text(folder)
    rows = geojson.all_features(geojson.read_documents(spark, folder, multiline=False)).orderBy("id").collect()
    assert [json.loads(r["properties"])["n"] for r in rows] == [str(i) for i in range(40)]
    assert [r["id"] for r in rows] == [i * 1_000_000_000 + 1 for i in range(40)]
    one_each = f"{folder}-files"
    lines.where("i < 8").repartitionByRange(8, "i").select("value").write.text(one_each)
    upload = geojson.read_upload(spark, one_each)
    assert upload.feature_count == 8
    assert [r["id"] for r in upload.features.orderBy("id").collect()] == [i * 1_000_000_000 + 1 for i in range(8)]


def test_the_whole_layer_is_profiled(spark):
    made = [(i, f'{{"n":"{i}"}}') for i in range(101)] + [(200 + i, f'{{"n":"x","late":"{i}"}}') for i in range(101)]
    rows = spark.createDataFrame(made, "id BIGINT, properties STRING")
    got = [(r["name"], r["sample_values"]) for r in layers.profile_fields(rows).collect()]
    assert got == [("n", ["0", "1", "2"]), ("late", ["0", "1", "2"])]
    assert [r["name"] for r in layers.profile_fields(rows, 100).collect()] == ["n"]
    assert [r["name"] for r in layers.field_names(rows).collect()] == ["late", "n"]
    assert layers.detect_sort_type(rows, "n").first()["sort_type"] == "alphabetic"
    assert layers.detect_sort_type(rows, "n", 100).first()["sort_type"] == "numeric"


def test_two_writers_lose_no_edit(spark, upload, folder, monkeypatch):
    path = upload(collection({"name": "a"}))
    one, two = layers.LayerStore(spark, folder), layers.LayerStore(spark, folder)
    first = one.create("First", path, NOW)
    rewrite, seen = one._registry.rewrite, []

    def interrupted(*args, **kwargs):
        if not seen:
            seen.append(two.create("Second", path, NOW))
        return rewrite(*args, **kwargs)

    monkeypatch.setattr(one._registry, "rewrite", interrupted)
    one.set_active(first, False, NOW)
    got = {r["name"]: (r["id"], r["is_active"]) for r in one.layers().collect()}
    assert got == {"First": (first, False), "Second": (seen[0], True)} and seen[0] != first


def test_layer_numbers_are_not_handed_out_again(spark, upload, folder):
    path = upload(collection({"name": "a"}))
    store = layers.LayerStore(spark, folder)
    first, second = store.create("A", path, NOW), store.create("B", path, NOW)
    assert store.delete(second) and store.create("C", path, NOW) == second + 1
    assert store.delete(first) and [r["layer_id"] for r in store.features().collect()] == [second + 1]


def test_layer_update_and_unique_slugs(spark, upload, folder):
    path = upload(collection({"name": "a"}))
    store = layers.LayerStore(spark, folder)
    ids = [store.create(name, path, NOW, label_field="name") for name in ("School Zones", "School zones!", "Parks")]
    slug = lambda: [r["slug"] for r in store.layers().orderBy("id").collect()]
    assert slug() == ["school-zones", "school-zones-2", "parks"]
    assert store.update(ids[2], NOW, name="School Zones", description="d", is_active=False, label_field="", sort_type="natural")
    row = store.layers().where(F.col("id") == ids[2]).first()
    assert slug()[2] == "school-zones-3" and (row["description"], row["is_active"], row["label_field"], row["sort_type"]) == ("d", False, None, "natural")
    assert store.update(ids[0], NOW, name="School Zones") and slug()[0] == "school-zones"
    assert store.update(ids[1], NOW, label_field="other") and slug()[1] == "school-zones-2"
    assert not store.update(99, NOW, name="x")
    with pytest.raises(ValueError):
        store.update(ids[0], NOW, sort_type="random")


def test_a_point_is_an_empty_region(spark, upload, folder):
    store = layers.LayerStore(spark, folder)
    layer = store.create("Points", upload(collection({"name": "p"}, geometry={"type": "Point", "coordinates": [-87.65, 41.85]})), NOW)
    boundary = places.layer_place(store.features(), layer, 1)
    points = spark.createDataFrame([("in", -87.65, 41.85)], "crash_record_id STRING, longitude DOUBLE, latitude DOUBLE")
    assert R.in_region(points, R.Place(f"layer:{layer}", "1", boundary)).count() == 0


def test_place_ids_reach_the_scan(spark, folder):
    spark.createDataFrame([(5, "A"), (50, "B")], "ward INT, alderman STRING").write.parquet(folder)
    wards = spark.read.parquet(folder)
    found = places.native_place(wards, "wards", "5")
    assert [r["name"] for r in found.collect()] == ["Ward 5"]
    assert "EqualTo(ward,5)" in found._jdf.queryExecution().executedPlan().toString()
    assert [places.native_place(wards, "wards", odd).count() for odd in ("05", "x", "5.0", " 5")] == [0, 0, 0, 0]
