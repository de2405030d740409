"""Registered queries: each runs one operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashgrid import schemas as S
from crashgrid.checks.fixtures import view
from crashgrid.functions import cleaning as C
from crashgrid.functions import geo
from crashgrid.functions import labels as L
from crashgrid.functions import predicates as P
from crashgrid.functions.windows import sync_window, trend_window
from crashgrid.operators import catalog, dashboard, jobs, layers, places, spatial, validate
from crashgrid.operators.merge import merge_rows, purge, upsert
from crashgrid.operators.sanitize import first_row_per_key, sanitize
from crashgrid.plans import documented
from crashgrid.plans import location_report as R
from crashgrid.session import new_folder
from crashgrid.sources import exports, feeds, geojson
from crashgrid.sources.tables import warehouse_table
from crashgrid.streaming.sync import sync, sync_batches
from crashgrid.streaming.sync import sync_incremental as sync_incremental_run

Query = Callable[[SparkSession, str], DataFrame]

START, END = datetime(1997, 1, 1), datetime(1999, 12, 31)
AS_OF = datetime(2001, 8, 1, 12, 0, 0)
JOBS_AS_OF = datetime(2024, 1, 31)
CENTER = R.Radius(latitude=41.85, longitude=-87.72, radius_feet=15_840.0)
RING = ((-87.80, 41.70), (-87.60, 41.70), (-87.60, 41.80), (-87.70, 41.80), (-87.70, 41.95),
        (-87.80, 41.95))
GRID_BOX = (-87.9, 41.65, -87.55, 42.05)
NEAR_METERS = 400.0

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def times_as_text(rows: DataFrame) -> DataFrame:
    """Timestamps as text, so that both engines print the same value."""
    return rows.select(
        *[
            F.substring(F.col(f.name).cast("string"), 1, 19).alias(f.name)
            if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))
            else F.col(f.name)
            for f in rows.schema.fields
        ]
    )


def full(rows: DataFrame, spec: S.TableSpec) -> DataFrame:
    """Fixture rows with every declared column of their table."""
    fields = T.StructType.fromDDL(spec.ddl).fields
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


# -- dashboard ---------------------------------------------------------------
@query
def dashboard_stats(spark, sf):
    return dashboard.dashboard_stats(
        view(spark, sf, "fx_crashes"), view(spark, sf, "fx_people"), START, END
    )


@query
def dashboard_stats_by_crash_date(spark, sf):
    return dashboard.dashboard_stats(
        view(spark, sf, "fx_crashes"), view(spark, sf, "fx_people"), START, END, date_from="crash"
    )


@query
def weekly_trends(spark, sf):
    return dashboard.weekly_trends(view(spark, sf, "fx_crashes"))


@query
def weekly_trends_recent(spark, sf):
    start, end = trend_window(AS_OF, weeks=26)
    return dashboard.weekly_trends(view(spark, sf, "fx_crashes"), start, end)


@query
def crashes_by_hour(spark, sf):
    return dashboard.crashes_by_hour(view(spark, sf, "fx_crashes"), START, END)


@query
def crashes_by_cause(spark, sf):
    return dashboard.crashes_by_cause(view(spark, sf, "fx_crashes"), end=END)


@query
def crash_points(spark, sf):
    return times_as_text(dashboard.crash_points(view(spark, sf, "fx_crashes"), START, END))


@query
def crash_points_geojson(spark, sf):
    points = dashboard.crash_points(view(spark, sf, "fx_crashes"), START, END)
    path = new_folder(spark, "features")
    exports.write_features(points, path)
    written = spark.read.text(path)
    return written.select(
        F.get_json_object("value", "$.properties.crash_record_id").alias("crash_record_id"),
        F.col("value").alias("feature"),
    )


@query
def severity_categories(spark, sf):
    return dashboard.category_counts(view(spark, sf, "fx_crashes"), "severity")


@query
def hit_and_run_categories(spark, sf):
    return dashboard.category_counts(view(spark, sf, "fx_crashes"), "hit_and_run")


@query
def crash_type_categories(spark, sf):
    return dashboard.category_counts(view(spark, sf, "fx_crashes"), "crash_type")


@query
def category_filter(spark, sf):
    chosen = P.in_categories("severity", ["Fatal", "Other Injury"]) & P.in_categories(
        "crash_type", ["Pedestrian", "Other"]
    )
    return view(spark, sf, "fx_crashes").where(chosen).select("crash_record_id", "crash_type")


@query
def crash_density_grid(spark, sf):
    return dashboard.density_grid(view(spark, sf, "fx_crashes"), 0.01, GRID_BOX, START, END)


@query
def crashes_by_date_range(spark, sf):
    rows = dashboard.crash_points(view(spark, sf, "fx_crashes"), START, END, limit=None)
    return times_as_text(rows.select("crash_record_id", "crash_date", "longitude", "latitude"))


@query
def map_layer_crashes(spark, sf):
    return times_as_text(dashboard.map_layer(view(spark, sf, "fx_crashes"), "crashes"))


@query
def map_layer_fatalities(spark, sf):
    rows = view(spark, sf, "fx_fatalities")
    return times_as_text(dashboard.map_layer(rows, "vision_zero_fatalities"))


@query
def map_layer_features(spark, sf):
    return dashboard.map_layer(view(spark, sf, "fx_layer_features"), "spatial_layer_features")


@query
def table_counts(spark, sf):
    names = {"crashes": "fx_crashes", "crash_people": "fx_people", "crash_vehicles": "fx_vehicles",
             "vision_zero_fatalities": "fx_fatalities"}
    return dashboard.table_counts({t: view(spark, sf, v) for t, v in names.items()})


@query
def coordinate_outliers(spark, sf):
    raw = view(spark, sf, "fx_raw_crashes").select(
        "ingest_seq", C.clean_float(F.col("latitude")).alias("latitude"),
        C.clean_float(F.col("longitude")).alias("longitude"),
    )
    return dashboard.coordinate_outliers(raw).select("*", geo.point_wkt().alias("point"))


@query
def coordinate_outlier_count(spark, sf):
    return feeds.count_rows(coordinate_outliers(spark, sf)).withColumnRenamed(
        "count", "out_of_bounds_count"
    )


# -- feeds -------------------------------------------------------------------
def _landed(spark, rows: DataFrame) -> str:
    path = new_folder(spark, "feed")
    feeds.land(rows, path)
    return path


def _crash_feed(spark, sf) -> DataFrame:
    """Crash feed as landed text, with ISO dates and a change stamp."""
    crashes = view(spark, sf, "fx_crashes")
    rows = crashes.select(
        "crash_record_id",
        L.iso_text(F.col("crash_date")).alias("crash_date"),
        "injuries_total", "street_name",
        L.iso_text(F.date_add(F.col("crash_date").cast("date"), 3).cast("timestamp_ntz"))
        .alias(feeds.UPDATED_AT),
    )
    return feeds.scan_feed(spark, _landed(spark, rows), "crashes")


@query
def feed_scan(spark, sf):
    path = _landed(spark, view(spark, sf, "fx_raw_crashes"))
    return feeds.scan_feed(
        spark, path, "crashes", select=["ingest_seq", "crash_record_id", "latitude"],
        where=F.col("latitude") != "N/A", order_by=["crash_date", "crash_record_id"],
    )


@query
def feed_date_window(spark, sf):
    rows = _crash_feed(spark, sf).where(
        feeds.date_window("crash_date", f"{START:%Y-%m-%d}", f"{END:%Y-%m-%d}")
    )
    return rows.select("crash_record_id", "crash_date")


@query
def feed_updated_since(spark, sf):
    rows = feeds.updated_since(_crash_feed(spark, sf), datetime(1999, 6, 1))
    return rows.select("crash_record_id", F.col(f"`{feeds.UPDATED_AT}`").alias("updated_at"))


@query
def feed_next_cursor(spark, sf):
    return feeds.next_cursor(_crash_feed(spark, sf))


@query
def feed_page(spark, sf):
    rows = _crash_feed(spark, sf).select("crash_record_id", "crash_date")
    return feeds.page(rows, 3, ["crash_date", "crash_record_id"], size=1000)


@query
def feed_page_after(spark, sf):
    rows = _crash_feed(spark, sf).select("crash_record_id", "crash_date")
    cursor = ("1997-06-30T23:59:59", "")
    return feeds.page_after(rows, cursor, ["crash_date", "crash_record_id"], size=1000)


@query
def feed_count(spark, sf):
    window = feeds.date_window("crash_date", f"{START:%Y-%m-%d}")
    return feeds.count_rows(_crash_feed(spark, sf), window)


JOB_CONFIGS = {
    "last_30_days_crashes": {}, "last_6_months_fatalities": {}, "some_other_job": {}, "full_refresh": {},
    "custom": {"date_range_days": 90, "end_date": "2001-07-15"},
}


@query
def job_window_counts(spark, sf):
    """How many feed rows the window of each kind of refresh job holds, in one pass."""
    counts = []
    for job, config in JOB_CONFIGS.items():
        window = sync_window(job, AS_OF, config)
        inside = feeds.date_window("crash_date", window.start, window.end)
        counts.append(F.struct(
            F.lit(job).alias("job_type"), F.lit(",".join(window.datasets)).alias("datasets"), F.count_if(inside).alias("fetched")
        ))
    return _crash_feed(spark, sf).agg(F.array(*counts).alias("windows")).select(F.inline("windows"))


@query
def feed_dated_landing(spark, sf):
    """The window of a landing with a folder per month."""
    path = new_folder(spark, "feed")
    feeds.land_by_date(view(spark, sf, "fx_raw_crashes"), path, letters=feeds.MONTH)
    rows = feeds.scan_dates(spark, path, "crashes", "1997-01-01", "1999-12-31")
    return rows.select("crash_record_id", "crash_date", "ingest_seq")


@query
def feed_sample(spark, sf):
    rows = _crash_feed(spark, sf).select("crash_record_id", "crash_date", "injuries_total")
    return feeds.sample_rows(rows, 100, ["crash_record_id"])


# -- cleaning and validation -------------------------------------------------
@query
def sanitize_crashes(spark, sf):
    rows = sanitize("crashes", view(spark, sf, "fx_raw_crashes"), carry=["ingest_seq"])
    return times_as_text(
        rows.select("crash_record_id", "crash_date", "latitude", "longitude", "injuries_total",
                    "street_name", "ingest_seq")
    )


@query
def sanitize_people(spark, sf):
    rows = sanitize("people", view(spark, sf, "fx_raw_people"))
    return times_as_text(
        rows.select("crash_record_id", "person_id", "age", "person_type", "bac_result_value",
                    "area_00_i", "crash_date", "vehicle_id")
    )


@query
def sanitize_vehicles(spark, sf):
    rows = sanitize("vehicles", view(spark, sf, "fx_raw_vehicles"))
    return times_as_text(
        rows.select("crash_unit_id", "crash_record_id", "unit_no", "vehicle_year",
                    "num_passengers", "occupant_cnt", "make", "crash_date")
    )


@query
def sanitize_fatalities(spark, sf):
    rows = sanitize("fatalities", view(spark, sf, "fx_raw_fatalities"), carry=["ingest_seq"])
    return times_as_text(
        rows.select("person_id", "rd_no", "crash_date", "latitude", "longitude", "crash_location",
                    "victim", "ingest_seq")
    )


def _sanitize_whole(dataset: str):
    """All cleaned columns of whole records."""

    def run(spark, sf):
        return times_as_text(sanitize(dataset, view(spark, sf, f"fx_whole_{dataset}")))

    run.__name__ = f"sanitize_{dataset}_whole"
    return run


for _dataset in ("crashes", "people", "vehicles", "fatalities"):
    query(_sanitize_whole(_dataset))


@query
def clean_text(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    cleaned = C.clean_string(F.col("text"))
    return documents.select("doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).alias("n"))


@query
def remove_duplicates(spark, sf):
    rows = sanitize("fatalities", view(spark, sf, "fx_raw_fatalities"), carry=["ingest_seq"])
    kept = first_row_per_key(rows, "person_id", ["ingest_seq"])
    return kept.select("person_id", "rd_no", "latitude", "crash_location", "victim", "ingest_seq")


@query
def validate_raw_crashes(spark, sf):
    checked = validate.validate(view(spark, sf, "fx_raw_crashes"))
    return checked.select(
        "ingest_seq", "valid", F.array_join("errors", "; ").alias("errors"),
        F.array_join("warnings", "; ").alias("warnings"),
    )


@query
def validation_summary(spark, sf):
    return validate.validation_summary(validate.validate(view(spark, sf, "fx_raw_crashes")))


@query
def validation_messages(spark, sf):
    return validate.validation_messages(
        view(spark, sf, "fx_raw_crashes"), "crashes", "ingest_seq"
    )


# -- spatial -----------------------------------------------------------------
def _ring_boundaries(spark, sf) -> DataFrame:
    return spatial.rings_to_boundaries(view(spark, sf, "fx_rings"))


def _zone_boundaries(spark, sf) -> DataFrame:
    """Customer rectangles as boundaries with nested rings."""
    zones = view(spark, sf, "fx_zones")

    def corner(lon, lat):
        return F.array(F.col(lon), F.col(lat))

    ring = F.array(corner("min_lon", "min_lat"), corner("max_lon", "min_lat"),
                   corner("max_lon", "max_lat"), corner("min_lon", "max_lat"),
                   corner("min_lon", "min_lat"))
    polygons = F.array(F.array(ring)).alias("polygons")
    return zones.select("ward", "ward_name", "alderman", polygons)


@query
def crashes_in_radius(spark, sf):
    rows = R.in_region(view(spark, sf, "fx_crashes"), CENTER)
    meters = geo.distance_m(F.col("longitude"), F.col("latitude"), F.lit(CENTER.longitude),
                            F.lit(CENTER.latitude))
    return rows.select("crash_record_id", F.round(meters, 2).alias("meters"))


@query
def crashes_in_polygon(spark, sf):
    rows = R.in_region(view(spark, sf, "fx_crashes"), R.choose_region(ring=RING))
    return rows.select("crash_record_id", "longitude", "latitude")


def _place(spark, sf, place_id: str) -> R.Place:
    boundary = _ring_boundaries(spark, sf).withColumnRenamed("place_id", "beat_num")
    return R.Place("police_beats", place_id, places.native_place(boundary, "police_beats", place_id))


@query
def crashes_in_place(spark, sf):
    region = R.choose_region(place=_place(spark, sf, "D"), radius=CENTER)
    rows = R.in_region(view(spark, sf, "fx_crashes"), region)
    return rows.select("crash_record_id", "longitude", "latitude")


@query
def place_lookup(spark, sf):
    return places.native_geometry(_zone_boundaries(spark, sf), "wards", "42")


@query
def layer_place_lookup(spark, sf):
    polygons = view(spark, sf, "fx_layer_features").join(
        _zone_boundaries(spark, sf).select(F.col("ward").cast("bigint").alias("id"), "polygons"), "id"
    )
    features = polygons.withColumn("geometry", geo.geojson_from_polygons(F.col("polygons"))).drop(
        "polygons"
    )
    found = places.layer_place(features, 1, 66)
    return found.select("place_type", "place_id", "name", F.size("edges").alias("edge_count"))


@query
def crashes_per_place(spark, sf):
    return documented.crashes_per_place(
        view(spark, sf, "fx_crashes"), _ring_boundaries(spark, sf), "place_id"
    )


@query
def crashes_per_zone(spark, sf):
    zones = spatial.with_edges(_zone_boundaries(spark, sf))
    return documented.crashes_per_place(view(spark, sf, "fx_crashes"), zones, "ward")


@query
def beat_hotspots(spark, sf):
    beats = _ring_boundaries(spark, sf).withColumnRenamed("place_id", "beat")
    return documented.hotspots(view(spark, sf, "fx_crashes"), beats)


@query
def nearest_place(spark, sf):
    zones = spatial.with_edges(_zone_boundaries(spark, sf)).select("ward", "ward_name", "edges")
    nearest = spatial.nearest_place(zones, -87.6298, 42.1781, "ward")
    return nearest.withColumn("distance", F.round("distance", 9))


def _near_sites(spark, sf) -> DataFrame:
    crashes = view(spark, sf, "fx_crashes").select(
        "crash_record_id", "crash_date", "street_name", "latitude", "longitude"
    )
    return spatial.near_sites(
        crashes, view(spark, sf, "fx_sites"), NEAR_METERS, spread_by=["crash_record_id"]
    )


def _near_site_columns(pairs: DataFrame) -> DataFrame:
    return times_as_text(
        pairs.select("crash_record_id", "crash_date", "street_name", "latitude", "longitude",
                     "signal_id", "signal_street",
                     F.round("distance_meters", 2).alias("distance_meters"))
    )


@query
def crashes_near_sites(spark, sf):
    pairs = _near_sites(spark, sf)
    return _near_site_columns(
        pairs.orderBy(F.desc("crash_date"), "crash_record_id", "signal_id").limit(1000)
    )


@query
def all_crashes_near_sites(spark, sf):
    """Every pair of the join, without the list's limit."""
    return _near_site_columns(_near_sites(spark, sf))


@query
def radius_area(spark, sf):
    """Ring of a 1 km circle around every site, one row per vertex."""
    ring = geo.circle_ring(F.col("site_longitude"), F.col("site_latitude"), F.lit(1.0))
    vertices = view(spark, sf, "fx_sites").select("signal_id", F.posexplode(ring).alias("n", "v"))
    return vertices.select(
        "signal_id", "n", F.round(F.col("v")[0], 9).alias("lon"), F.round(F.col("v")[1], 9).alias("lat")
    )


@query
def wkt_round_trip(spark, sf):
    crashes = view(spark, sf, "fx_crashes").where(P.has_point())
    parsed = crashes.select("crash_record_id", geo.point_wkt().alias("wkt")).withColumn(
        "p", geo.point_from_wkt(F.col("wkt"))
    )
    return parsed.select("crash_record_id", F.col("p.lon").alias("longitude"),
                         F.col("p.lat").alias("latitude"))


@query
def crash_geometry(spark, sf):
    """Points where both coordinates are known, null elsewhere."""
    point = geo.make_point(F.col("longitude"), F.col("latitude"))
    return view(spark, sf, "fx_crashes").select("crash_record_id", F.to_json(point).alias("point"))


# -- location report ---------------------------------------------------------
def _report(spark, sf, region, start=None, end=None) -> R.LocationReport:
    return R.LocationReport(
        view(spark, sf, "fx_crashes"), view(spark, sf, "fx_people"), view(spark, sf, "fx_vehicles"),
        region, start, end,
    )


@query
def report_stats_radius(spark, sf):
    return _report(spark, sf, CENTER, START, END).stats()


@query
def report_stats_polygon(spark, sf):
    return _report(spark, sf, R.choose_region(ring=RING)).stats()


@query
def report_stats_place(spark, sf):
    return _report(spark, sf, _place(spark, sf, "L"), START).stats()


@query
def report_cost_breakdown(spark, sf):
    return _report(spark, sf, CENTER, START, END).cost_breakdown()


@query
def report_person_subtotals(spark, sf):
    return R.person_subtotals(_report(spark, sf, CENTER, START, END).cost_breakdown())


@query
def report_causes(spark, sf):
    causes = _report(spark, sf, CENTER).causes()
    return causes.withColumn("label", L.cause_label(F.col("cause")))


@query
def report_monthly_trends(spark, sf):
    months = _report(spark, sf, CENTER).monthly_trends(AS_OF)
    return months.withColumn("label", L.month_label(F.col("month")))


@query
def report_monthly_averages(spark, sf):
    return R.monthly_averages(_report(spark, sf, CENTER).monthly_trends(AS_OF))


@query
def report_points(spark, sf):
    return times_as_text(_report(spark, sf, R.choose_region(ring=RING)).points())


def _export(spark, sf, dataset: str) -> DataFrame:
    tables = {
        "crashes": view(spark, sf, "fx_crashes"),
        "crash_people": view(spark, sf, "fx_people"),
        "crash_vehicles": view(spark, sf, "fx_vehicles"),
        "vision_zero_fatalities": view(spark, sf, "fx_fatalities"),
    }
    rows = R.export_rows([dataset], tables, CENTER, START, END)[dataset]
    path = new_folder(spark, f"csv-{dataset}")
    exports.write_csv(rows, path)
    return spark.read.option("header", "true").option("escape", '"').csv(path)


@query
def export_crashes(spark, sf):
    return _export(spark, sf, "crashes")


@query
def export_people(spark, sf):
    return _export(spark, sf, "people")


@query
def export_vehicles(spark, sf):
    return _export(spark, sf, "vehicles")


@query
def export_vision_zero(spark, sf):
    return _export(spark, sf, "vision_zero")


# -- merge, purge, sync ------------------------------------------------------
LOADED_BEFORE = datetime(2000, 7, 1)
AMENDED_FROM = datetime(2000, 1, 1)
NOW = datetime(2001, 8, 2)
STORED_WINDOW = (datetime(1997, 5, 10), datetime(1999, 2, 3))


def _amended(crashes: DataFrame) -> DataFrame:
    """A refresh window: amended and new crashes, carrying only some columns."""
    return crashes.where(P.in_dates("crash_date", AMENDED_FROM)).select(
        "crash_record_id", "crash_date", "latitude", "longitude",
        (F.col("injuries_total") + 1).alias("injuries_total"), "crash_type",
        F.lit("dropped by the table").alias("not_a_column"),
    )


def _loaded(spark, sf):
    """A warehouse crash table holding everything before the cut-off."""
    warehouse = new_folder(spark, "warehouse")
    table = warehouse_table(spark, warehouse, S.CRASHES)
    crashes = view(spark, sf, "fx_crashes")
    older = full(crashes.where(F.col("crash_date") < P.ntz(LOADED_BEFORE)), S.CRASHES)
    table.load(older.withColumns({"created_at": P.ntz(AMENDED_FROM), "updated_at": P.ntz(AMENDED_FROM)}))
    return warehouse, table, crashes


@query
def upsert_crashes(spark, sf):
    _, table, crashes = _loaded(spark, sf)
    upsert(table, S.CRASHES, _amended(crashes), now=NOW)
    return times_as_text(
        table.read().select("crash_record_id", "crash_date", "injuries_total", "injuries_fatal",
                            "hit_and_run_i", "street_name", "created_at", "updated_at")
    )


@query
def upsert_counts(spark, sf):
    _, table, crashes = _loaded(spark, sf)
    batch = _amended(crashes)
    nameless = batch.withColumn("crash_record_id", F.lit(""))
    counts = upsert(table, S.CRASHES, batch.unionByName(nameless), now=NOW)
    return spark.createDataFrame(
        [counts], "fetched BIGINT, inserted BIGINT, updated BIGINT, skipped BIGINT, repeated BIGINT"
    )


@query
def merge_people(spark, sf):
    """Composite-key merge as one plan: passengers' ages move up by one."""
    people = view(spark, sf, "fx_people")
    stored = full(people, S.PEOPLE).withColumns(
        {"created_at": P.ntz(START), "updated_at": P.ntz(START)}
    )
    batch = people.where(F.col("person_type") == "PASSENGER").select(
        "crash_record_id", "person_id", (F.col("age") + 1).alias("age")
    )
    merged = merge_rows(S.PEOPLE, stored, batch, P.ntz(NOW))
    return times_as_text(
        merged.select("crash_record_id", "person_id", "age", "person_type", "updated_at")
    )


PURGE_FROM, PURGE_TO = "1997-03-10", "1998-11-20"


@query
def stored_date_window(spark, sf):
    """A date range of the stored table, of which only its months are listed."""
    _, table, _ = _loaded(spark, sf)
    rows = table.read_between(*STORED_WINDOW)
    return times_as_text(rows.select("crash_record_id", "crash_date", "injuries_total", "street_name"))


@query
def purge_crashes(spark, sf):
    warehouse, table, _ = _loaded(spark, sf)
    purge({"crashes": table}, "crashes", f"{warehouse}/data_deletion_logs", PURGE_FROM, PURGE_TO)
    return times_as_text(table.read().select("crash_record_id", "crash_date", "street_name"))


@query
def purge_log(spark, sf):
    warehouse, table, _ = _loaded(spark, sf)
    log = f"{warehouse}/data_deletion_logs"
    purge({"crashes": table}, "crashes", log, PURGE_FROM, PURGE_TO)
    purge({"crashes": table}, "crashes", log)
    return spark.read.parquet(log).drop("execution_time_seconds")


@query
def sync_crashes(spark, sf):
    """Stream two landings of the raw feed file by file; the first amends every record of the second."""
    raw = view(spark, sf, "fx_raw_crashes")
    amended = raw.withColumns(
        {"ingest_seq": F.col("ingest_seq") + 1_000_000_000, "street_name": F.lit(" AMENDED  ST ")}
    )
    path = new_folder(spark, "feed")
    for n, text in enumerate((amended, raw)):
        feeds.land(text.repartition(2, "ingest_seq"), f"{path}/{n}")
    warehouse = new_folder(spark, "warehouse")
    checkpoints = new_folder(spark, "checkpoints")
    sync(spark, {"crashes": f"{path}/*"}, warehouse, checkpoints, clock=lambda: NOW, files_per_batch=1)
    table = warehouse_table(spark, warehouse, S.CRASHES)
    return times_as_text(
        table.read().select("crash_record_id", "crash_date", "latitude", "longitude",
                            "injuries_total", "street_name", "created_at")
    )


def _landings(spark, *landings) -> str:
    """Landings of a feed, each in a folder of its own, written in the order given."""
    path = new_folder(spark, "feed")
    for name, rows in landings:
        feeds.land(rows.repartition(2, "crash_record_id"), f"{path}/{name}")
    return path


def _stored_streets(spark, warehouse):
    rows = warehouse_table(spark, warehouse, S.CRASHES).read()
    return times_as_text(rows.select("crash_record_id", "crash_date", "injuries_total", "street_name"))


@query
def sync_incremental(spark, sf):
    """Three runs over a growing landing; change stamps, not landings, tell which record is the newest."""
    raw, key = view(spark, sf, "fx_raw_crashes"), F.col("ingest_seq")
    path, warehouse = new_folder(spark, "feed"), new_folder(spark, "warehouse")
    for n in range(3):
        version = (key + n) % 3
        landed = raw.where((F.lit(n) < 2) | (key % 2 == 0)).withColumns({
            "street_name": F.concat(F.lit("v"), version.cast("string"), F.lit("  st")),
            feeds.UPDATED_AT: F.concat(F.lit("2024-01-0"), (version + 1).cast("string"), F.lit("T00:00:00.000")),
        })
        # As many files as the size of the shuffle asks for; all rows of a key share one.
        feeds.land(landed.drop("ingest_seq").repartition("crash_record_id"), f"{path}/{n}")
        sync_incremental_run(spark, f"{path}/*", "crashes", warehouse, clock=lambda: NOW)
    return _stored_streets(spark, warehouse)


@query
def sync_unsequenced(spark, sf):
    """Amendments without sequence or stamp, landed in reverse, one file a batch: the later file stands."""
    raw, key = view(spark, sf, "fx_raw_crashes"), F.col("ingest_seq")
    street = lambda rows, name: rows.withColumn("street_name", F.lit(name))
    path = _landings(
        spark,
        ("2", street(raw.where(key % 3 == 1), "third").drop("ingest_seq")),
        ("1", street(raw.where(key % 3 != 0), "second").drop("ingest_seq")),
        ("0", street(raw, "first")),
    )
    warehouse = new_folder(spark, "warehouse")
    sync(spark, {"crashes": f"{path}/*"}, warehouse, new_folder(spark, "checkpoints"), clock=lambda: NOW, files_per_batch=1)
    return _stored_streets(spark, warehouse)


@query
def sync_progress(spark, sf):
    """Counts of three runs over a growing landing: new rows, amended ones, older ones again."""
    raw, key = view(spark, sf, "fx_raw_crashes"), F.col("ingest_seq")
    path, warehouse, checkpoints = (new_folder(spark, n) for n in ("feed", "warehouse", "checkpoints"))
    for n, rows in enumerate((raw.where(key % 2 == 0), raw.withColumn("ingest_seq", key + 1_000_000_000), raw)):
        feeds.land(rows.repartition(3, "crash_record_id"), f"{path}/{n}")
        sync(spark, {"crashes": f"{path}/*"}, warehouse, checkpoints, clock=lambda: NOW, files_per_batch=100)
    return sync_batches(spark, warehouse).drop("stream")


@query
def sync_totals(spark, sf):
    """Totals of a refresh job that reads only its own window of the people feed."""
    window = sync_window("custom", AS_OF, {"endpoints": ["people"], "start_date": "1997-01-01",
                                           "end_date": "1999-12-31"})
    path = _landed(spark, view(spark, sf, "fx_raw_people"))
    totals = sync(spark, {"people": path}, new_folder(spark, "warehouse"),
                  new_folder(spark, "checkpoints"), clock=lambda: NOW, window=window,
                  files_per_batch=100)
    return totals.select("dataset", "fetched", "skipped",
                         (F.col("inserted") + F.col("updated") + F.col("repeated")).alias("usable"))


# -- layers and places -------------------------------------------------------
DOCUMENT_FEATURES = 500


def _layer_upload(spark, sf) -> str:
    """FeatureCollections of customers, a bounded number of features per document."""
    features = view(spark, sf, "fx_layer_features").join(
        _zone_boundaries(spark, sf).select(F.col("ward").cast("bigint").alias("id"), "polygons"), "id"
    )
    geometry = F.when(F.col("id") % 10 == 9, "null").otherwise(
        geo.geojson_from_polygons(F.col("polygons"))
    )
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'), "properties", F.lit(',"geometry":'), geometry,
        F.lit("}"),
    )
    document = F.floor(F.col("id") / DOCUMENT_FEATURES)
    collected = features.groupBy(document.alias("document")).agg(
        F.array_sort(F.collect_list(F.struct("id", feature.alias("feature")))).alias("features")
    )
    text = F.concat(
        F.lit('{"type":"FeatureCollection","features":['),
        F.array_join(F.transform("features", lambda f: f["feature"]), ","),
        F.lit("]}"),
    )
    path = new_folder(spark, "geojson")
    collected.orderBy("document").select(text.alias("value")).write.text(path)
    return path


@query
def geojson_features(spark, sf):
    upload = geojson.read_upload(spark, _layer_upload(spark, sf), multiline=False)
    shape = F.get_json_object("geometry", "$.type")
    return (
        upload.features.groupBy("properties", shape.alias("geometry_type"))
        .agg(F.count("*").alias("features"))
        .withColumns({"layer_type": F.lit(upload.geometry_type),
                      "layer_features": F.lit(upload.feature_count).cast("bigint")})
    )


def _layer_store(spark, sf) -> layers.LayerStore:
    """Two layers: the second is replaced, and a third is deleted."""
    path = _layer_upload(spark, sf)
    store = layers.LayerStore(spark, new_folder(spark, "layers"))
    store.create("Ward  Map #1!", path, NOW, label_field="name", multiline=False)
    second = store.create("Second", path, NOW, sort_type="natural", multiline=False)
    third = store.create("Third", path, NOW, multiline=False)
    store.replace(second, path, NOW, srid=3435, multiline=False, filename="second.geojson")
    store.set_active(second, False, NOW)
    store.delete(third)
    return store


@query
def layer_registry(spark, sf):
    rows = _layer_store(spark, sf).layers()
    return rows.select("id", "name", "slug", "geometry_type", "srid", "feature_count", "is_active",
                       "sort_type", "original_filename")


@query
def layer_feature_counts(spark, sf):
    return _layer_store(spark, sf).features().groupBy("layer_id").agg(
        F.count("*").alias("features"), F.count_distinct("id").alias("ids")
    )


@query
def layer_geometry(spark, sf):
    found = places.geometry_of_active_layer(_layer_store(spark, sf), 1, 5)
    return found.select("place_type", "place_id", "name", "geometry")


@query
def place_types(spark, sf):
    native = {"wards": view(spark, sf, "fx_zones"), "community_areas": view(spark, sf, "fx_areas"),
              "police_beats": view(spark, sf, "fx_beats").where("beat_num = 'none'")}
    return places.place_types(native, _layer_store(spark, sf).layers())


@query
def ward_items(spark, sf):
    return places.native_items(view(spark, sf, "fx_zones"), "wards")


@query
def community_items(spark, sf):
    return places.native_items(view(spark, sf, "fx_areas"), "community_areas")


@query
def layer_items_alphabetic(spark, sf):
    return places.layer_items(view(spark, sf, "fx_layer_features"))


@query
def layer_items_numeric(spark, sf):
    return places.layer_items(view(spark, sf, "fx_layer_features"), sort_type="numeric")


@query
def layer_items_natural(spark, sf):
    return places.layer_items(view(spark, sf, "fx_layer_features"), "title", sort_type="natural")


LISTED = 200


def _native_tables(spark, sf) -> dict[str, DataFrame]:
    names = {"wards": "fx_zones", "community_areas": "fx_areas", "house_districts": "fx_house",
             "senate_districts": "fx_senate", "police_beats": "fx_beats"}
    return {place_type: view(spark, sf, name) for place_type, name in names.items()}


@query
def native_place_items(spark, sf):
    """Listings of every native place type."""
    listed = [places.native_items(rows, t).withColumn("place_type", F.lit(t)) for t, rows in _native_tables(spark, sf).items()]
    return reduce(DataFrame.unionByName, listed)


@query
def native_report_names(spark, sf):
    """The name on a report of one place of every native type, found by its id as text."""
    found = [places.native_place(rows, t, "2").select("place_type", "place_id", "name") for t, rows in _native_tables(spark, sf).items()]
    return reduce(DataFrame.unionByName, found)


def _layer_page(sort_type: str):
    """The first page of a layer's listing with the place of each item, which shows the sort order."""

    def run(spark, sf):
        items = places.layer_items(view(spark, sf, "fx_layer_features"), sort_type=sort_type).limit(LISTED)
        order = Window.orderBy(*L.sort_columns("name", sort_type), "id")
        return items.select(F.row_number().over(order).alias("position"), "id", "name")

    run.__name__ = f"layer_page_{sort_type}"
    return run


for _sort_type in ("alphabetic", "numeric", "natural"):
    query(_layer_page(_sort_type))


@query
def layer_fields(spark, sf):
    profile = layers.profile_fields(view(spark, sf, "fx_layer_features"))
    return profile.select("name", F.array_join("sample_values", "|").alias("samples"), "suggested")


@query
def layer_field_names(spark, sf):
    return layers.field_names(view(spark, sf, "fx_layer_features"))


@query
def layer_sort_type(spark, sf):
    features = view(spark, sf, "fx_layer_features")
    detected = None
    for field in ("ward", "COMMUNITY", "name", "title"):
        row = layers.detect_sort_type(features, field).select(
            F.lit(field).alias("label_field"), "sort_type"
        )
        detected = row if detected is None else detected.unionByName(row)
    return detected


@query
def boundary_load(spark, sf):
    """A boundary file becomes a table with cleaned column names."""
    zones = _zone_boundaries(spark, sf)
    properties = F.to_json(F.struct(F.col("ward").alias("WARD"), F.col("ward_name").alias("Ward Name"),
                                    F.col("alderman").alias("ALDER-MAN")))
    feature = F.concat(F.lit('{"properties":'), properties, F.lit(',"geometry":'),
                       geo.geojson_from_polygons(F.col("polygons")), F.lit("}"))
    lines = zones.select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}")).alias("value")
    )
    source, target = new_folder(spark, "boundary"), new_folder(spark, "boundary-table")
    lines.write.text(source)
    geojson.load_boundary(spark, source, target, multiline=False)
    loaded = spark.read.parquet(target)
    return loaded.select("ward", "ward_name", "alder_man",
                         F.get_json_object("geometry", "$.type").alias("geometry_type"))


@query
def spatial_catalog(spark, sf):
    return catalog.list_tables(
        {
            "wards": catalog.SpatialTable(view(spark, sf, "fx_zones")),
            "community_areas": catalog.SpatialTable(view(spark, sf, "fx_areas")),
            "crashes": catalog.SpatialTable(view(spark, sf, "fx_crashes"), geometry_type="POINT"),
        }
    )


@query
def spatial_catalog_found(spark, sf):
    """Geometry types, dimensions and bounds as the tables themselves show them."""
    zones = _zone_boundaries(spark, sf)
    shape = geo.geojson_from_polygons(F.col("polygons"))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.col("polygons")[0][0][0].alias("coordinates")))
    text = F.when(F.col("ward") % 3 == 0, point).when(F.col("ward") % 3 == 1, shape)
    return catalog.describe_tables({
        "wards": zones, "crashes": view(spark, sf, "fx_crashes"), "areas": view(spark, sf, "fx_areas"),
        "layer": zones.select("ward", text.alias("geometry")),
    })


@query
def spatial_table_sample(spark, sf):
    zones = _zone_boundaries(spark, sf).select(
        "ward", "ward_name",
        F.concat(F.lit("MULTIPOLYGON of zone "), F.repeat("ward_name", F.lit(4))).alias("geometry"),
    )
    return catalog.sample_table(zones, 25, order_by="ward")


# -- operations --------------------------------------------------------------
@query
def job_history(spark, sf):
    rows = jobs.job_history(view(spark, sf, "fx_job_executions"), view(spark, sf, "fx_jobs"), limit=200)
    return times_as_text(
        rows.select("execution_id", "name", "job_type", "status", "started_at", "completed_at",
                    "records_processed")
    )


@query
def job_history_page(spark, sf):
    rows = jobs.job_history(view(spark, sf, "fx_job_executions"), view(spark, sf, "fx_jobs"),
                            job_id=3, limit=50, offset=50)
    return times_as_text(rows.select("execution_id", "name", "status", "started_at"))


@query
def job_summary(spark, sf):
    rows = jobs.job_summary(view(spark, sf, "fx_jobs"), view(spark, sf, "fx_job_executions"), JOBS_AS_OF)
    return times_as_text(rows)


@query
def latest_execution_per_job(spark, sf):
    return times_as_text(jobs.latest_execution_per_job(view(spark, sf, "fx_job_executions")))


@query
def job_durations(spark, sf):
    return view(spark, sf, "fx_job_executions").select(
        "execution_id", L.duration_seconds().alias("duration_seconds")
    )


@query
def run_metrics(spark, sf):
    """Append the metrics of one merge to the run log and read it back."""
    _, table, crashes = _loaded(spark, sf)
    counts = upsert(table, S.CRASHES, _amended(crashes), now=NOW)
    log = new_folder(spark, "job-executions")
    jobs.record_run(spark, log, "exec_a", 1, "completed", NOW, datetime(2001, 8, 2, 0, 1, 5),
                    counts.fetched, counts.inserted, counts.updated, counts.skipped)
    return times_as_text(spark.read.parquet(log))


# -- analyst queries ---------------------------------------------------------
@query
def fatalities_with_crashes(spark, sf):
    crashes = view(spark, sf, "fx_crashes")
    people = view(spark, sf, "fx_people")
    # Every fatal crash also has a person row that carries the fatality's id.
    linked = crashes.where("injuries_fatal > 0 AND crash_type <> 'REAR END'").select(
        "crash_record_id", F.concat(F.lit("F"), "crash_record_id").alias("person_id")
    )
    rows = documented.fatalities_with_crashes(
        view(spark, sf, "fx_fatalities"),
        people.select("crash_record_id", "person_id").unionByName(linked), crashes, AS_OF, days=1800,
    )
    return times_as_text(rows)


@query
def vehicle_occupants(spark, sf):
    rows = documented.vehicle_occupants(
        view(spark, sf, "fx_crashes"), view(spark, sf, "fx_vehicles"), view(spark, sf, "fx_people"),
        AS_OF, days=180,
    )
    return times_as_text(rows)
