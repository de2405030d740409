"""Table shapes, keys and fixed values.

Every table is described by one :class:`TableSpec`; readers, the sanitizers and the
merge operator are driven by it, so adding a dataset means adding one spec.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Bounds, column lists, unit costs and labels below must equal the published
# rules of the dashboard for its results to be reproduced.

MIN_LATITUDE, MAX_LATITUDE = 41.6, 42.1
MIN_LONGITUDE, MAX_LONGITUDE = -87.95, -87.5
MIN_AGE, MAX_AGE = 0, 120
MIN_VEHICLE_YEAR, MAX_VEHICLE_YEAR = 1900, 2025
BOUNDS_AREA = "Chicago"

NULL_TOKENS = ("NULL", "N/A", "UNKNOWN", "UNK")

CRASH_INTEGERS = (
    "injuries_total", "injuries_fatal", "injuries_incapacitating",
    "injuries_non_incapacitating", "injuries_reported_not_evident",
    "injuries_no_indication", "injuries_unknown", "posted_speed_limit",
    "street_no", "lane_cnt",
)
CRASH_STRINGS = (
    "crash_date_est_i", "traffic_control_device", "device_condition",
    "weather_condition", "lighting_condition", "street_direction", "street_name",
    "crash_type", "damage", "prim_contributory_cause", "sec_contributory_cause",
    "work_zone_i", "work_zone_type", "workers_present_i", "hit_and_run_i",
    "dooring_i", "intersection_related_i", "not_right_of_way_i", "alignment",
    "roadway_surface_cond", "road_defect", "report_type", "most_severe_injury",
    "beat_of_occurrence", "photos_taken_i", "statements_taken_i",
)
PERSON_STRINGS = (
    "person_type", "sex", "safety_equipment", "airbag_deployed", "ejection",
    "injury_classification", "hospital", "ems_agency", "ems_unit",
    "drivers_license_state", "drivers_license_class", "physical_condition",
    "pedpedal_action", "pedpedal_visibility", "pedpedal_location", "bac_result",
    "cell_phone_use",
)
PERSON_AREA_FLAGS = tuple(f"area_{n:02d}_i" for n in range(13))
VEHICLE_INTEGERS = ("num_passengers", "occupant_cnt")
VEHICLE_STRINGS = (
    "unit_type", "vehicle_id", "cmv_id", "make", "model", "lic_plate_state",
    "vehicle_defect", "vehicle_type", "vehicle_use", "travel_direction",
    "maneuver", "towed_i", "fire_i", "hazmat_placard_i", "hazmat_name",
    "hazmat_present_i", "first_contact_point",
)
FATALITY_TEXTS = ("crash_location", "crash_circumstances", "geocoded_column")

REQUIRED_FIELDS = {
    "crashes": ("crash_record_id", "crash_date"),
    "people": ("crash_record_id", "person_id"),
    "vehicles": ("crash_record_id", "unit_no"),
    "fatalities": ("person_id",),
}

# injury class: (label, economic unit cost, quality-of-life unit cost), dollars of 2024
INJURY_COSTS = {
    "FATAL": ("Fatal (K)", 1_606_644, 9_651_851),
    "INCAPACITATING INJURY": ("Incapacitating (A)", 172_179, 917_345),
    "NONINCAPACITATING INJURY": ("Non-incapacitating (B)", 44_490, 180_107),
    "REPORTED, NOT EVIDENT": ("Possible Injury (C)", 25_933, 85_348),
    "NO INDICATION OF INJURY": ("No Indication (O)", 0, 0),
}
INJURED_CLASSES = (
    "FATAL", "INCAPACITATING INJURY", "NONINCAPACITATING INJURY", "REPORTED, NOT EVIDENT",
)
VEHICLE_ECONOMIC_COST = 6_269
VEHICLE_QALY_COST = 3_927

FEET_TO_METERS = 0.3048
MAX_RADIUS_FEET = 26_400.0

MAP_POINT_COLUMNS = (
    "crash_record_id", "crash_date", "injuries_total", "injuries_fatal",
    "injuries_incapacitating", "hit_and_run_i", "crash_type", "street_name",
    "prim_contributory_cause",
)
MAP_LAYER_COLUMNS = {
    "crashes": MAP_POINT_COLUMNS + ("most_severe_injury", "dooring_i"),
    "vision_zero_fatalities": (
        "person_id", "crash_date", "victim", "crash_location", "crash_circumstances",
    ),
    "spatial_layer_features": ("layer_id", "properties"),
}

SEVERITIES = ("Fatal", "Incapacitating Injury", "Other Injury", "Property Damage Only")

# place type: (display name, key column)
NATIVE_PLACES = {
    "wards": ("Wards", "ward"),
    "community_areas": ("Community Areas", "area_numbe"),
    "house_districts": ("IL House Districts", "district"),
    "senate_districts": ("IL Senate Districts", "district"),
    "police_beats": ("Police Beats", "beat_num"),
}
# --- end of fixed values ----------------------------------------------------


#: What the version of a row is made of, most telling part first: the feed's own change stamp, the
#: landing sequence, the file it was landed in. Stored with the row, so that an older one never replaces it.
UPDATED_AT = ":updated_at"
CHANGED, SEQUENCE, LANDED = "_changed", "ingest_seq", "_landed"
VERSION = (CHANGED, SEQUENCE, LANDED)


@dataclass(frozen=True)
class TableSpec:
    """One warehouse table: columns, key, what a row must have to be stored."""

    name: str
    dataset: str
    ddl: str
    keys: tuple[str, ...]
    required: tuple[str, ...]
    has_point: bool = False
    audit_ddl: str = "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"

    @property
    def schema(self) -> T.StructType:
        """Declared columns, the two audit columns and the version of the stored row."""
        return T.StructType.fromDDL(f"{self.ddl}, {self.audit_ddl}, {CHANGED} STRING, {SEQUENCE} BIGINT, {LANDED} STRING")

    @property
    def columns(self) -> list[str]:
        """Declared columns without the audit columns."""
        return T.StructType.fromDDL(self.ddl).names


def _ddl(*parts: str) -> str:
    return ", ".join(parts)


def _typed(names: tuple[str, ...], sql_type: str) -> str:
    return ", ".join(f"{n} {sql_type}" for n in names)


CRASHES = TableSpec(
    name="crashes",
    dataset="crashes",
    ddl=_ddl(
        "crash_record_id STRING, crash_date TIMESTAMP_NTZ",
        "latitude DOUBLE, longitude DOUBLE",
        _typed(tuple(c for c in CRASH_INTEGERS if c != "street_no"), "INT"),
        "street_no STRING",
        _typed(CRASH_STRINGS, "STRING"),
        "date_police_notified TIMESTAMP_NTZ",
        "street_direction_2 STRING, street_name_2 STRING",
        "crash_record_id_original STRING, crash_date_original TIMESTAMP_NTZ",
    ),
    keys=("crash_record_id",),
    required=("crash_record_id", "crash_date"),
    has_point=True,
)

PEOPLE = TableSpec(
    name="crash_people",
    dataset="people",
    ddl=_ddl(
        "crash_record_id STRING, person_id STRING",
        "crash_date TIMESTAMP_NTZ, vehicle_id STRING, age INT",
        _typed(PERSON_STRINGS, "STRING"),
        "bac_result_value DOUBLE",
        _typed(PERSON_AREA_FLAGS, "STRING"),
        "driver_action STRING, driver_vision STRING",
    ),
    keys=("crash_record_id", "person_id"),
    required=("crash_record_id", "person_id"),
)

VEHICLES = TableSpec(
    name="crash_vehicles",
    dataset="vehicles",
    ddl=_ddl(
        "crash_unit_id STRING, crash_record_id STRING, unit_no STRING",
        "crash_date TIMESTAMP_NTZ, vehicle_year INT",
        _typed(VEHICLE_INTEGERS, "INT"),
        _typed(VEHICLE_STRINGS, "STRING"),
    ),
    keys=("crash_unit_id",),
    required=("crash_unit_id",),
)

FATALITIES = TableSpec(
    name="vision_zero_fatalities",
    dataset="fatalities",
    ddl=_ddl(
        "person_id STRING, rd_no STRING, crash_date TIMESTAMP_NTZ",
        "latitude DOUBLE, longitude DOUBLE",
        _typed(FATALITY_TEXTS, "STRING"),
        "victim STRING",
    ),
    keys=("person_id",),
    required=("person_id",),
    has_point=True,
)

TABLES = {spec.name: spec for spec in (CRASHES, PEOPLE, VEHICLES, FATALITIES)}
BY_DATASET = {spec.dataset: spec for spec in TABLES.values()}

# The report exports call the fatality table by this dataset name.
EXPORT_DATASETS = {
    "crashes": CRASHES,
    "people": PEOPLE,
    "vehicles": VEHICLES,
    "vision_zero": FATALITIES,
}

LAYER_DDL = (
    "id INT, name STRING, slug STRING, description STRING, geometry_type STRING, srid INT, "
    "feature_count BIGINT, original_filename STRING, is_active BOOLEAN, label_field STRING, "
    "sort_type STRING"
)
LAYER_FEATURE_DDL = "id BIGINT, layer_id INT, properties STRING, geometry STRING"
DELETION_LOG_DDL = (
    "table_name STRING, records_deleted BIGINT, deletion_criteria STRING, executed_by STRING, "
    "execution_time_seconds DOUBLE"
)
RUN_METRICS_DDL = (
    "execution_id STRING, job_id BIGINT, status STRING, started_at TIMESTAMP_NTZ, "
    "completed_at TIMESTAMP_NTZ, duration_seconds INT, records_processed BIGINT, "
    "records_inserted BIGINT, records_updated BIGINT, records_skipped BIGINT"
)


def raw_schema(spec: TableSpec) -> T.StructType:
    """Landing schema of a feed: every declared column as text."""
    names = [*spec.columns, SEQUENCE, UPDATED_AT]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
