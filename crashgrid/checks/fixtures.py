"""Views that shape the generic test tables into the crash-warehouse schemas.

Every view is one SELECT that Spark and DuckDB both accept; ``$name`` stands for a base
table. Arithmetic is on integers up to one explicit cast, so values agree bit for bit.
"""

from __future__ import annotations

import re
from string import Template

from pyspark.sql import DataFrame, SparkSession

from crashgrid import schemas as S

VIEWS: dict[str, str] = {}

VIEWS["fx_crashes"] = """
SELECT concat('C', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS crash_record_id,
       CAST(o_orderdate AS TIMESTAMP) + ((o_orderkey * 7) % 24) * INTERVAL '1' HOUR
         + ((o_orderkey * 13) % 60) * INTERVAL '1' MINUTE AS crash_date,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL
            ELSE 41.6e0 + CAST((o_orderkey * 7919) % 5000 AS DOUBLE) / 1e4 END AS latitude,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL
            ELSE -87.95e0 + CAST((o_orderkey * 104729) % 4500 AS DOUBLE) / 1e4 END AS longitude,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL
            ELSE CAST((CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END)
                    + (CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 ELSE 0 END) AS INT)
            END AS injuries_total,
       CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS injuries_fatal,
       CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 2 THEN 1 ELSE 0 END AS injuries_incapacitating,
       CASE WHEN o_orderkey % 4 = 0 THEN 'Y' WHEN o_orderkey % 4 = 1 THEN 'N' END AS hit_and_run_i,
       CASE WHEN o_orderkey % 6 = 0 THEN 'PEDESTRIAN' WHEN o_orderkey % 6 = 1 THEN 'PEDALCYCLIST'
            ELSE 'REAR END' END AS crash_type,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN ''
            ELSE o_orderpriority END AS prim_contributory_cause,
       concat('STREET ', CAST(o_custkey % 50 AS STRING)) AS street_name
FROM $orders
"""

VIEWS["fx_people"] = """
SELECT concat('C', lpad(CAST(l_orderkey AS STRING), 8, '0')) AS crash_record_id,
       concat('P', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
              CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',
              CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS person_id,
       CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS TIMESTAMP) END AS crash_date,
       concat('V', CAST(l_orderkey AS STRING), '-', CAST(l_suppkey % 3 AS STRING)) AS vehicle_id,
       CASE l_linenumber WHEN 1 THEN 'DRIVER' WHEN 2 THEN 'PASSENGER' WHEN 3 THEN 'PEDESTRIAN'
            WHEN 4 THEN 'BICYCLE' WHEN 5 THEN 'Pedalcyclist' WHEN 6 THEN 'NON-MOTOR VEHICLE'
            END AS person_type,
       CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(l_partkey % 90 AS INT) END AS age,
       CASE (l_partkey + l_linenumber) % 9 WHEN 0 THEN 'FATAL' WHEN 1 THEN 'INCAPACITATING INJURY'
            WHEN 2 THEN 'NONINCAPACITATING INJURY' WHEN 3 THEN 'REPORTED, NOT EVIDENT'
            WHEN 7 THEN 'OTHER' WHEN 8 THEN NULL ELSE 'NO INDICATION OF INJURY'
            END AS injury_classification
FROM $lineitem
"""

VIEWS["fx_vehicles"] = """
SELECT concat('U', CAST(l_orderkey AS STRING), '-', CAST(l_suppkey % 3 AS STRING)) AS crash_unit_id,
       concat('C', lpad(CAST(l_orderkey AS STRING), 8, '0')) AS crash_record_id,
       CAST(l_suppkey % 3 AS STRING) AS unit_no,
       concat('V', CAST(l_orderkey AS STRING), '-', CAST(l_suppkey % 3 AS STRING)) AS vehicle_id,
       CASE l_suppkey % 3 WHEN 0 THEN 'DRIVER' WHEN 1 THEN 'PARKED' ELSE 'BICYCLE' END AS unit_type,
       CAST(1990 + max(l_partkey) % 40 AS INT) AS vehicle_year,
       CAST(count(*) AS INT) AS occupant_cnt
FROM $lineitem GROUP BY l_orderkey, l_suppkey % 3
"""

VIEWS["fx_fatalities"] = """
SELECT concat('F', crash_record_id) AS person_id,
       concat('RD', substr(crash_record_id, 2)) AS rd_no, crash_date,
       CASE WHEN crash_type = 'PEDESTRIAN' THEN 'PEDESTRIAN'
            WHEN crash_type = 'PEDALCYCLIST' THEN 'BICYCLIST' ELSE 'DRIVER' END AS victim,
       latitude, longitude
FROM fx_crashes WHERE injuries_fatal > 0
"""

VIEWS["fx_beats"] = """
SELECT CAST(n_nationkey AS STRING) AS beat_num, n_name AS beat,
       CAST(n_regionkey AS STRING) AS district,
       -87.95e0 + 0.09e0 * (n_nationkey % 5) AS min_lon,
       -87.95e0 + 0.09e0 * (n_nationkey % 5 + 1) AS max_lon,
       41.6e0 + 0.1e0 * ((n_nationkey - n_nationkey % 5) / 5) AS min_lat,
       41.6e0 + 0.1e0 * ((n_nationkey - n_nationkey % 5) / 5 + 1) AS max_lat
FROM $nation
"""

VIEWS["fx_rings"] = """
SELECT beat_num AS place_id, 0 AS ring_no, 0 AS seq, min_lon AS lon, min_lat AS lat FROM fx_beats
UNION ALL SELECT beat_num, 0, 1, max_lon, min_lat FROM fx_beats
UNION ALL SELECT beat_num, 0, 2, max_lon, max_lat FROM fx_beats
UNION ALL SELECT beat_num, 0, 3, min_lon, max_lat FROM fx_beats
UNION ALL SELECT beat_num, 0, 4, min_lon, min_lat FROM fx_beats
UNION ALL SELECT * FROM (VALUES
  ('L', 0, 0, -87.80e0, 41.70e0), ('L', 0, 1, -87.60e0, 41.70e0), ('L', 0, 2, -87.60e0, 41.80e0),
  ('L', 0, 3, -87.70e0, 41.80e0), ('L', 0, 4, -87.70e0, 41.95e0), ('L', 0, 5, -87.80e0, 41.95e0),
  ('L', 0, 6, -87.80e0, 41.70e0),
  ('D', 0, 0, -87.85e0, 41.75e0), ('D', 0, 1, -87.55e0, 41.75e0), ('D', 0, 2, -87.55e0, 42.00e0),
  ('D', 0, 3, -87.85e0, 42.00e0), ('D', 0, 4, -87.85e0, 41.75e0),
  ('D', 1, 0, -87.75e0, 41.80e0), ('D', 1, 1, -87.65e0, 41.80e0), ('D', 1, 2, -87.65e0, 41.90e0),
  ('D', 1, 3, -87.75e0, 41.90e0), ('D', 1, 4, -87.75e0, 41.80e0)
) AS v(place_id, ring_no, seq, lon, lat)
"""

# One small, overlapping rectangle per customer: a boundary set that grows with the data.
VIEWS["fx_zones"] = """
SELECT CAST(c_custkey AS INT) AS ward, concat('Zone ', c_name) AS ward_name,
       CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS alderman,
       -87.95e0 + CAST((c_custkey * 7919) % 4400 AS DOUBLE) / 1e4 AS min_lon,
       -87.95e0 + CAST((c_custkey * 7919) % 4400 + 40 + c_custkey % 60 AS DOUBLE) / 1e4 AS max_lon,
       41.6e0 + CAST((c_custkey * 104729) % 4900 AS DOUBLE) / 1e4 AS min_lat,
       41.6e0 + CAST((c_custkey * 104729) % 4900 + 30 + c_custkey % 70 AS DOUBLE) / 1e4 AS max_lat
FROM $customer
"""

VIEWS["fx_areas"] = """
SELECT CAST(p_partkey AS INT) AS area_numbe,
       CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS community
FROM $part
"""

VIEWS["fx_house"] = """
SELECT CAST(s_suppkey AS STRING) AS district,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS rep_name
FROM $supplier
"""

VIEWS["fx_senate"] = """
SELECT CAST(p_partkey AS STRING) AS district,
       CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS senator_name
FROM $part
"""

VIEWS["fx_sites"] = """
SELECT s_suppkey AS signal_id, s_name AS signal_street,
       -87.95e0 + CAST((s_suppkey * 31337) % 4500 AS DOUBLE) / 1e4 AS site_longitude,
       41.6e0 + CAST((s_suppkey * 27644437) % 5000 AS DOUBLE) / 1e4 AS site_latitude
FROM $supplier
"""

VIEWS["fx_raw_crashes"] = """
SELECT CASE WHEN o_orderkey % 53 = 0 THEN '  ' WHEN o_orderkey % 59 = 0 THEN 'unknown'
            ELSE concat(' C', lpad(CAST(o_orderkey AS STRING), 8, '0')) END AS crash_record_id,
       CASE o_orderkey % 7 WHEN 0 THEN 'invalid-date'
            WHEN 1 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T12:30:00.000')
            WHEN 2 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 01:02:03')
            WHEN 3 THEN '01/02/2024 01:30:00 PM' WHEN 4 THEN '' WHEN 5 THEN '3/4/2021'
            ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS crash_date,
       CASE o_orderkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN '50.0' WHEN 2 THEN '41.6'
            ELSE ' 41.8781 ' END AS latitude,
       CASE o_orderkey % 6 WHEN 0 THEN '-95.0' WHEN 1 THEN NULL WHEN 2 THEN '-87.5'
            ELSE '-87.6298' END AS longitude,
       CASE o_orderkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '1.9' WHEN 2 THEN 'not-a-number'
            WHEN 3 THEN '-1.7' ELSE '' END AS injuries_total,
       CASE o_orderkey % 4 WHEN 0 THEN '  A   B  ' WHEN 1 THEN 'UNK' WHEN 2 THEN 'null'
            ELSE 'MICHIGAN AVE' END AS street_name,
       o_orderkey AS ingest_seq
FROM $orders
"""

VIEWS["fx_raw_people"] = """
SELECT concat(' C', lpad(CAST(l_orderkey AS STRING), 8, '0'), ' ') AS crash_record_id,
       CASE WHEN l_partkey % 31 = 0 THEN 'N/A' ELSE concat('P', CAST(l_orderkey AS STRING), '-',
            CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) END AS person_id,
       CASE l_partkey % 6 WHEN 0 THEN CAST(l_partkey % 130 AS STRING) WHEN 1 THEN '-5'
            WHEN 2 THEN '35.9' WHEN 3 THEN 'invalid' WHEN 4 THEN ' 12 '
            ELSE CAST(l_suppkey % 120 AS STRING) END AS age,
       CASE l_linenumber WHEN 1 THEN ' DRIVER ' WHEN 2 THEN 'NON-MOTOR   VEHICLE'
            WHEN 3 THEN 'Unknown' ELSE 'PASSENGER' END AS person_type,
       CASE l_suppkey % 4 WHEN 0 THEN '0.08' WHEN 1 THEN '1e-2' WHEN 2 THEN 'unk' END AS bac_result_value,
       CASE l_suppkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN '' ELSE 'N' END AS area_00_i,
       CASE WHEN l_partkey % 3 = 0 THEN NULL
            ELSE concat(CAST(CAST(l_shipdate AS DATE) AS STRING), 'T08:15:30') END AS crash_date,
       concat('V', CAST(l_orderkey AS STRING), '-', CAST(l_suppkey % 3 AS STRING)) AS vehicle_id
FROM $lineitem
"""

VIEWS["fx_raw_vehicles"] = """
SELECT concat('U', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
              CAST(l_partkey AS STRING)) AS crash_unit_id,
       concat('C', lpad(CAST(l_orderkey AS STRING), 8, '0')) AS crash_record_id,
       CAST(l_linenumber AS STRING) AS unit_no,
       CASE l_partkey % 5 WHEN 0 THEN '1800' WHEN 1 THEN '2030' WHEN 2 THEN 'invalid'
            ELSE CAST(1950 + l_partkey % 75 AS STRING) END AS vehicle_year,
       CASE l_suppkey % 3 WHEN 0 THEN '1.0' WHEN 1 THEN '+2' ELSE '1_0' END AS num_passengers,
       CASE l_suppkey % 4 WHEN 0 THEN 'NULL' WHEN 1 THEN '3' ELSE '.5' END AS occupant_cnt,
       CASE l_partkey % 4 WHEN 0 THEN 'FORD   MOTOR  CO' WHEN 1 THEN 'n/a' ELSE ' HONDA' END AS make,
       CAST(CAST(l_shipdate AS DATE) AS STRING) AS crash_date
FROM $lineitem
"""

# Two landings of every fatal record: the second repeats the key with another victim text.
VIEWS["fx_raw_fatalities"] = """
SELECT concat(' F', CAST(o_orderkey AS STRING)) AS person_id,
       concat('RD', CAST(o_orderkey AS STRING)) AS rd_no,
       concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T00:05:00') AS crash_date,
       '41.9' AS latitude, '-87.7' AS longitude,
       concat('  ', o_orderpriority, '   corner ') AS crash_location, 'DRIVER' AS victim,
       o_orderkey AS ingest_seq
FROM $orders
UNION ALL
SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'UNKNOWN' ELSE concat('F', CAST(o_orderkey AS STRING)) END,
       'N/A', concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T00:05:00'), '0', '-87.7', NULL,
       'PASSENGER', o_orderkey + 1000000000
FROM $orders
"""

VIEWS["fx_job_executions"] = """
SELECT concat('exec_', CAST(event_id AS STRING)) AS execution_id, event_id % 5 + 1 AS job_id,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running'
            ELSE 'completed' END AS status,
       ts AS started_at, ts + CAST(round(value) AS INT) * INTERVAL '1' SECOND AS completed_at,
       user_id * 100 AS records_processed
FROM $events
"""

VIEWS["fx_jobs"] = """
SELECT CAST(user_id AS BIGINT) AS id, concat('Job ', CAST(user_id AS STRING)) AS name,
       CASE WHEN user_id % 2 = 0 THEN 'custom' ELSE 'full_refresh' END AS job_type,
       user_id % 3 <> 0 AS enabled
FROM (SELECT DISTINCT user_id FROM $events) u
"""

# Features of an uploaded layer, one per customer, in five property styles. Beyond the first hundred come a
# property of its own and titles without a digit.
VIEWS["fx_layer_features"] = """
SELECT CAST(c_custkey AS BIGINT) AS id, 1 AS layer_id,
       CASE c_custkey % 6
            WHEN 0 THEN concat('{"name":"Ward ', CAST(c_custkey AS STRING), '","rank":"', CAST(c_custkey AS STRING), '"}')
            WHEN 1 THEN concat('{"ward":', CAST(c_custkey AS STRING), '.0}')
            WHEN 2 THEN concat('{"COMMUNITY":"', c_mktsegment, '"}')
            WHEN 3 THEN concat('{"name":"","district":0,"objectid":', CAST(c_custkey AS STRING), '}')
            WHEN 4 THEN CASE WHEN c_custkey > 120 THEN '{"title":"item b"}'
                 ELSE concat('{"title":"item', CAST(c_custkey % 30 AS STRING), ' b', CAST(c_custkey AS STRING), '"}') END
            ELSE CASE WHEN c_custkey > 120 THEN concat('{"late":"', c_mktsegment, '"}') ELSE '{}' END END AS properties
FROM $customer
"""

# Raw records with every field a feed can have; each text comes in every field sooner or later.
WHOLE_RECORDS = {
    "crashes": ("orders", "o_orderkey", "o_orderdate", [
        "crash_record_id", "latitude", "longitude", *S.CRASH_INTEGERS, *S.CRASH_STRINGS]),
    "people": ("lineitem", "l_orderkey + 7 * l_linenumber", "l_shipdate", [
        "crash_record_id", "person_id", "vehicle_id", "age", "bac_result_value", *S.PERSON_STRINGS, *S.PERSON_AREA_FLAGS]),
    "vehicles": ("lineitem", "l_partkey + 3 * l_linenumber", "l_shipdate", [
        "crash_unit_id", "crash_record_id", "unit_no", "vehicle_year", *S.VEHICLE_INTEGERS, *S.VEHICLE_STRINGS]),
    "fatalities": ("orders", "o_custkey + o_orderkey", "o_orderdate", [
        "person_id", "rd_no", "latitude", "longitude", *S.FATALITY_TEXTS, "victim"]),
}
WHOLE_DATES = {"crashes": ("crash_date", "date_police_notified"), "people": ("crash_date",), "vehicles": ("crash_date",),
               "fatalities": ("crash_date",)}
_TEXTS = ("' 12 '", "'3.9'", "'UNK'", "'null'", "'  A   B  '", "''", "NULL", "'41.75'", "'-87.6'", "'1999'", "'+1_0e1'",
          "'n/a'", "'ZONE 5'")


def _whole_record(base: str, key: str, day: str, columns: list[str], dates: tuple[str, ...]) -> str:
    def text(i: int) -> str:
        cases = " ".join(f"WHEN {n} THEN {t}" for n, t in enumerate(_TEXTS))
        return f"CASE ({key} + {i}) % {len(_TEXTS)} {cases} END"

    def moment(i: int) -> str:
        plain = f"CAST(CAST({day} AS DATE) AS STRING)"
        return (f"CASE ({key} + {i}) % 5 WHEN 0 THEN concat(' ', {plain}, 'T12:30:00.000') WHEN 1 THEN {plain} "
                f"WHEN 2 THEN '01/02/2024 01:30:00 PM' WHEN 3 THEN concat({plain}, ' 25:00:00') ELSE 'UNKNOWN' END")

    fields = [f"{text(i)} AS {name}" for i, name in enumerate(columns)]
    fields += [f"{moment(i)} AS {name}" for i, name in enumerate(dates)]
    return f"SELECT {', '.join(fields)} FROM ${base}"


for _dataset, (_base, _key, _day, _columns) in WHOLE_RECORDS.items():
    VIEWS[f"fx_whole_{_dataset}"] = _whole_record(_base, _key, _day, _columns, WHOLE_DATES[_dataset])

_BASE = re.compile(r"\$(\w+)")
_VIEW = re.compile(r"\b(fx_\w+)\b")


def _dependencies(name: str) -> list[str]:
    """Views a view is built on, innermost first, without itself."""
    needed: list[str] = []
    for inner in dict.fromkeys(_VIEW.findall(VIEWS[name])):
        for item in (*_dependencies(inner), inner):
            if item not in needed:
                needed.append(item)
    return needed


def with_views(*names: str) -> str:
    """WITH clause for DuckDB that defines the named views and what they need."""
    ordered: list[str] = []
    for name in names:
        for item in (*_dependencies(name), name):
            if item not in ordered:
                ordered.append(item)
    bodies = [f"{n} AS ({_BASE.sub(lambda m: m.group(1), VIEWS[n]).strip()})" for n in ordered]
    return "WITH " + ",\n".join(bodies)


# Views that a benchmark has written out as tables, by scale factor and name.
_STORED: dict[tuple[str, str], str] = {}


def store_views(spark: SparkSession, sf_dir: str, folder: str, files: int) -> None:
    """Load every view into Parquet, as a warehouse would hold it, and read that from now on."""
    for name in VIEWS:
        path = f"{folder}/{name}"
        view(spark, sf_dir, name).repartition(files).write.parquet(path)
        _STORED[sf_dir, name] = path


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame over the Parquet tables of one scale factor."""
    if (sf_dir, name) in _STORED:
        return spark.read.parquet(_STORED[sf_dir, name])
    tables = {
        base: f"parquet.`{sf_dir.rstrip('/')}/{base}.parquet`"
        for n in (*_dependencies(name), name)
        for base in _BASE.findall(VIEWS[n])
    }
    inner = [f"{n} AS ({VIEWS[n].strip()})" for n in _dependencies(name)]
    head = "WITH " + ",\n".join(inner) + "\n" if inner else ""
    sql = Template(head + VIEWS[name]).substitute(tables)
    return spark.sql(sql.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)"))
