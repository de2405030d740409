"""Reference SQL per registered query, run by DuckDB over the same Parquet tables.

Written from the definitions, not from the Spark plans: spatial predicates are spelled out
per edge or as rectangles, upserts as set operations, and cleaning with DuckDB's own parsers.
"""

from __future__ import annotations

from crashgrid import schemas as S
from crashgrid.checks.fixtures import WHOLE_DATES, WHOLE_RECORDS, with_views
from crashgrid.checks.queries import (
    AMENDED_FROM,
    AS_OF,
    CENTER,
    END,
    GRID_BOX,
    JOBS_AS_OF,
    LISTED,
    LOADED_BEFORE,
    NEAR_METERS,
    NOW,
    RING,
    START,
    STORED_WINDOW,
)
from crashgrid.schemas import INJURY_COSTS

ORACLES: dict[str, str] = {}

COUNTERS = """count(*) AS crashes, CAST(coalesce(sum(injuries_total), 0) AS BIGINT) AS injuries,
 CAST(coalesce(sum(injuries_fatal), 0) AS BIGINT) AS fatalities"""
IN_DATES = f"crash_date >= TIMESTAMP '{START}' AND crash_date < TIMESTAMP '{END}' + INTERVAL 1 DAY"
UNTIL_END = f"crash_date < TIMESTAMP '{END}' + INTERVAL 1 DAY"
POINT_COLUMNS = """crash_record_id, strftime(crash_date, '%Y-%m-%d %H:%M:%S') AS crash_date,
 injuries_total, injuries_fatal, injuries_incapacitating, hit_and_run_i, crash_type, street_name,
 prim_contributory_cause, longitude, latitude"""
PEDESTRIAN = "person_type ILIKE '%PEDESTRIAN%'"
CYCLIST = "(person_type ILIKE '%BICYCLE%' OR person_type ILIKE '%CYCLIST%' OR person_type ILIKE '%PEDALCYCLIST%')"


def text_time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def add(name: str, views: tuple[str, ...], body: str) -> None:
    """Register ``body``; it starts with SELECT or with further CTEs after a comma."""
    head = with_views(*views)
    ORACLES[name] = f"{head}\n{body}" if body.lstrip().startswith(",") else f"{head}\n{body.strip()}"


# -- dashboard ---------------------------------------------------------------
add("dashboard_stats", ("fx_crashes", "fx_people"), f"""
, c AS (SELECT * FROM fx_crashes WHERE {IN_DATES}), p AS (SELECT * FROM fx_people WHERE {IN_DATES})
SELECT (SELECT count(*) FROM c) AS total_crashes,
 (SELECT CAST(coalesce(sum(injuries_total), 0) AS BIGINT) FROM c) AS total_injuries,
 (SELECT CAST(coalesce(sum(injuries_fatal), 0) AS BIGINT) FROM c) AS total_fatalities,
 (SELECT count(*) FROM p WHERE {PEDESTRIAN}) AS pedestrians_involved,
 (SELECT count(*) FROM p WHERE {CYCLIST}) AS cyclists_involved,
 (SELECT count(*) FROM c WHERE hit_and_run_i = 'Y') AS hit_and_run_count""")

add("dashboard_stats_by_crash_date", ("fx_crashes", "fx_people"), f"""
, c AS (SELECT * FROM fx_crashes WHERE {IN_DATES}),
 p AS (SELECT person_type FROM fx_people JOIN c USING (crash_record_id))
SELECT (SELECT count(*) FROM c) AS total_crashes,
 (SELECT CAST(coalesce(sum(injuries_total), 0) AS BIGINT) FROM c) AS total_injuries,
 (SELECT CAST(coalesce(sum(injuries_fatal), 0) AS BIGINT) FROM c) AS total_fatalities,
 (SELECT count(*) FROM p WHERE {PEDESTRIAN}) AS pedestrians_involved,
 (SELECT count(*) FROM p WHERE {CYCLIST}) AS cyclists_involved,
 (SELECT count(*) FROM c WHERE hit_and_run_i = 'Y') AS hit_and_run_count""")

WEEKLY = f"""SELECT strftime(date_trunc('week', crash_date), '%Y-%m-%d') AS week, {COUNTERS}
FROM fx_crashes WHERE {{where}} GROUP BY date_trunc('week', crash_date) ORDER BY week"""
add("weekly_trends", ("fx_crashes",), WEEKLY.format(where="crash_date IS NOT NULL"))
add("weekly_trends_recent", ("fx_crashes",),
    WEEKLY.format(where=f"crash_date >= TIMESTAMP '{AS_OF}' - INTERVAL 182 DAY"))

add("crashes_by_hour", ("fx_crashes",), f"""
SELECT CAST(hour(crash_date) AS INT) AS hour, {COUNTERS} FROM fx_crashes WHERE {IN_DATES}
GROUP BY 1 ORDER BY 1""")

add("crashes_by_cause", ("fx_crashes",), f"""
SELECT prim_contributory_cause AS cause, {COUNTERS} FROM fx_crashes
WHERE prim_contributory_cause IS NOT NULL AND prim_contributory_cause <> '' AND {UNTIL_END}
GROUP BY 1 ORDER BY crashes DESC, cause LIMIT 10""")

NEWEST = "ORDER BY fx_crashes.crash_date DESC NULLS FIRST, crash_record_id"
add("crash_points", ("fx_crashes",), f"""
SELECT {POINT_COLUMNS} FROM fx_crashes
WHERE longitude IS NOT NULL AND latitude IS NOT NULL AND {IN_DATES} {NEWEST} LIMIT 10000""")

add("crashes_by_date_range", ("fx_crashes",), f"""
SELECT crash_record_id, {text_time('crash_date')} AS crash_date, longitude, latitude FROM fx_crashes
WHERE longitude IS NOT NULL AND latitude IS NOT NULL AND {IN_DATES}""")


def json_string(column: str) -> str:
    return f"coalesce(concat('\"', {column}, '\"'), 'null')"


add("crash_points_geojson", ("fx_crashes",), f"""
, newest AS (SELECT * FROM fx_crashes
 WHERE longitude IS NOT NULL AND latitude IS NOT NULL AND {IN_DATES} {NEWEST} LIMIT 10000)
SELECT crash_record_id, concat(
 '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[', CAST(longitude AS VARCHAR), ',',
 CAST(latitude AS VARCHAR), ']}},"properties":{{"crash_record_id":"', crash_record_id,
 '","crash_date":"', strftime(crash_date, '%Y-%m-%dT%H:%M:%S'), '","injuries_total":',
 CAST(coalesce(injuries_total, 0) AS VARCHAR), ',"injuries_fatal":', CAST(injuries_fatal AS VARCHAR),
 ',"injuries_incapacitating":', CAST(injuries_incapacitating AS VARCHAR), ',"hit_and_run_i":',
 CASE WHEN hit_and_run_i = 'Y' THEN 'true' ELSE 'false' END, ',"crash_type":', {json_string('crash_type')},
 ',"street_name":', {json_string('street_name')}, ',"primary_contributory_cause":',
 CASE WHEN prim_contributory_cause IS NULL THEN 'null'
      ELSE concat('"', prim_contributory_cause, '"') END, '}}}}') AS feature
FROM newest""")

SEVERITY = """CASE WHEN injuries_fatal > 0 THEN 'Fatal' WHEN injuries_incapacitating > 0 THEN 'Incapacitating Injury'
 WHEN coalesce(injuries_total, 0) > 0 THEN 'Other Injury' ELSE 'Property Damage Only' END"""
HIT_AND_RUN = "CASE WHEN hit_and_run_i = 'Y' THEN 'Hit and Run' ELSE 'Not Hit and Run' END"
CRASH_TYPE = """CASE crash_type WHEN 'PEDESTRIAN' THEN 'Pedestrian' WHEN 'PEDALCYCLIST' THEN 'Pedalcyclist'
 ELSE 'Other' END"""
for name, expression in (("severity_categories", SEVERITY), ("hit_and_run_categories", HIT_AND_RUN),
                         ("crash_type_categories", CRASH_TYPE)):
    add(name, ("fx_crashes",),
        f"SELECT {expression} AS category, {COUNTERS} FROM fx_crashes GROUP BY 1")

add("category_filter", ("fx_crashes",), f"""
SELECT crash_record_id, crash_type FROM fx_crashes
WHERE {SEVERITY} IN ('Fatal', 'Other Injury') AND {CRASH_TYPE} IN ('Pedestrian', 'Other')""")

add("crash_density_grid", ("fx_crashes",), f"""
SELECT CAST(floor(longitude / 0.01e0) AS BIGINT) AS cell_x,
 CAST(floor(latitude / 0.01e0) AS BIGINT) AS cell_y, {COUNTERS} FROM fx_crashes
WHERE longitude BETWEEN {GRID_BOX[0]}e0 AND {GRID_BOX[2]}e0
 AND latitude BETWEEN {GRID_BOX[1]}e0 AND {GRID_BOX[3]}e0 AND {IN_DATES} GROUP BY 1, 2""")

add("map_layer_crashes", ("fx_crashes",), f"""
SELECT crash_record_id, {text_time('crash_date')} AS crash_date, injuries_total, injuries_fatal,
 injuries_incapacitating, hit_and_run_i, crash_type, street_name, prim_contributory_cause,
 NULL::VARCHAR AS most_severe_injury, NULL::VARCHAR AS dooring_i FROM fx_crashes""")
add("map_layer_fatalities", ("fx_fatalities",), f"""
SELECT person_id, {text_time('crash_date')} AS crash_date, victim,
 NULL::VARCHAR AS crash_location, NULL::VARCHAR AS crash_circumstances FROM fx_fatalities""")
add("map_layer_features", ("fx_layer_features",), "SELECT layer_id, properties FROM fx_layer_features")

add("table_counts", ("fx_crashes", "fx_people", "fx_vehicles", "fx_fatalities"), """
, t AS (SELECT 'crashes' AS table_name, count(*) AS record_count FROM fx_crashes
 UNION ALL SELECT 'crash_people', count(*) FROM fx_people
 UNION ALL SELECT 'crash_vehicles', count(*) FROM fx_vehicles
 UNION ALL SELECT 'vision_zero_fatalities', count(*) FROM fx_fatalities)
SELECT * FROM t UNION ALL SELECT 'total', CAST(sum(record_count) AS BIGINT) FROM t""")

OUTLIERS = """, raw AS (SELECT ingest_seq, TRY_CAST(trim(latitude) AS DOUBLE) AS latitude,
 TRY_CAST(trim(longitude) AS DOUBLE) AS longitude FROM fx_raw_crashes),
 o AS (SELECT * FROM raw WHERE latitude IS NOT NULL
 AND (latitude NOT BETWEEN 41.6e0 AND 42.1e0 OR longitude NOT BETWEEN -87.95e0 AND -87.5e0))"""
add("coordinate_outliers", ("fx_raw_crashes",), f"""{OUTLIERS}
SELECT *, 'POINT(' || CAST(longitude AS VARCHAR) || ' ' || CAST(latitude AS VARCHAR) || ')' AS point
FROM o""")
add("coordinate_outlier_count", ("fx_raw_crashes",),
    f"{OUTLIERS} SELECT count(*) AS out_of_bounds_count FROM o")

# -- feeds -------------------------------------------------------------------
FEED = """, feed AS (SELECT crash_record_id, strftime(crash_date, '%Y-%m-%dT%H:%M:%S') AS crash_date,
 CAST(injuries_total AS VARCHAR) AS injuries_total, strftime(CAST(crash_date AS DATE) + 3, '%Y-%m-%dT%H:%M:%S') AS updated_at FROM fx_crashes)"""
add("feed_scan", ("fx_raw_crashes",), """
SELECT CAST(ingest_seq AS VARCHAR) AS ingest_seq, crash_record_id, latitude FROM fx_raw_crashes
WHERE latitude <> 'N/A'""")
add("feed_date_window", ("fx_crashes",), f"""{FEED}
SELECT crash_record_id, crash_date FROM feed
WHERE crash_date >= '1997-01-01T00:00:00' AND crash_date < '1999-12-31T23:59:59'""")
add("feed_updated_since", ("fx_crashes",), f"""{FEED}
SELECT crash_record_id, updated_at FROM feed WHERE updated_at > '1999-06-01T00:00:00'""")
add("feed_next_cursor", ("fx_crashes",), f"{FEED} SELECT max(updated_at) AS cursor FROM feed")
add("feed_page", ("fx_crashes",), f"""{FEED}
SELECT crash_record_id, crash_date FROM feed ORDER BY crash_date, crash_record_id
LIMIT 1000 OFFSET 3000""")
add("feed_page_after", ("fx_crashes",), f"""{FEED}
SELECT crash_record_id, crash_date FROM feed
WHERE crash_date > '1997-06-30T23:59:59' OR (crash_date = '1997-06-30T23:59:59' AND crash_record_id > '')
ORDER BY crash_date, crash_record_id LIMIT 1000""")
add("feed_count", ("fx_crashes",), f"""{FEED}
SELECT count(*) AS count FROM feed WHERE crash_date >= '1997-01-01T00:00:00'""")
WINDOWS = {
    ("last_30_days_crashes", "crashes"): "crash_date >= '2001-07-02T00:00:00' AND crash_date < '2001-08-01T23:59:59'",
    ("last_6_months_fatalities", "fatalities"): "crash_date >= '2001-02-02T00:00:00' AND crash_date < '2001-08-01T23:59:59'",
    ("some_other_job", "crashes"): "crash_date >= '2001-07-25T00:00:00' AND crash_date < '2001-08-01T23:59:59'",
    ("full_refresh", "crashes,people,vehicles,fatalities"): "TRUE",
    ("custom", "crashes"): "crash_date >= '2001-05-03T00:00:00' AND crash_date < '2001-07-15T23:59:59'",
}
add("job_window_counts", ("fx_crashes",), FEED + " UNION ALL ".join(
    f" SELECT '{job}' AS job_type, '{datasets}' AS datasets, count(*) FILTER ({inside}) AS fetched FROM feed"
    for (job, datasets), inside in WINDOWS.items()))
add("feed_dated_landing", ("fx_raw_crashes",), """
SELECT crash_record_id, crash_date, CAST(ingest_seq AS VARCHAR) AS ingest_seq FROM fx_raw_crashes
WHERE crash_date >= '1997-01-01T00:00:00' AND crash_date < '1999-12-31T23:59:59'""")
add("feed_sample", ("fx_crashes",), f"""{FEED}
SELECT crash_record_id, crash_date, injuries_total FROM feed ORDER BY crash_record_id LIMIT 100""")

# -- cleaning and validation -------------------------------------------------
SPACE = (r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
         r"\x{3000}]+")


def squeezed(column: str) -> str:
    return f"trim(regexp_replace({column}, '{SPACE}', ' ', 'g'))"


def cleaned(column: str) -> str:
    text = squeezed(column)
    return (f"CASE WHEN {text} <> '' AND upper({text}) NOT IN ('NULL', 'N/A', 'UNKNOWN', 'UNK') "
            f"THEN {text} END")


def number(column: str) -> str:
    return f"TRY_CAST(replace({squeezed(column)}, '_', '') AS DOUBLE)"


def integer(column: str) -> str:
    return f"CAST(trunc({number(column)}) AS INT)"


def bounded(value: str, low: float, high: float) -> str:
    return f"CASE WHEN {value} BETWEEN {low} AND {high} THEN {value} END"


def moment(column: str) -> str:
    text = squeezed(column)
    plain = ", ".join(
        f"try_strptime({text}, '{f}')"
        for f in ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%m/%d/%Y")
    )
    marked = (f"CASE WHEN regexp_matches({text}, ' [AP]M$') THEN "
              f"try_strptime(regexp_replace({text}, ' [AP]M$', ''), '%m/%d/%Y %H:%M:%S') END")
    return f"coalesce({plain}, {marked})"


LAT = bounded(number("latitude"), 41.6, 42.1)
LON = bounded(number("longitude"), -87.95, -87.5)
add("sanitize_crashes", ("fx_raw_crashes",), f"""
SELECT {cleaned('crash_record_id')} AS crash_record_id, {text_time(moment('crash_date'))} AS crash_date,
 {LAT} AS latitude, {LON} AS longitude, {integer('injuries_total')} AS injuries_total,
 {cleaned('street_name')} AS street_name, ingest_seq FROM fx_raw_crashes""")
add("sanitize_people", ("fx_raw_people",), f"""
SELECT {cleaned('crash_record_id')} AS crash_record_id, {cleaned('person_id')} AS person_id,
 {bounded(integer('age'), 0, 120)} AS age, {cleaned('person_type')} AS person_type,
 {number('bac_result_value')} AS bac_result_value, {cleaned('area_00_i')} AS area_00_i,
 {text_time(moment('crash_date'))} AS crash_date, {cleaned('vehicle_id')} AS vehicle_id
FROM fx_raw_people""")
add("sanitize_vehicles", ("fx_raw_vehicles",), f"""
SELECT {cleaned('crash_unit_id')} AS crash_unit_id, {cleaned('crash_record_id')} AS crash_record_id,
 {cleaned('unit_no')} AS unit_no, {bounded(integer('vehicle_year'), 1900, 2025)} AS vehicle_year,
 {integer('num_passengers')} AS num_passengers, {integer('occupant_cnt')} AS occupant_cnt,
 {cleaned('make')} AS make, {text_time(moment('crash_date'))} AS crash_date FROM fx_raw_vehicles""")
FATALITY = f"""SELECT {cleaned('person_id')} AS person_id, {cleaned('rd_no')} AS rd_no,
 {text_time(moment('crash_date'))} AS crash_date, {LAT} AS latitude, {LON} AS longitude,
 {cleaned('crash_location')} AS crash_location, {cleaned('victim')} AS victim, ingest_seq
FROM fx_raw_fatalities"""
add("sanitize_fatalities", ("fx_raw_fatalities",), FATALITY)
add("remove_duplicates", ("fx_raw_fatalities",), f"""
, c AS ({FATALITY}), r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY ingest_seq) AS n
 FROM c WHERE person_id IS NOT NULL AND person_id <> '')
SELECT person_id, rd_no, latitude, crash_location, victim, ingest_seq FROM r WHERE n = 1""")
BY_KIND = {
    "latitude": lambda c: bounded(number(c), 41.6, 42.1), "longitude": lambda c: bounded(number(c), -87.95, -87.5),
    "age": lambda c: bounded(integer(c), 0, 120), "vehicle_year": lambda c: bounded(integer(c), 1900, 2025),
    "bac_result_value": number, **dict.fromkeys((*S.CRASH_INTEGERS, *S.VEHICLE_INTEGERS), integer),
}
for dataset, (_, _, _, columns) in WHOLE_RECORDS.items():
    fields = [f"{BY_KIND.get(c, cleaned)(c)} AS {c}" for c in columns]
    fields += [f"{text_time(moment(c))} AS {c}" for c in WHOLE_DATES[dataset]]
    add(f"sanitize_{dataset}_whole", (f"fx_whole_{dataset}",), f"SELECT {', '.join(fields)} FROM fx_whole_{dataset}")
ORACLES["clean_text"] = f"""
SELECT doc_id, md5({cleaned('text')}) AS digest, CAST(length({cleaned('text')}) AS INT) AS n
FROM documents"""

CHECKED = """, v AS (SELECT ingest_seq,
 concat_ws('; ', CASE WHEN coalesce(crash_record_id, '') = '' THEN 'Missing required field: crash_record_id' END,
  CASE WHEN coalesce(crash_date, '') = '' THEN 'Missing required field: crash_date' END) AS errors,
 CASE WHEN coalesce(latitude, '') = '' OR coalesce(longitude, '') = '' THEN '' ELSE concat_ws('; ',
  CASE WHEN lat IS NULL THEN concat('Latitude ', latitude, ' is not a number') WHEN lat <> 0 AND (lat < 41.6e0 OR lat > 42.1e0) THEN concat('Latitude ', CAST(lat AS VARCHAR), ' outside Chicago bounds') END,
  CASE WHEN lon IS NULL THEN concat('Longitude ', longitude, ' is not a number') WHEN lon <> 0 AND (lon < -87.95e0 OR lon > -87.5e0) THEN concat('Longitude ', CAST(lon AS VARCHAR), ' outside Chicago bounds') END)
 END AS warnings
 FROM (SELECT *, TRY_CAST(trim(latitude) AS DOUBLE) AS lat, TRY_CAST(trim(longitude) AS DOUBLE) AS lon
       FROM fx_raw_crashes) x)"""
add("validate_raw_crashes", ("fx_raw_crashes",), f"""{CHECKED}
SELECT ingest_seq, errors = '' AS valid, errors, warnings FROM v""")
MESSAGES = """CASE WHEN {c} = '' THEN 0 ELSE 1 + length({c}) - length(replace({c}, ';', '')) END"""
add("validation_summary", ("fx_raw_crashes",), f"""{CHECKED}
SELECT count(*) AS total_records, count(*) FILTER (errors = '') AS valid_records,
 count(*) FILTER (errors <> '') AS invalid_records,
 CAST(sum({MESSAGES.format(c='errors')}) AS BIGINT) AS total_errors,
 CAST(sum({MESSAGES.format(c='warnings')}) AS BIGINT) AS total_warnings FROM v""")
add("validation_messages", ("fx_raw_crashes",), f"""
SELECT ingest_seq, 'error' AS level, 'Missing required field: crash_record_id' AS message
FROM fx_raw_crashes WHERE {cleaned('crash_record_id')} IS NULL
UNION ALL SELECT ingest_seq, 'error', 'Missing required field: crash_date'
FROM fx_raw_crashes WHERE {moment('crash_date')} IS NULL""")

# -- spatial -----------------------------------------------------------------
A, E2 = "6378137e0", "0.0066943799901413165e0"


def meters(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    w2 = f"(1 - {E2} * pow(sin(radians(({lat1} + {lat2}) / 2)), 2))"
    north = f"{A} * (1 - {E2}) / pow({w2}, 1.5e0) * radians({lat2} - {lat1})"
    east = f"{A} / sqrt({w2}) * cos(radians(({lat1} + {lat2}) / 2)) * radians({lon2} - {lon1})"
    return f"sqrt(pow({north}, 2) + pow({east}, 2))"


FROM_CENTER = meters("longitude", "latitude", f"{CENTER.longitude}e0", f"{CENTER.latitude}e0")
IN_RADIUS = f"longitude IS NOT NULL AND {FROM_CENTER} <= {CENTER.radius_feet}e0 * 0.3048e0"


def ring_edges(vertices) -> str:
    closed = [*vertices, vertices[0]]
    rows = ", ".join(f"({x1}e0, {y1}e0, {x2}e0, {y2}e0)" for (x1, y1), (x2, y2) in zip(closed, closed[1:]))
    return f"SELECT * FROM (VALUES {rows}) AS e(x1, y1, x2, y2)"


CROSSES = """((e.y1 > c.latitude) <> (e.y2 > c.latitude)) AND
 c.longitude < (e.x2 - e.x1) * (c.latitude - e.y1) / nullif(e.y2 - e.y1, 0e0) + e.x1"""
TOUCHES = """(e.x2 - e.x1) * (c.latitude - e.y1) - (e.y2 - e.y1) * (c.longitude - e.x1) = 0e0
 AND c.longitude BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
 AND c.latitude BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)"""
INSIDE = f"count(*) FILTER ({CROSSES}) % 2 = 1 AND count(*) FILTER ({TOUCHES}) = 0"
PLACE_EDGES = """, e AS (SELECT place_id, lon AS x1, lat AS y1,
 lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM fx_rings WINDOW w AS (PARTITION BY place_id, ring_no ORDER BY seq))"""


def in_ring(alias: str = "region") -> str:
    return f""", e AS ({ring_edges(RING)}), {alias} AS (SELECT c.crash_record_id FROM fx_crashes c, e
 WHERE c.longitude IS NOT NULL GROUP BY c.crash_record_id HAVING {INSIDE})"""


def in_place(place_id: str, alias: str = "region") -> str:
    return f"""{PLACE_EDGES}, {alias} AS (SELECT c.crash_record_id FROM fx_crashes c, e
 WHERE e.place_id = '{place_id}' AND e.x2 IS NOT NULL AND c.longitude IS NOT NULL
 GROUP BY c.crash_record_id HAVING {INSIDE})"""


add("crashes_in_radius", ("fx_crashes",), f"""
SELECT crash_record_id, round({FROM_CENTER}, 2) AS meters FROM fx_crashes WHERE {IN_RADIUS}""")
add("crashes_in_polygon", ("fx_crashes",), f"""{in_ring()}
SELECT crash_record_id, longitude, latitude FROM fx_crashes JOIN region USING (crash_record_id)""")
add("crashes_in_place", ("fx_crashes", "fx_rings"), f"""{in_place('D')}
SELECT crash_record_id, longitude, latitude FROM fx_crashes JOIN region USING (crash_record_id)""")

MATCHED = f"""{PLACE_EDGES}, m AS (SELECT e.place_id, c.crash_record_id FROM fx_crashes c, e
 WHERE e.x2 IS NOT NULL AND c.longitude IS NOT NULL
 GROUP BY e.place_id, c.crash_record_id HAVING {INSIDE})"""
add("crashes_per_place", ("fx_crashes", "fx_rings"), f"""{MATCHED}
SELECT place_id, count(*) AS crash_count FROM m GROUP BY 1""")
add("beat_hotspots", ("fx_crashes", "fx_rings"), f"""{MATCHED}
SELECT place_id AS beat, count(*) AS crash_count FROM m GROUP BY 1
ORDER BY crash_count DESC, beat LIMIT 10""")
add("crashes_per_zone", ("fx_crashes", "fx_zones"), """
SELECT ward, count(*) AS crash_count FROM fx_crashes JOIN fx_zones
ON longitude > min_lon AND longitude < max_lon AND latitude > min_lat AND latitude < max_lat
GROUP BY 1""")


def zone_json() -> str:
    def pair(lon: str, lat: str) -> str:
        return f"'[', CAST({lon} AS VARCHAR), ',', CAST({lat} AS VARCHAR), ']'"

    corners = (("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"),
               ("min_lon", "max_lat"), ("min_lon", "min_lat"))
    ring = ", ',', ".join(pair(*c) for c in corners)
    return f"concat('{{\"type\":\"MultiPolygon\",\"coordinates\":[[[', {ring}, ']]]}}')"


add("place_lookup", ("fx_zones",), f"""
SELECT 'wards' AS place_type, '42' AS place_id, 'Ward 42' AS name, {zone_json()} AS geometry
FROM fx_zones WHERE CAST(ward AS VARCHAR) = '42'""")
add("layer_place_lookup", ("fx_layer_features",), """
SELECT 'layer:1' AS place_type, '66' AS place_id,
 json_extract_string(properties, '$.name') AS name, CAST(4 AS INT) AS edge_count
FROM fx_layer_features WHERE id = 66""")
add("nearest_place", ("fx_zones",), """
, d AS (SELECT ward, ward_name, sqrt(
 pow(greatest(min_lon - (-87.6298e0), 0e0, -87.6298e0 - max_lon), 2) +
 pow(greatest(min_lat - 42.1781e0, 0e0, 42.1781e0 - max_lat), 2)) AS distance FROM fx_zones)
SELECT ward, ward_name, round(distance, 9) AS distance FROM d ORDER BY d.distance, ward LIMIT 1""")
SITE_METERS = meters("longitude", "latitude", "site_longitude", "site_latitude")
add("crashes_near_sites", ("fx_crashes", "fx_sites"), f"""
SELECT crash_record_id, {text_time('crash_date')} AS crash_date, street_name, latitude, longitude,
 signal_id, signal_street, round({SITE_METERS}, 2) AS distance_meters
FROM fx_crashes, fx_sites WHERE longitude IS NOT NULL AND {SITE_METERS} <= {NEAR_METERS}e0
ORDER BY fx_crashes.crash_date DESC, crash_record_id, signal_id LIMIT 1000""")
add("all_crashes_near_sites", ("fx_crashes", "fx_sites"), f"""
SELECT crash_record_id, {text_time('crash_date')} AS crash_date, street_name, latitude, longitude,
 signal_id, signal_street, round({SITE_METERS}, 2) AS distance_meters
FROM fx_crashes, fx_sites WHERE longitude IS NOT NULL AND {SITE_METERS} <= {NEAR_METERS}e0""")
add("radius_area", ("fx_sites",), """
SELECT signal_id, CAST(n AS INT) AS n,
 round(site_longitude + 1e0 / (111e0 * cos(radians(site_latitude))) * cos((n % 64) / 64e0 * 2e0 * pi()), 9) AS lon,
 round(site_latitude + 1e0 / 111e0 * sin((n % 64) / 64e0 * 2e0 * pi()), 9) AS lat
FROM fx_sites, range(65) AS r(n)""")
add("wkt_round_trip", ("fx_crashes",), """
SELECT crash_record_id, longitude, latitude FROM fx_crashes WHERE longitude IS NOT NULL""")

add("crash_geometry", ("fx_crashes",), """
SELECT crash_record_id, CASE WHEN longitude IS NOT NULL AND latitude IS NOT NULL THEN
 concat('{"lon":', CAST(longitude AS VARCHAR), ',"lat":', CAST(latitude AS VARCHAR), '}') END AS point
FROM fx_crashes""")

# -- location report ---------------------------------------------------------
KABCO = list(INJURY_COSTS)
IS_PDO = "coalesce(injuries_total, 0) = 0 AND coalesce(injuries_fatal, 0) = 0"


def class_count(injury: str) -> str:
    return f"(SELECT count(*) FROM p WHERE injury_classification = '{injury}')"


def report_ctes(region: str, dates: str) -> str:
    """``region`` defines crash ids; the report CTEs are c, p and v."""
    return f"""{region}, c AS (SELECT * FROM fx_crashes JOIN region USING (crash_record_id) WHERE {dates}),
 p AS (SELECT person_type, age, injury_classification FROM fx_people JOIN c USING (crash_record_id)),
 v AS (SELECT {IS_PDO} AS pdo FROM fx_vehicles JOIN c USING (crash_record_id))"""


BY_RADIUS = f", region AS (SELECT crash_record_id FROM fx_crashes WHERE {IN_RADIUS})"
REPORT_VIEWS = ("fx_crashes", "fx_people", "fx_vehicles")
PDO = "(SELECT count(*) FROM v WHERE pdo)"
ECONOMIC = " + ".join(f"{class_count(k)} * {e}" for k, (_, e, _q) in INJURY_COSTS.items())
SOCIETAL = " + ".join(f"{class_count(k)} * {e + q}" for k, (_, e, q) in INJURY_COSTS.items())
STATS = f"""SELECT (SELECT count(*) FROM c) AS total_crashes,
 (SELECT CAST(coalesce(sum(injuries_total), 0) AS BIGINT) FROM c) AS total_injuries,
 (SELECT CAST(coalesce(sum(injuries_fatal), 0) AS BIGINT) FROM c) AS total_fatalities,
 (SELECT count(*) FROM p WHERE {PEDESTRIAN}) AS pedestrians_involved,
 (SELECT count(*) FROM p WHERE {CYCLIST}) AS cyclists_involved,
 (SELECT count(*) FROM c WHERE hit_and_run_i = 'Y') AS hit_and_run_count,
 (SELECT CAST(coalesce(sum(injuries_incapacitating), 0) AS BIGINT) FROM c) AS incapacitating_injuries,
 (SELECT count(*) FROM p WHERE age >= 0 AND age < 18 AND injury_classification IN
  ('FATAL', 'INCAPACITATING INJURY', 'NONINCAPACITATING INJURY', 'REPORTED, NOT EVIDENT')) AS children_injured,
 (SELECT count(*) FROM c WHERE injuries_total > 0) AS crashes_with_injuries,
 (SELECT count(*) FROM c WHERE injuries_fatal > 0) AS crashes_with_fatalities,
 CAST({ECONOMIC} + {PDO} * 6269 AS BIGINT) AS estimated_economic_damages,
 CAST({SOCIETAL} + {PDO} * 10196 AS BIGINT) AS estimated_societal_costs,
 (SELECT count(*) FROM v) AS total_vehicles,
 (SELECT count(*) FROM p WHERE injury_classification IS NULL OR injury_classification NOT IN
  ({', '.join(f"'{k}'" for k in KABCO)})) AS unknown_injury_count"""
add("report_stats_radius", REPORT_VIEWS, f"{report_ctes(BY_RADIUS, IN_DATES)}\n{STATS}")
add("report_stats_polygon", REPORT_VIEWS, f"{report_ctes(in_ring(), 'TRUE')}\n{STATS}")
add("report_stats_place", (*REPORT_VIEWS, "fx_rings"),
    report_ctes(in_place("L"), f"crash_date >= TIMESTAMP '{START}'") + "\n" + STATS)

LINES = " UNION ALL ".join(
    f"SELECT '{k}' AS classification, '{label}' AS classification_label, {class_count(k)} AS count, "
    f"CAST({e} AS BIGINT) AS unit_economic_cost, CAST({q} AS BIGINT) AS unit_qaly_cost"
    for k, (label, e, q) in INJURY_COSTS.items()
) + f" UNION ALL SELECT 'VEHICLES', 'Vehicles', {PDO}, CAST(6269 AS BIGINT), CAST(3927 AS BIGINT)"
BREAKDOWN = f"""{report_ctes(BY_RADIUS, IN_DATES)}, lines AS ({LINES}),
 b AS (SELECT *, count * unit_economic_cost AS subtotal_economic,
 count * (unit_economic_cost + unit_qaly_cost) AS subtotal_societal FROM lines)"""
add("report_cost_breakdown", REPORT_VIEWS, f"{BREAKDOWN} SELECT * FROM b")
add("report_person_subtotals", REPORT_VIEWS, f"""{BREAKDOWN}
SELECT CAST(sum(count) AS BIGINT) AS person_count, CAST(sum(subtotal_economic) AS BIGINT) AS person_economic_total,
 CAST(sum(subtotal_societal) AS BIGINT) AS person_societal_total FROM b WHERE classification <> 'VEHICLES'""")

add("report_causes", ("fx_crashes",), f"""{BY_RADIUS}, c AS (SELECT * FROM fx_crashes JOIN region USING (crash_record_id)),
 g AS (SELECT coalesce(nullif(prim_contributory_cause, ''), 'UNKNOWN') AS cause, {COUNTERS} FROM c GROUP BY 1),
 t AS (SELECT count(*) AS n FROM c)
SELECT cause, crashes, injuries, fatalities,
 ((2000 * crashes + n) - (2000 * crashes + n) % (2 * n)) / (2 * n) / 10e0 AS percentage,
 CASE WHEN cause = 'UNKNOWN' THEN 'Unknown / Not Reported' ELSE array_to_string(list_transform(
  string_split(lower(cause), ' '), lambda w: concat(upper(substr(w, 1, 1)), substr(w, 2))), ' ') END AS label
FROM g, t ORDER BY crashes DESC, cause LIMIT 15""")
MONTHS = f"""{BY_RADIUS}, m AS (SELECT strftime(crash_date, '%Y-%m') AS month, {COUNTERS}
 FROM fx_crashes JOIN region USING (crash_record_id)
 WHERE crash_date >= TIMESTAMP '{AS_OF}' - INTERVAL 12 MONTH GROUP BY 1)"""
add("report_monthly_trends", ("fx_crashes",), f"""{MONTHS}
SELECT *, strftime(CAST(concat(month, '-01') AS DATE), '%b %y') AS label FROM m ORDER BY month""")
add("report_monthly_averages", ("fx_crashes",), f"""{MONTHS}
SELECT CAST(floor(sum(crashes) / count(*) + 0.5e0) AS BIGINT) AS avg_crashes,
 CAST(floor(sum(injuries) / count(*) + 0.5e0) AS BIGINT) AS avg_injuries,
 CAST(sum(fatalities) AS BIGINT) AS total_fatalities FROM m""")
add("report_points", ("fx_crashes",), f"""{in_ring()}
SELECT {POINT_COLUMNS} FROM fx_crashes JOIN region USING (crash_record_id) {NEWEST} LIMIT 5000""")

WKT = "concat('POINT(', CAST(longitude AS VARCHAR), ' ', CAST(latitude AS VARCHAR), ')') AS geometry"
EXPORTED = f", c AS (SELECT * FROM fx_crashes WHERE {IN_RADIUS} AND {IN_DATES})"


def as_text(*columns: str) -> str:
    return ", ".join(f"nullif(CAST({c} AS VARCHAR), '') AS {c}" for c in columns)


add("export_crashes", ("fx_crashes",), f"""{EXPORTED}
SELECT {text_time('crash_date')} AS crash_date, {as_text('crash_record_id', 'latitude', 'longitude',
 'injuries_total', 'injuries_fatal', 'injuries_incapacitating', 'hit_and_run_i', 'crash_type', 'street_name')},
 nullif(prim_contributory_cause, '') AS prim_contributory_cause, {WKT} FROM c""")
add("export_people", ("fx_crashes", "fx_people"), f"""{EXPORTED}
SELECT {text_time('crash_date')} AS crash_date, {as_text('crash_record_id', 'person_id', 'vehicle_id',
 'person_type', 'age', 'injury_classification')}
FROM fx_people WHERE crash_record_id IN (SELECT crash_record_id FROM c)""")
add("export_vehicles", ("fx_crashes", "fx_vehicles"), f"""{EXPORTED}
SELECT {as_text('crash_unit_id', 'crash_record_id', 'unit_no', 'vehicle_id', 'unit_type', 'vehicle_year',
 'occupant_cnt')} FROM fx_vehicles WHERE crash_record_id IN (SELECT crash_record_id FROM c)""")
add("export_vision_zero", ("fx_fatalities",), f"""
SELECT {text_time('crash_date')} AS crash_date, {as_text('person_id', 'rd_no', 'victim', 'latitude', 'longitude')},
 {WKT} FROM fx_fatalities WHERE {IN_RADIUS} AND {IN_DATES}""")

# -- merge, purge, sync ------------------------------------------------------
LOADED = f"SELECT * FROM fx_crashes WHERE crash_date < TIMESTAMP '{LOADED_BEFORE}'"
AMENDED = f"SELECT * FROM fx_crashes WHERE crash_date >= TIMESTAMP '{AMENDED_FROM}'"
NEW_ROW = "fx_crashes.crash_date >= TIMESTAMP '" + str(LOADED_BEFORE) + "'"
IN_BATCH = "fx_crashes.crash_date >= TIMESTAMP '" + str(AMENDED_FROM) + "'"
add("upsert_crashes", ("fx_crashes",), f"""
SELECT crash_record_id, {text_time('crash_date')} AS crash_date,
 CASE WHEN {IN_BATCH} THEN injuries_total + 1 ELSE injuries_total END AS injuries_total,
 CASE WHEN {NEW_ROW} THEN NULL ELSE injuries_fatal END AS injuries_fatal,
 CASE WHEN {NEW_ROW} THEN NULL ELSE hit_and_run_i END AS hit_and_run_i,
 CASE WHEN {NEW_ROW} THEN NULL ELSE street_name END AS street_name,
 CASE WHEN {NEW_ROW} THEN '{NOW}' ELSE '{AMENDED_FROM}' END AS created_at,
 CASE WHEN {IN_BATCH} THEN '{NOW}' ELSE '{AMENDED_FROM}' END AS updated_at FROM fx_crashes""")
add("upsert_counts", ("fx_crashes",), f"""
, l AS ({LOADED}), a AS ({AMENDED})
SELECT 2 * (SELECT count(*) FROM a) AS fetched,
 (SELECT count(*) FROM a WHERE crash_record_id NOT IN (SELECT crash_record_id FROM l)) AS inserted,
 (SELECT count(*) FROM a WHERE crash_record_id IN (SELECT crash_record_id FROM l)) AS updated,
 (SELECT count(*) FROM a) AS skipped, CAST(0 AS BIGINT) AS repeated""")
add("merge_people", ("fx_people",), f"""
SELECT crash_record_id, person_id, CASE WHEN person_type = 'PASSENGER' THEN age + 1 ELSE age END AS age,
 person_type, CASE WHEN person_type = 'PASSENGER' THEN '{NOW}' ELSE '{START}' END AS updated_at
FROM fx_people""")
add("stored_date_window", ("fx_crashes",), f"""
, l AS ({LOADED})
SELECT crash_record_id, {text_time('crash_date')} AS crash_date, injuries_total, street_name FROM l
WHERE crash_date >= TIMESTAMP '{STORED_WINDOW[0]}' AND crash_date < TIMESTAMP '{STORED_WINDOW[1]}' + INTERVAL 1 DAY""")
PURGED = "crash_date >= TIMESTAMP '1997-03-10' AND crash_date <= TIMESTAMP '1998-11-20'"
add("purge_crashes", ("fx_crashes",), f"""
, l AS ({LOADED})
SELECT crash_record_id, {text_time('crash_date')} AS crash_date, street_name FROM l WHERE NOT ({PURGED})""")
add("purge_log", ("fx_crashes",), f"""
, l AS ({LOADED})
SELECT 'crashes' AS table_name, (SELECT count(*) FROM l WHERE {PURGED}) AS records_deleted,
 '{{"start": "1997-03-10", "end": "1998-11-20"}}' AS deletion_criteria, 'admin' AS executed_by
UNION ALL SELECT 'crashes', (SELECT count(*) FROM l WHERE NOT ({PURGED})), '{{}}', 'admin'""")
add("sync_crashes", ("fx_raw_crashes",), f"""
, s AS (SELECT {cleaned('crash_record_id')} AS crash_record_id, {text_time(moment('crash_date'))} AS crash_date,
 {LAT} AS latitude, {LON} AS longitude, {integer('injuries_total')} AS injuries_total FROM fx_raw_crashes)
SELECT *, 'AMENDED ST' AS street_name, '{NOW}' AS created_at FROM s
WHERE crash_record_id IS NOT NULL AND crash_date IS NOT NULL""")
USABLE = f""", s AS (SELECT {cleaned('crash_record_id')} AS crash_record_id, {text_time(moment('crash_date'))} AS crash_date,
 {integer('injuries_total')} AS injuries_total, ingest_seq AS k FROM fx_raw_crashes),
 u AS (SELECT * FROM s WHERE crash_record_id IS NOT NULL AND crash_date IS NOT NULL)"""
add("sync_incremental", ("fx_raw_crashes",), f"""{USABLE}
SELECT crash_record_id, crash_date, injuries_total,
 concat('v', CAST(CASE WHEN k % 2 = 0 THEN 2 ELSE greatest(k % 3, (k + 1) % 3) END AS VARCHAR), ' st') AS street_name FROM u""")
add("sync_unsequenced", ("fx_raw_crashes",), f"""{USABLE}
SELECT crash_record_id, crash_date, injuries_total,
 CASE k % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'third' ELSE 'second' END AS street_name FROM u""")
add("sync_progress", ("fx_raw_crashes",), f"""{USABLE},
 t AS (SELECT (SELECT count(*) FROM s) AS rows, (SELECT count(*) FROM s WHERE k % 2 = 0) AS even_rows,
  (SELECT count(*) FROM u) AS good, (SELECT count(*) FROM u WHERE k % 2 = 0) AS even_good)
SELECT 'crashes' AS dataset, CAST(0 AS BIGINT) AS batch_id, even_rows AS fetched, even_good AS inserted,
 CAST(0 AS BIGINT) AS updated, even_rows - even_good AS skipped, CAST(0 AS BIGINT) AS repeated FROM t
UNION ALL SELECT 'crashes', 1, rows, good - even_good, even_good, rows - good, 0 FROM t
UNION ALL SELECT 'crashes', 2, rows, 0, 0, rows - good, good FROM t""")
add("sync_totals", ("fx_raw_people",), f"""
, w AS (SELECT {cleaned('person_id')} AS person_id FROM fx_raw_people
 WHERE crash_date >= '1997-01-01T00:00:00' AND crash_date < '1999-12-31T23:59:59')
SELECT 'people' AS dataset, count(*) AS fetched, count(*) FILTER (person_id IS NULL) AS skipped,
 count(person_id) AS usable FROM w""")
add("run_metrics", ("fx_crashes",), f"""
, l AS ({LOADED}), a AS ({AMENDED})
SELECT 'exec_a' AS execution_id, CAST(1 AS BIGINT) AS job_id, 'completed' AS status, '{NOW}' AS started_at,
 '2001-08-02 00:01:05' AS completed_at, CAST(65 AS INT) AS duration_seconds,
 (SELECT count(*) FROM a) AS records_processed,
 (SELECT count(*) FROM a WHERE crash_record_id NOT IN (SELECT crash_record_id FROM l)) AS records_inserted,
 (SELECT count(*) FROM a WHERE crash_record_id IN (SELECT crash_record_id FROM l)) AS records_updated,
 CAST(0 AS BIGINT) AS records_skipped""")

# -- layers and places -------------------------------------------------------
UPLOADED = ", u AS (SELECT * FROM fx_layer_features WHERE id % 10 <> 9)"
add("geojson_features", ("fx_layer_features",), f"""{UPLOADED}
SELECT properties, 'MultiPolygon' AS geometry_type, count(*) AS features,
 'MULTIPOLYGON' AS layer_type, (SELECT count(*) FROM u) AS layer_features FROM u GROUP BY 1""")
add("layer_registry", ("fx_layer_features",), f"""{UPLOADED}
SELECT CAST(1 AS INT) AS id, 'Ward  Map #1!' AS name, 'ward-map-1' AS slug, 'MULTIPOLYGON' AS geometry_type,
 CAST(4326 AS INT) AS srid, (SELECT count(*) FROM u) AS feature_count, TRUE AS is_active,
 (SELECT CASE WHEN avg(CASE WHEN regexp_matches(n, '[0-9]') THEN 1e0 ELSE 0e0 END) >= 0.8e0
   THEN 'numeric' ELSE 'alphabetic' END FROM (SELECT json_extract_string(properties, '$.name') AS n
   FROM u) q WHERE n IS NOT NULL) AS sort_type,
 NULL AS original_filename
UNION ALL SELECT 2, 'Second', 'second', 'MULTIPOLYGON', 3435, (SELECT count(*) FROM u), FALSE, 'natural',
 'second.geojson'""")
add("layer_feature_counts", ("fx_layer_features",), f"""{UPLOADED}
SELECT CAST(layer AS INT) AS layer_id, (SELECT count(*) FROM u) AS features, (SELECT count(*) FROM u) AS ids
FROM (VALUES (1), (2)) AS t(layer)""")
# The fifth feature of the upload is customer 4; layer 1 is labelled by "name", which it lacks.
add("layer_geometry", ("fx_layer_features", "fx_zones"), f"""
SELECT 'layer:1' AS place_type, '5' AS place_id, json_extract_string(properties, '$.title') AS name,
 {zone_json()} AS geometry FROM fx_layer_features JOIN fx_zones ON ward = id WHERE id = 4""")
add("place_types", ("fx_zones", "fx_areas", "fx_layer_features"), f"""{UPLOADED}
SELECT 'wards' AS id, 'Wards' AS name, 'native' AS source, count(*) AS feature_count FROM fx_zones
UNION ALL SELECT 'community_areas', 'Community Areas', 'native', count(*) FROM fx_areas
UNION ALL SELECT 'layer:1', 'Ward  Map #1!', 'uploaded', count(*) FROM u""")
add("ward_items", ("fx_zones",), """
SELECT CAST(ward AS VARCHAR) AS id, concat('Ward ', CAST(ward AS VARCHAR)) AS name,
 CASE WHEN coalesce(alderman, '') = '' THEN concat('Ward ', CAST(ward AS VARCHAR))
  ELSE concat('Ward ', CAST(ward AS VARCHAR), ' - ', alderman) END AS display_name FROM fx_zones""")
add("community_items", ("fx_areas",), """
, n AS (SELECT CAST(area_numbe AS VARCHAR) AS id,
 coalesce(nullif(community, ''), concat('Area ', CAST(area_numbe AS VARCHAR))) AS name FROM fx_areas)
SELECT id, name, name AS display_name FROM n""")
NATIVE = ("fx_zones", "fx_areas", "fx_house", "fx_senate", "fx_beats")
HELD = "concat({name}, CASE WHEN coalesce({holder}, '') = '' THEN '' ELSE concat(' - ', {holder}) END)"
WARD, DISTRICT = "concat('Ward ', CAST(ward AS VARCHAR))", "concat('District ', district)"
AREA = "coalesce(nullif(community, ''), concat('Area ', CAST(area_numbe AS VARCHAR)))"
add("native_place_items", NATIVE, f"""
SELECT 'wards' AS place_type, CAST(ward AS VARCHAR) AS id, {WARD} AS name, {HELD.format(name=WARD, holder='alderman')} AS display_name FROM fx_zones
UNION ALL SELECT 'community_areas', CAST(area_numbe AS VARCHAR), {AREA}, {AREA} FROM fx_areas
UNION ALL SELECT 'house_districts', district, {DISTRICT}, {HELD.format(name=DISTRICT, holder='rep_name')} FROM fx_house
UNION ALL SELECT 'senate_districts', district, {DISTRICT}, {HELD.format(name=DISTRICT, holder='senator_name')} FROM fx_senate
UNION ALL SELECT 'police_beats', beat_num, concat('Beat ', beat_num), concat('Beat ', beat_num) FROM fx_beats""")
add("native_report_names", NATIVE, """
SELECT 'wards' AS place_type, '2' AS place_id, 'Ward 2' AS name FROM fx_zones WHERE ward = 2
UNION ALL SELECT 'community_areas', '2', community FROM fx_areas WHERE area_numbe = 2
UNION ALL SELECT 'house_districts', '2', 'House District 2' FROM fx_house WHERE district = '2'
UNION ALL SELECT 'senate_districts', '2', 'Senate District 2' FROM fx_senate WHERE district = '2'
UNION ALL SELECT 'police_beats', '2', 'Police Beat 2' FROM fx_beats WHERE beat_num = '2'""")
NAMED = """, n AS (SELECT CAST(id AS VARCHAR) AS id, {label} CASE CAST(id AS BIGINT) % 6
 WHEN 0 THEN json_extract_string(properties, '$.name')
 WHEN 1 THEN concat('Ward ', CAST(CAST(CAST(json_extract_string(properties, '$.ward') AS DOUBLE) AS BIGINT) AS VARCHAR))
 WHEN 2 THEN json_extract_string(properties, '$.COMMUNITY')
 WHEN 3 THEN concat('Feature ', json_extract_string(properties, '$.objectid'))
 WHEN 4 THEN json_extract_string(properties, '$.title') ELSE concat('Feature ', CAST(id AS VARCHAR)) END {end} AS name
 FROM fx_layer_features)
SELECT id, name, name AS display_name FROM n"""
for name in ("layer_items_alphabetic", "layer_items_numeric", "layer_items_natural"):
    add(name, ("fx_layer_features",), NAMED.format(label="", end=""))
PARTS = r"string_split_regex(lower(name), '\d+')"
RUNS = r"list_transform(regexp_extract_all(name, '\d+'), lambda x: ltrim(x, '0'))"
ORDERS = {
    "alphabetic": "lower(name), name, id",
    "numeric": r"coalesce(TRY_CAST(nullif(regexp_extract(name, '\d+'), '') AS DOUBLE), 'inf'::DOUBLE), name, id",
    "natural": ", ".join(f"coalesce({PARTS}[{i}], ''), coalesce(length({RUNS}[{i}]), -1), {RUNS}[{i}]" for i in (1, 2, 3)) + ", name, id",
}
for name, order in ORDERS.items():
    add(f"layer_page_{name}", ("fx_layer_features",), NAMED.format(label="", end="").replace(
        "SELECT id, name, name AS display_name FROM n",
        f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INT) AS position, id, name FROM n QUALIFY position <= {LISTED}"))
EVERY = ", f AS (SELECT * FROM fx_layer_features)"
KEYS = """, k AS (SELECT id, unnest(json_keys(properties)) AS name, properties FROM f),
 kv AS (SELECT id, name, json_extract_string(properties, concat('$."', name, '"')) AS value FROM k),
 d AS (SELECT name, value, min(id) AS id FROM kv WHERE value IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM d)"""
add("layer_fields", ("fx_layer_features",), f"""{EVERY}{KEYS}
SELECT name, string_agg(value, '|' ORDER BY n) AS samples, name = 'name' AS suggested
FROM r WHERE n <= 3 GROUP BY name""")
add("layer_field_names", ("fx_layer_features",), """
SELECT DISTINCT unnest(json_keys(properties)) AS name FROM fx_layer_features""")
add("layer_sort_type", ("fx_layer_features",), f"""{EVERY}
, l AS (SELECT label_field, json_extract_string(properties, concat('$."', label_field, '"')) AS v
 FROM f, (VALUES ('ward'), ('COMMUNITY'), ('name'), ('title')) AS t(label_field))
SELECT label_field, CASE WHEN avg(CASE WHEN regexp_matches(v, '[0-9]') THEN 1e0 ELSE 0e0 END) >= 0.8e0
 THEN 'numeric' ELSE 'alphabetic' END AS sort_type FROM l WHERE v IS NOT NULL GROUP BY 1""")
add("boundary_load", ("fx_zones",), """
SELECT CAST(ward AS BIGINT) AS ward, ward_name, alderman AS alder_man, 'MultiPolygon' AS geometry_type FROM fx_zones""")
add("spatial_catalog", ("fx_zones", "fx_areas", "fx_crashes"), """
SELECT t AS table_name, 'geometry' AS geometry_column, CAST(2 AS INT) AS dimensions, CAST(4326 AS INT) AS srid,
 g AS geometry_type, n AS record_count FROM (
 SELECT 'wards' AS t, 'MULTIPOLYGON' AS g, count(*) AS n FROM fx_zones
 UNION ALL SELECT 'community_areas', 'MULTIPOLYGON', count(*) FROM fx_areas
 UNION ALL SELECT 'crashes', 'POINT', count(*) FROM fx_crashes) x ORDER BY 1""")
add("spatial_catalog_found", ("fx_zones", "fx_crashes"), """
, x AS (SELECT 'wards' AS t, 'polygons' AS c, 'MULTIPOLYGON' AS g, min_lon AS a, min_lat AS b, max_lon AS x, max_lat AS y FROM fx_zones
 UNION ALL SELECT 'crashes', 'longitude, latitude', CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 'POINT' END,
  longitude, latitude, longitude, latitude FROM fx_crashes
 UNION ALL SELECT 'layer', 'geometry', CASE ward % 3 WHEN 0 THEN 'POINT' WHEN 1 THEN 'MULTIPOLYGON' END,
  CASE WHEN ward % 3 < 2 THEN min_lon END, CASE WHEN ward % 3 < 2 THEN min_lat END,
  CASE ward % 3 WHEN 0 THEN min_lon WHEN 1 THEN max_lon END, CASE ward % 3 WHEN 0 THEN min_lat WHEN 1 THEN max_lat END FROM fx_zones)
SELECT t AS table_name, c AS geometry_column, CASE WHEN count(DISTINCT g) = 1 THEN max(g) ELSE 'GEOMETRY' END AS geometry_type,
 CAST(2 AS INT) AS dimensions, min(a) AS min_lon, min(b) AS min_lat, max(x) AS max_lon, max(y) AS max_lat,
 count(g) AS located, count(*) AS record_count FROM x GROUP BY t, c""")
add("spatial_table_sample", ("fx_zones",), """
SELECT ward, ward_name, concat('<geometry: ', substr(concat('MULTIPOLYGON of zone ', repeat(ward_name, 4)), 1, 50), '...>') AS geometry
FROM fx_zones ORDER BY ward LIMIT 25""")

# -- operations --------------------------------------------------------------
HISTORY = f"""SELECT execution_id, name, {{extra}} status, {text_time('started_at')} AS started_at
FROM fx_job_executions e JOIN fx_jobs j ON j.id = e.job_id {{where}}
ORDER BY e.started_at DESC NULLS FIRST, execution_id LIMIT {{limit}}"""
RUN_COLUMNS = f"job_type, {text_time('completed_at')} AS completed_at, records_processed,"
add("job_history", ("fx_job_executions", "fx_jobs"), HISTORY.format(extra=RUN_COLUMNS, where="", limit=200))
add("job_history_page", ("fx_job_executions", "fx_jobs"),
    HISTORY.format(extra="", where="WHERE e.job_id = 3", limit="50 OFFSET 50"))
add("job_summary", ("fx_job_executions", "fx_jobs"), f"""
SELECT (SELECT count(*) FROM fx_jobs) AS total_jobs, (SELECT count(*) FROM fx_jobs WHERE enabled) AS active_jobs,
 count(*) FILTER (status = 'running') AS running_jobs,
 count(*) FILTER (status = 'failed' AND started_at >= TIMESTAMP '{JOBS_AS_OF}' - INTERVAL 24 HOUR) AS failed_jobs_24h,
 {text_time('max(started_at)')} AS last_execution FROM fx_job_executions""")
add("latest_execution_per_job", ("fx_job_executions",), f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC, execution_id DESC) AS n,
 count(*) FILTER (status = 'running') OVER (PARTITION BY job_id) > 0 AS already_running FROM fx_job_executions)
SELECT job_id, execution_id, status, {text_time('started_at')} AS started_at, already_running FROM r WHERE n = 1""")
add("job_durations", ("fx_job_executions",), """
SELECT execution_id, CAST(date_sub('second', started_at, completed_at) AS INT) AS duration_seconds
FROM fx_job_executions""")

# -- analyst queries ---------------------------------------------------------
add("fatalities_with_crashes", ("fx_fatalities",), f"""
, linked AS (SELECT crash_record_id, concat('F', crash_record_id) AS person_id FROM fx_crashes
 WHERE injuries_fatal > 0 AND crash_type <> 'REAR END')
SELECT f.person_id, victim, {text_time('f.crash_date')} AS crash_date, crash_record_id,
 CASE WHEN longitude IS NOT NULL THEN concat('{{"type":"Point","coordinates":[', CAST(longitude AS VARCHAR), ',',
  CAST(latitude AS VARCHAR), ']}}') END AS geom
FROM fx_fatalities f LEFT JOIN linked USING (person_id)
WHERE f.crash_date >= TIMESTAMP '{AS_OF}' - INTERVAL 1800 DAY""")
add("vehicle_occupants", ("fx_crashes", "fx_people", "fx_vehicles"), f"""
, v AS (SELECT * FROM fx_vehicles JOIN (SELECT crash_record_id, crash_date, prim_contributory_cause FROM fx_crashes
 WHERE crash_date >= DATE '2001-08-01' - INTERVAL 180 DAY) c USING (crash_record_id)),
 o AS (SELECT vehicle_id, person_type, person_id, injury_classification FROM fx_people)
SELECT crash_record_id, {text_time('crash_date')} AS crash_date, prim_contributory_cause, vehicle_id, unit_type,
 person_type, person_id, concat('{{"person_id":', coalesce('"' || person_id || '"', 'null'), ',"person_type":',
  coalesce('"' || person_type || '"', 'null'), ',"injury":',
  coalesce('"' || injury_classification || '"', 'null'), '}}') AS occupant
FROM v LEFT JOIN o USING (vehicle_id)""")
