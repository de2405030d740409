from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crashgrid import schemas as S
from crashgrid.functions import cleaning as C
from crashgrid.operators import validate as V
from crashgrid.operators.sanitize import first_row_per_key, last_row_per_key, sanitize

# One value per rule: text with a zone-less time, numbers as text, blanks, a null word, free text.
CRASH = {
    "crash_record_id": "K-0417", "crash_date": "2019-11-23T07:05:30.000", "latitude": "41.9532",
    "longitude": "-87.7041", "injuries_total": "4", "injuries_fatal": "1", "posted_speed_limit": "25",
    "street_no": "3961", "lane_cnt": "  ", "street_name": "  Elston   Ave ", "street_direction": "W",
    "damage": "OVER $1,500", "workers_present_i": "null",
    "date_police_notified": "11/23/2019 07:20",
}
# No key, text instead of a time and of a number, coordinates elsewhere, a number out of range.
INVALID = {
    "crash_record_id": "", "crash_date": "last Tuesday", "latitude": "12.5", "longitude": "30.25",
    "injuries_total": "several", "posted_speed_limit": "-3",
}

def raw(spark, *records):
    names = list(dict.fromkeys(k for r in records for k in r))
    return spark.createDataFrame(
        [tuple(r.get(n) for n in names) for r in records], ", ".join(f"{n} STRING" for n in names)
    )


def test_crash_record(spark):
    row = sanitize("crashes", raw(spark, CRASH)).first().asDict()
    assert row["crash_date"] == datetime(2019, 11, 23, 7, 5, 30)
    assert (row["latitude"], row["longitude"]) == (41.9532, -87.7041)
    assert (row["injuries_total"], row["posted_speed_limit"], row["street_no"]) == (4, 25, 3961)
    assert row["lane_cnt"] is None and row["workers_present_i"] is None
    assert row["street_name"] == "Elston Ave" and row["damage"] == "OVER $1,500"
    assert len(row) == 2 + 2 + 10 + 26 + 1


def test_invalid_crash_record(spark):
    row = sanitize("crashes", raw(spark, INVALID)).first()
    assert row["crash_record_id"] is None and row["crash_date"] is None
    assert row["latitude"] is None and row["longitude"] is None
    assert row["injuries_total"] is None and row["posted_speed_limit"] == -3


def test_person_and_vehicle_records(spark):
    person = sanitize("people", raw(spark, {"crash_record_id": "C1", "person_id": "P1", "age": "35",
                                            "bac_result_value": None, "vehicle_id": "V1"})).first()
    assert person["age"] == 35 and person["bac_result_value"] is None and person["vehicle_id"] == "V1"
    vehicle = sanitize("vehicles", raw(spark, {"crash_record_id": "C1", "unit_no": "1",
                                               "vehicle_year": "2020", "num_passengers": "1"})).first()
    assert vehicle["unit_no"] == "1" and vehicle["vehicle_year"] == 2020
    assert vehicle["num_passengers"] == 1 and vehicle["crash_unit_id"] is None


def test_unknown_dataset(spark):
    with pytest.raises(ValueError, match="unknown dataset"):
        sanitize("signals", raw(spark, CRASH))


def test_first_row_per_key(spark):
    rows = spark.createDataFrame(
        [("q", 8, "late"), ("m", 2, None), ("q", 5, "early"), (None, 1, "x"), ("", 3, "y"), ("q", 6, "middle")],
        "k STRING, seq INT, v STRING")
    kept = first_row_per_key(rows, "k", ["seq"]).orderBy("k").collect()
    assert [tuple(r) for r in kept] == [("m", 2, None), ("q", 5, "early")]
    last = last_row_per_key(rows.where("k = 'q'"), ["k"], ["seq"]).collect()
    assert [tuple(r) for r in last] == [("q", 8, "late")]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"))
    plan = first_row_per_key(rows, "k", ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_validation_of_batches(spark):
    summary = V.validation_summary(V.validate(raw(spark, CRASH, INVALID, CRASH))).first()
    assert (summary["total_records"], summary["valid_records"], summary["invalid_records"]) == (3, 2, 1)
    empty = V.validation_summary(V.validate(raw(spark, CRASH).limit(0))).first()
    assert tuple(empty) == (0, 0, 0, 0, 0)


def test_out_of_bounds_is_a_warning(spark):
    row = V.validate(raw(spark, CRASH | {"latitude": "12.5", "longitude": "30.25"})).first()
    assert row["valid"] and row["errors"] == []
    assert row["warnings"] == ["Latitude 12.5 outside Chicago bounds",
                               "Longitude 30.25 outside Chicago bounds"]
    edge = V.validate(raw(spark, CRASH | {"latitude": "42.1", "longitude": "-87.5"})).first()
    assert edge["warnings"] == []


def test_missing_fields(spark):
    row = V.validate(raw(spark, INVALID)).first()
    assert not row["valid"] and row["errors"] == ["Missing required field: crash_record_id"]
    no_column = V.validate(raw(spark, {"crash_date": "2024-01-01"})).first()
    assert no_column["errors"] == ["Missing required field: crash_record_id"]
    vehicles = V.validate(raw(spark, {"crash_record_id": "C1", "unit_no": ""}), "vehicles").first()
    assert vehicles["errors"] == ["Missing required field: unit_no"]


def test_messages_of_other_feeds_pass(spark):
    rows = raw(spark, {"person_id": None, "ingest_seq": "1"})
    assert V.validation_messages(rows, "people", "ingest_seq").count() == 0


def test_specs_are_consistent():
    for spec in S.TABLES.values():
        assert len(set(spec.columns)) == len(spec.columns)
        assert set(spec.keys) <= set(spec.columns) and set(spec.required) <= set(spec.columns)


def test_coordinates_that_are_no_numbers(spark):
    from crashgrid.operators.validate import validate

    given = ["NaN", "50d", "far north", "1_0", "41.9", None]
    rows = spark.createDataFrame([("id", "d", g, "-87.6") for g in given],
                                 "crash_record_id string, crash_date string, latitude string, longitude string")
    found = {r["latitude"]: r["warnings"] for r in validate(rows).collect()}
    assert found["NaN"] == found["41.9"] == found[None] == []
    assert found["50d"] == ["Latitude 50d is not a number"]
    assert found["far north"] == ["Latitude far north is not a number"]
    assert len(found["1_0"]) == 1 and "10.0 outside" in found["1_0"][0]


def test_first_fatality_row_wins_without_a_sequence(spark, folder):
    from crashgrid.streaming.sync import clean_batch

    for turn in (["FIRST", "SECOND"], ["SECOND", "FIRST"]):
        lines = [(f'{{"person_id": "P1", "victim": "{name}"}}',) for name in turn]
        spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{folder}-{turn[0]}")
        raw = spark.read.schema("person_id string, victim string, ingest_seq string").json(f"{folder}-{turn[0]}")
        assert [r["victim"] for r in clean_batch("fatalities", raw).select("victim").collect()] == turn[:1]


def _longest_method(rows):
    """Bytes of the longest method that whole-stage code generation makes of a plan."""
    package = rows.sparkSession._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$")
    made = package.__getattr__("MODULE$").codegenStringSeq(rows._jdf.queryExecution().executedPlan())
    return max((made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())), default=0)


@pytest.mark.parametrize("dataset", ["crashes", "people", "vehicles", "fatalities"])
def test_no_method_of_a_cleaning_plan_is_too_long_to_be_compiled(spark, dataset):
    fields = S.raw_schema(S.BY_DATASET[dataset]).names
    values = [F.concat(F.col("id").cast("string"), F.lit(f" {n}")).alias(name) for n, name in enumerate(fields)]
    assert _longest_method(sanitize(dataset, spark.range(10).select(*values))) < 8000


def test_texts_of_a_record_are_cleaned_alike_whatever_stands_beside_them(spark):
    texts = ["a b", " \tx", "  A   B  ", "", "   ", None, " unk ", "　N/A", "null", "Nul", "plain text", "\x7f", "é  è", "\n"]
    table = "sex STRING, hospital STRING, age STRING"
    for beside in ("plain", "\tx", "é", None):
        raw = spark.createDataFrame([(t, beside, " 1_2.9") for t in texts], table)
        rows = sanitize("people", raw, carry=["hospital"]).select("sex", "age").collect()
        alone = raw.select(C.clean_string(F.col("sex"))).collect()
        assert [r["sex"] for r in rows] == [r[0] for r in alone]
        assert [r["sex"] for r in rows] == ["a b", "x", "A B", None, None, None, None, None, None, "Nul", "plain text", "\x7f", "é è", None]
        assert {r["age"] for r in rows} == {12}
