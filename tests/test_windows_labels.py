from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crashgrid.functions import labels as L
from crashgrid.functions import predicates as P
from crashgrid.functions.windows import sync_window, trend_window
from crashgrid.operators.layers import detect_sort_type

AS_OF = datetime(2024, 3, 31, 15, 0)


def test_sync_windows():
    assert sync_window("full_refresh", AS_OF) == (
        ("crashes", "people", "vehicles", "fatalities"), None, None)
    assert sync_window("last_30_days_people", AS_OF) == (("people",), "2024-03-01", "2024-03-31")
    assert sync_window("last_6_months_fatalities", AS_OF) == (
        ("fatalities",), "2023-10-03", "2024-03-31")
    assert sync_window("something else", AS_OF) == (("crashes",), "2024-03-24", "2024-03-31")
    assert sync_window("custom", AS_OF, {"date_range_days": 10}) == (
        ("crashes",), "2024-03-21", "2024-03-31")
    explicit = {"start_date": "2024-01-01", "date_range_days": 10, "end_date": "2024-02-01"}
    assert sync_window("custom", AS_OF, explicit) == (("crashes",), "2024-01-01", "2024-02-01")
    assert sync_window("custom", AS_OF).start is None


def test_trend_window():
    assert trend_window(AS_OF) == (datetime(2023, 4, 2, 15, 0), None)
    assert trend_window(AS_OF, weeks=1) == (datetime(2024, 3, 24, 15, 0), None)
    assert trend_window(AS_OF, weeks=1, end=AS_OF) == (None, AS_OF)
    with pytest.raises(ValueError):
        trend_window(AS_OF, weeks=105)


def test_end_of_day():
    assert P.end_of_day(datetime(2024, 1, 31)) == datetime(2024, 1, 31, 23, 59, 59, 999999)
    assert P.end_of_day(datetime(2024, 1, 31, 8)) == datetime(2024, 1, 31, 8)
    assert P.end_of_day(None) is None


def test_date_range_includes_the_last_microsecond(spark):
    stamps = [datetime(2024, 1, 1), datetime(2024, 1, 31, 23, 59, 59, 999999), datetime(2024, 2, 1), None]
    rows = spark.createDataFrame([(s,) for s in stamps], "crash_date TIMESTAMP_NTZ")
    kept = rows.where(P.in_dates("crash_date", datetime(2024, 1, 1), datetime(2024, 1, 31))).count()
    assert kept == 2
    assert rows.where(P.in_dates("crash_date")).count() == 4


def test_person_predicates(spark):
    rows = spark.createDataFrame(
        [("PEDESTRIAN", 0, "FATAL"), ("Pedalcyclist", 5, "INCAPACITATING INJURY"),
         ("BICYCLE", 17, "REPORTED, NOT EVIDENT"), ("DRIVER", 18, "FATAL"), ("x", 25, "FATAL"),
         ("non-pedestrian", -1, "FATAL"), (None, 5, "NO INDICATION OF INJURY"), ("y", 5, None),
         ("z", 5, ""), ("w", None, "OTHER")],
        "person_type STRING, age INT, injury_classification STRING")
    got = rows.agg(
        F.count_if(P.is_pedestrian()), F.count_if(P.is_cyclist()), F.count_if(P.is_injured_child()),
        F.count_if(P.is_unknown_injury())).first()
    assert tuple(got) == (2, 2, 3, 3)


def test_categories(spark):
    rows = spark.createDataFrame(
        [(1, 1, 1, "Y", "PEDESTRIAN"), (0, 2, 2, "N", "PEDALCYCLIST"), (0, 0, 3, None, None),
         (None, None, None, "Y", "REAR END")],
        "injuries_fatal INT, injuries_incapacitating INT, injuries_total INT, hit_and_run_i STRING, "
        "crash_type STRING")
    got = rows.select(P.severity(), P.hit_and_run_category(), P.crash_type_category()).collect()
    assert [tuple(r) for r in got] == [
        ("Fatal", "Hit and Run", "Pedestrian"),
        ("Incapacitating Injury", "Not Hit and Run", "Pedalcyclist"),
        ("Other Injury", "Not Hit and Run", "Other"),
        ("Property Damage Only", "Hit and Run", "Other"),
    ]
    assert rows.where(P.in_categories("severity", [])).count() == 0
    assert rows.where(P.in_categories("severity", ["Fatal", "Other Injury"])).count() == 2


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_slug(spark):
    assert column(spark, ["Ward  Map #1!", "--", "ÄB c", " x "], L.slug) == [
        "ward-map-1", "layer", "b-c", "x"]


def test_first_number(spark):
    values = ["5", "Ward 5", "5th Ward", "05", "001", "Downtown", "Area 5 Zone 10", ""]
    assert column(spark, values, L.first_number) == [5.0, 5.0, 5.0, 5.0, 1.0, None, 5.0, None]


def test_cause_and_month_labels(spark):
    values = ["FOLLOWING TOO_CLOSELY", "UNKNOWN", "", None]
    assert column(spark, values, L.cause_label) == [
        "Following Too Closely", "Unknown / Not Reported", "Unknown / Not Reported",
        "Unknown / Not Reported"]
    assert column(spark, ["2024-01"], L.month_label) == ["Jan 24"]


def test_iso_text(spark):
    rows = spark.createDataFrame(
        [(datetime(2024, 1, 2, 3, 4, 5),), (datetime(2024, 1, 2, 3, 4, 5, 60),)], "t TIMESTAMP_NTZ")
    assert [r[0] for r in rows.select(L.iso_text(F.col("t"))).collect()] == [
        "2024-01-02T03:04:05", "2024-01-02T03:04:05.000060"]


def test_label_values(spark):
    values = ['{"f":1.0}', '{"f":1.5}', '{"f":10}', '{"f":"Ward 1"}', '{"f":0.0}', '{"f":-1.0}',
              '{"f":"1.0"}', '{"f":null}', '{"g":1}']

    def name(properties):
        return L.feature_name(properties, F.lit(7), "f")

    assert column(spark, values, name) == [
        "1", "1.5", "10", "Ward 1", "0", "-1", "1.0", "None", "Feature 7"]


def test_feature_names(spark):
    values = [
        '{"name":"A","NAME":"B"}', '{"name":"","NAME":"B"}', '{"title":"T","ward":3}', '{"ward":3.0}',
        '{"ward":0,"DISTRICT":"9"}', '{"ward":"0"}', '{"community":"LOOP"}', '{"AREA_NUMBE":5}',
        '{"objectid":12}', '{"name":false,"beat_num":"0111"}', "{}", '{"name":null}',
    ]

    def name(properties):
        return L.feature_name(properties, F.lit(7))

    assert column(spark, values, name) == [
        "A", "B", "T", "Ward 3", "District 9", "Ward 0", "LOOP", "Area 5", "Feature 12", "Beat 0111",
        "Feature 7", "Feature 7"]
    assert column(spark, values[:1] + ['{"label":"x"}'],
                  lambda p: L.report_feature_name(p, F.lit(7))) == ["A", "Feature 7"]


@pytest.mark.parametrize(
    "sort_type, names, expected",
    [
        ("alphabetic", ["banana", "Apple", "cherry"], ["Apple", "banana", "cherry"]),
        ("unknown", ["b", "A"], ["A", "b"]),
        ("numeric", ["Ward 10", "Ward 2", "Downtown", "Ward 1", "Airport"],
         ["Ward 1", "Ward 2", "Ward 10", "Airport", "Downtown"]),
        ("natural", ["item10", "item2", "Item1", "item"], ["item", "Item1", "item2", "item10"]),
        ("natural", ["b1a10", "b1a9", "b01a8", "10", "9", "9x", ""], ["", "9", "9x", "10", "b01a8", "b1a9", "b1a10"]),
    ],
)
def test_sorting(spark, sort_type, names, expected):
    rows = spark.createDataFrame([(n,) for n in names], "name STRING")
    ordered = rows.orderBy(*L.sort_columns("name", sort_type)).collect()
    assert [r["name"] for r in ordered] == expected


@pytest.mark.parametrize(
    "labels, expected",
    [
        (['"Ward 1"', '"Ward 2"'], "numeric"),
        (['"A"', '"B"'], "alphabetic"),
        (["1", "2.5"], "numeric"),
        (['"1"', '"2"', '"3"', '"4"', '"x"'], "numeric"),
        (['"1"', '"2"', '"3"', '"x"', '"y"'], "alphabetic"),
        (["null", '"Ward 1"'], "numeric"),
        (["null"], "alphabetic"),
        (["true"], "numeric"),
        (['"true"'], "alphabetic"),
        (["[1]"], "alphabetic"),
    ],
)
def test_sort_type_detection(spark, labels, expected):
    rows = spark.createDataFrame(
        [(i, f'{{"f":{v}}}') for i, v in enumerate(labels)], "id BIGINT, properties STRING")
    assert detect_sort_type(rows, "f").first()["sort_type"] == expected
    assert detect_sort_type(rows, None).first()["sort_type"] == "alphabetic"


@pytest.mark.parametrize(
    "fields, best",
    [
        (["id", "title", "name"], "name"), (["id", "dist_nm", "desc"], "dist_nm"),
        (["ward", "long_desc"], "long_desc"), (["x", "WARD_NO"], "WARD_NO"), (["x", "y"], None),
        (["FullName", "Name"], "Name"),
    ],
)
def test_label_heuristic(spark, fields, best):
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "pos INT, f STRING")
    ranked = rows.withColumn("rank", L.label_rank(F.col("f"))).where("rank IS NOT NULL")
    assert ranked.agg(F.min_by("f", F.struct("rank", "pos"))).first()[0] == best
