from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crashgrid import schemas as S
from crashgrid.checks import queries as Q
from crashgrid.checks.fixtures import view
from crashgrid.operators import dashboard as D
from crashgrid.plans import documented
from crashgrid.plans import location_report as R


@pytest.fixture(scope="module")
def tables(spark, sf):
    return [view(spark, sf, n).cache() for n in ("fx_crashes", "fx_people", "fx_vehicles")]


def test_region_precedence(spark, sf):
    place = Q._place(spark, sf, "L")
    assert R.choose_region(place, Q.CENTER, Q.RING) is place
    assert R.choose_region(None, Q.CENTER, Q.RING) is Q.CENTER
    assert isinstance(R.choose_region(ring=Q.RING), R.Ring)
    with pytest.raises(ValueError):
        R.choose_region(ring=Q.RING[:2])


def test_unknown_place(spark, sf, tables):
    with pytest.raises(LookupError):
        R.in_region(tables[0], Q._place(spark, sf, "nowhere"))


@pytest.mark.parametrize("region", [Q.CENTER, R.Ring(Q.RING)])
def test_both_child_strategies_agree(tables, region):
    shipped = R.LocationReport(*tables, region)
    counted = R.LocationReport(*tables, region, broadcast_limit=0)
    assert shipped.stats().collect() == counted.stats().collect()
    assert shipped.cost_breakdown().collect() == counted.cost_breakdown().collect()


def test_large_regions_count_children_before_the_join(tables):
    report = R.LocationReport(*tables, R.Ring(Q.RING), broadcast_limit=0)
    plan = report.person_counts()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.rindex("Aggregate [crash_record_id")


def test_cached_report_gives_the_same_panels(tables):
    lazy = R.LocationReport(*tables, Q.CENTER, Q.START)
    expected = [lazy.stats().collect(), lazy.causes().collect(), lazy.points().collect()]
    with R.LocationReport(*tables, Q.CENTER, Q.START) as report:
        assert report.crashes.storageLevel.useMemory
        assert [report.stats().collect(), report.causes().collect(), report.points().collect()] == expected
    assert not report.crashes.storageLevel.useMemory


def test_empty_region(tables):
    report = R.LocationReport(*tables, R.Radius(10.0, 10.0, 100.0))
    row = report.stats().first()
    assert set(row.asDict().values()) == {0}
    assert report.causes().count() == 0 and report.monthly_trends(Q.AS_OF).count() == 0
    assert tuple(R.monthly_averages(report.monthly_trends(Q.AS_OF)).first()) == (0, 0, 0)


def test_costs(spark):
    crashes = spark.createDataFrame(
        [("C1", datetime(2024, 1, 1), 1, 0, 0, None, None, None, "", 1.0, 1.0),
         ("C2", datetime(2024, 1, 1), None, None, 0, "Y", None, None, None, 1.0, 1.0)],
        "crash_record_id STRING, crash_date TIMESTAMP_NTZ, injuries_total INT, injuries_fatal INT, "
        "injuries_incapacitating INT, hit_and_run_i STRING, crash_type STRING, street_name STRING, "
        "prim_contributory_cause STRING, longitude DOUBLE, latitude DOUBLE")
    people = spark.createDataFrame(
        [("C1", "DRIVER", 30, "FATAL"), ("C1", "PEDESTRIAN", 10, "REPORTED, NOT EVIDENT"),
         ("C2", "DRIVER", 30, "NO INDICATION OF INJURY"), ("C3", "DRIVER", 30, "FATAL")],
        "crash_record_id STRING, person_type STRING, age INT, injury_classification STRING")
    vehicles = spark.createDataFrame([("C1",), ("C2",), ("C2",)], "crash_record_id STRING")
    report = R.LocationReport(crashes, people, vehicles, R.Radius(1.0, 1.0, 10.0))
    row = report.stats().first()
    assert row["estimated_economic_damages"] == 1_606_644 + 25_933 + 2 * 6_269
    assert row["estimated_societal_costs"] == 11_258_495 + 111_281 + 2 * (6_269 + 3_927)
    assert (row["children_injured"], row["total_vehicles"], row["hit_and_run_count"]) == (1, 3, 1)
    lines = report.cost_breakdown().collect()
    assert [r["count"] for r in lines] == [1, 0, 0, 1, 1, 2]
    assert sum(r["subtotal_societal"] for r in lines) == row["estimated_societal_costs"]
    assert [tuple(r)[:2] + (r["percentage"],) for r in report.causes().collect()] == [("UNKNOWN", 2, 100.0)]


@pytest.mark.parametrize("part, whole, expected", [(1, 3, 33.3), (2, 3, 66.7), (7, 2000, 0.4), (0, 5, 0.0), (5, 5, 100.0)])
def test_percentages_round_half_up(spark, part, whole, expected):
    row = spark.range(1).select(R.percent_half_up(F.lit(part), F.lit(whole)).alias("p")).first()
    assert row["p"] == expected


def test_year_before():
    assert R.year_before(datetime(2024, 2, 29, 1)) == datetime(2023, 2, 28, 1)
    assert R.year_before(datetime(2024, 3, 1)) == datetime(2023, 3, 1)


def test_areas(spark, sf, tables):
    import json

    circle = json.loads(R.LocationReport(*tables, Q.CENTER).area().first()["feature"])
    ring = circle["geometry"]["coordinates"][0]
    assert len(ring) == 65 and ring[0] == ring[-1] and circle["properties"]["type"] == "radius"
    drawn = json.loads(R.region_feature(spark, R.Ring(Q.RING)).first()["feature"])
    assert drawn["geometry"]["coordinates"][0][0] == list(Q.RING[0])
    zone = Q.places.native_place(Q._zone_boundaries(spark, sf), "wards", "7")
    feature = json.loads(R.region_feature(spark, R.Place("wards", "7", zone)).first()["feature"])
    assert feature["properties"] == {"type": "place", "place_type": "wards", "place_id": "7", "name": "Ward 7"}


def test_export_checks(tables):
    with pytest.raises(ValueError, match="signals"):
        R.export_rows(["crashes", "signals"], {}, Q.CENTER)
    with pytest.raises(ValueError):
        R.export_rows([], {}, Q.CENTER)


@pytest.mark.parametrize("call", [
    lambda c: D.crashes_by_cause(c, limit=-1), lambda c: D.crashes_by_cause(c, limit=0),
    lambda c: D.crash_points(c, limit=0), lambda c: D.dashboard_stats(c, c, date_from="x"),
])
def test_argument_limits(tables, call):
    with pytest.raises(ValueError):
        call(tables[0])


def test_week_starts_on_monday(spark):
    rows = spark.createDataFrame(
        [(datetime(2024, 1, 7, 23),), (datetime(2024, 1, 8),), (datetime(2024, 1, 1),), (None,)],
        "crash_date TIMESTAMP_NTZ").withColumns({"injuries_total": F.lit(1), "injuries_fatal": F.lit(None).cast("int")})
    assert [tuple(r) for r in D.weekly_trends(rows).collect()] == [("2024-01-01", 2, 2, 0), ("2024-01-08", 1, 1, 0)]


def test_undated_crashes_lead_the_map(spark, tables):
    undated = tables[0].limit(1).withColumns({"crash_date": F.lit(None).cast("timestamp_ntz"),
                                              "crash_record_id": F.lit("X"), "longitude": F.lit(1.0),
                                              "latitude": F.lit(1.0)})
    assert D.newest_points(tables[0].unionByName(undated), 1).first()["crash_record_id"] == "X"


def test_crowded_vehicle_keeps_everyone(spark):
    """A vehicle with very many people has a row for each, nobody lost or repeated."""
    import json

    crashes = spark.createDataFrame([("C1", datetime(2024, 1, 1), "X")],
                                    "crash_record_id STRING, crash_date TIMESTAMP_NTZ, prim_contributory_cause STRING")
    vehicles = spark.createDataFrame([("C1", "BUS", "BUS"), ("C1", "CAR", "CAR"), ("C1", None, "BIKE")],
                                     "crash_record_id STRING, vehicle_id STRING, unit_type STRING")
    people = spark.range(500).select(
        F.concat(F.lit("P"), "id").alias("person_id"), F.lit("BUS").alias("vehicle_id"),
        F.when(F.col("id") % 2 == 0, "PASSENGER").alias("person_type"), F.lit("FATAL").alias("injury_classification"))
    rows = documented.vehicle_occupants(crashes, vehicles, people, datetime(2024, 1, 5)).collect()
    bus = [r for r in rows if r["vehicle_id"] == "BUS"]
    assert sorted(r["person_id"] for r in bus) == sorted(f"P{i}" for i in range(500))
    assert all(json.loads(r["occupant"])["person_type"] == r["person_type"] for r in bus)
    others = {r["unit_type"]: json.loads(r["occupant"]) for r in rows if r["vehicle_id"] != "BUS"}
    nobody = {"person_id": None, "person_type": None, "injury": None}
    assert others == {"CAR": nobody, "BIKE": nobody}


def test_no_limit_returns_everything(tables):
    located = tables[0].where("longitude IS NOT NULL AND latitude IS NOT NULL").count()
    assert D.newest_points(tables[0]).count() == located
    assert D.crashes_by_cause(tables[0], limit=None).count() >= D.crashes_by_cause(tables[0]).count()


def test_no_limit_returns_every_row(spark, tables, monkeypatch):
    from crashgrid.operators import catalog, jobs
    from crashgrid.sources import feeds

    n = 50_001
    many = spark.range(n).select(
        F.col("id").cast("string").alias("crash_record_id"), F.lit(Q.START).cast("timestamp_ntz").alias("crash_date"),
        F.lit(-87.7).alias("longitude"), F.lit(41.8).alias("latitude"),
        *[F.lit(None).cast("string").alias(c) for c in S.MAP_POINT_COLUMNS[2:]])
    monkeypatch.setattr(Q, "view", lambda *_: many)
    assert Q.crashes_by_date_range(spark, "").count() == n
    assert feeds.sample_rows(many, None).count() == n
    assert catalog.sample_table(many, None).count() == n
    runs = spark.range(201).select(
        F.col("id").alias("execution_id"), F.lit(1).alias("job_id"), F.lit(Q.START).alias("started_at"))
    registry = spark.createDataFrame([(1, "A", "custom")], "id INT, name STRING, job_type STRING")
    assert jobs.job_history(runs, registry, limit=None).count() == 201
    report = R.LocationReport(*tables, Q.CENTER)
    assert report.causes(None).count() >= report.causes(1).count() == 1
    assert report.points(None).count() == report.crashes.where("longitude IS NOT NULL").count()
