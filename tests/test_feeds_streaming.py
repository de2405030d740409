from __future__ import annotations

import csv
import glob
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crashgrid import schemas as S
from crashgrid.functions.windows import sync_window
from crashgrid.sources import exports, feeds
from crashgrid.sources.tables import warehouse_table
from crashgrid.streaming.sync import sync, sync_incremental

NOW = datetime(2024, 5, 1)


def local(path):
    return path.removeprefix("file://")


def test_scan_is_all_text_and_tolerates_missing_fields(spark, folder):
    feeds.land(spark.createDataFrame([("A", 1, None), ("B", 2, "x")], "crash_record_id STRING, injuries_total INT, extra STRING"), folder)
    rows = feeds.scan_feed(spark, folder, "crashes")
    assert set(dict(rows.dtypes).values()) == {"string"}
    got = rows.select("crash_record_id", "injuries_total", "latitude").orderBy("crash_record_id").collect()
    assert [tuple(r) for r in got] == [("A", "1", None), ("B", "2", None)]
    picked = feeds.scan_feed(spark, folder, "crashes", ["injuries_total"], "injuries_total > 1", ["crash_record_id"])
    assert [tuple(r) for r in picked.collect()] == [("2",)]


def test_ingest_window_leaves_out_the_last_second(spark):
    stamps = ["2024-01-01T00:00:00", "2024-01-31T23:59:58", "2024-01-31T23:59:59", "2023-12-31T23:59:59", None]
    rows = spark.createDataFrame([(s,) for s in stamps], "crash_date STRING")
    assert rows.where(feeds.date_window("crash_date", "2024-01-01", "2024-01-31")).count() == 2
    assert rows.where(feeds.date_window("crash_date", start="2024-01-01")).count() == 3
    assert rows.where(feeds.date_window("crash_date")).count() == 5


@pytest.mark.parametrize("total, size, expected", [(1500, 1000, [1000, 500]), (3000, 1000, [1000] * 3), (0, 10, [])])
def test_pages_cover_the_feed_once(spark, total, size, expected):
    rows = spark.range(total).select((F.col("id") % 7).alias("d"), "id")
    got = [sorted(tuple(r) for r in p.collect()) for p in feeds.pages(rows, ["d", "id"], size)]
    assert [len(p) for p in got] == expected
    assert sorted(x for p in got for x in p) == sorted(tuple(r) for r in rows.collect())
    for n, batch in enumerate(got):
        assert sorted(tuple(r) for r in feeds.page(rows, n, ["d", "id"], size).collect()) == batch


def test_pages_with_null_dates(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "d STRING, id INT")
    assert [[r["id"] for r in p.collect()] for p in feeds.pages(rows, ["d", "id"], 1)] == [[1], [2], [3], [4]]


def test_incremental_scan(spark):
    rows = spark.createDataFrame([("A", "2024-01-02T00:00:00"), ("B", "2024-01-01T00:00:00"), ("C", "2024-01-03T00:00:00")],
                                 f"id STRING, `{feeds.UPDATED_AT}` STRING")
    changed = feeds.updated_since(rows, datetime(2024, 1, 1))
    assert [r["id"] for r in changed.collect()] == ["A", "C"]
    assert feeds.next_cursor(changed).first()["cursor"] == "2024-01-03T00:00:00"


def test_sample_limits(spark):
    with pytest.raises(ValueError):
        feeds.sample_rows(spark.range(1), 1001)
    assert feeds.sample_rows(spark.range(10), 5, ["id"]).count() == 5


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), "crash_record_id STRING, crash_date STRING, street_name STRING, ingest_seq BIGINT")


def start(spark, folder, hook=None, window=None, per_batch=1):
    return sync(spark, {"crashes": f"{folder}/feed/*"}, f"{folder}/warehouse", f"{folder}/checkpoints", lambda: NOW,
                window=window, on_batch=hook, files_per_batch=per_batch)


def test_stream_picks_up_each_file_once_and_amends(spark, folder):
    seen = []
    def hook(dataset, batch_id, counts):
        seen.append((dataset, batch_id, counts.inserted, counts.updated))
    feeds.land(raw(spark, ("A", "2024-01-01", "old", 1), ("B", "2024-01-02", "keep", 2), ("", "2024-01-02", "x", 3)).coalesce(1), f"{folder}/feed/1")
    totals = start(spark, folder, hook).first()
    assert (totals["fetched"], totals["inserted"], totals["updated"], totals["skipped"]) == (3, 2, 0, 1)
    feeds.land(raw(spark, ("A", "2024-01-01", "amended", 4), ("C", "2023-01-01", "late", 5)).coalesce(1), f"{folder}/feed/2")
    totals = start(spark, folder, hook).first()
    assert (totals["batches_processed"], totals["inserted"], totals["updated"]) == (2, 3, 1)
    assert start(spark, folder, hook).first() == totals
    assert seen == [("crashes", 0, 2, 0), ("crashes", 1, 1, 1)]
    table = warehouse_table(spark, f"{folder}/warehouse", S.CRASHES)
    got = sorted(tuple(r) for r in table.read().select("crash_record_id", "street_name").collect())
    assert got == [("A", "amended"), ("B", "keep"), ("C", "late")]


def test_window_limits_what_is_merged(spark, folder):
    feeds.land(raw(spark, ("A", "2024-01-01T10:00:00", "x", 1), ("B", "2024-03-01T10:00:00", "x", 2)), f"{folder}/feed/1")
    window = sync_window("last_30_days_crashes", datetime(2024, 3, 5))
    assert start(spark, folder, window=window, per_batch=10).first()["inserted"] == 1


def test_repeated_fatalities_keep_the_first(spark, folder):
    rows = spark.createDataFrame(
        [("F1", "2024-01-01", "DRIVER", 2), ("F1", "2024-01-01", "CYCLIST", 1), (None, "2024-01-01", "X", 3)],
        "person_id STRING, crash_date STRING, victim STRING, ingest_seq BIGINT")
    feeds.land(rows, f"{folder}/feed")
    sync(spark, {"fatalities": f"{folder}/feed"}, f"{folder}/w", f"{folder}/c", lambda: NOW, files_per_batch=10)
    stored = warehouse_table(spark, f"{folder}/w", S.FATALITIES).read().collect()
    assert [(r["person_id"], r["victim"]) for r in stored] == [("F1", "CYCLIST")]


def test_csv_quoting_and_times(spark, folder):
    rows = spark.createDataFrame(
        [('say "hi", ok', datetime(2024, 1, 2, 3, 4, 5), None, 1.5), ("x", datetime(2024, 1, 2, 3, 4, 5, 7), "", None)],
        "a STRING, t TIMESTAMP_NTZ, n STRING, d DOUBLE").coalesce(1)
    exports.write_csv(rows, folder)
    (name,) = glob.glob(f"{local(folder)}/*.csv")
    with open(name, newline="") as handle:
        assert list(csv.reader(handle)) == [
            ["a", "t", "n", "d"], ['say "hi", ok', "2024-01-02 03:04:05", "", "1.5"],
            ["x", "2024-01-02 03:04:05.000007", "", ""]]


def test_geojson_feature(spark):
    rows = spark.createDataFrame(
        [("A", datetime(2024, 1, 2, 3, 4, 5), None, 1, None, "Y", None, "MAIN", None, -87.5, 41.75), ("B",) + (None,) * 10],
        "crash_record_id STRING, crash_date TIMESTAMP_NTZ, injuries_total INT, injuries_fatal INT, "
        "injuries_incapacitating INT, hit_and_run_i STRING, crash_type STRING, street_name STRING, "
        "prim_contributory_cause STRING, longitude DOUBLE, latitude DOUBLE")
    (row,) = exports.crash_features(rows).collect()
    assert json.loads(row["feature"]) == {
        "type": "Feature", "geometry": {"type": "Point", "coordinates": [-87.5, 41.75]},
        "properties": {"crash_record_id": "A", "crash_date": "2024-01-02T03:04:05", "injuries_total": 0,
                       "injuries_fatal": 1, "injuries_incapacitating": 0, "hit_and_run_i": True,
                       "crash_type": None, "street_name": "MAIN", "primary_contributory_cause": None}}


@pytest.mark.parametrize("per_batch", [1, 10])
def test_the_newer_record_stays_whichever_file_is_read_first(spark, folder, per_batch):
    for n, row in enumerate([("A", "2024-01-01", "new", 9), ("A", "2024-02-01", "old", 3), ("A", "2024-01-01", "older", 1)]):
        feeds.land(raw(spark, row).coalesce(1), f"{folder}/feed/{n}")
    totals = start(spark, folder, per_batch=per_batch).first()
    assert (totals["fetched"], totals["inserted"], totals["updated"], totals["repeated"]) == (3, 1, 0, 2)
    feeds.land(raw(spark, ("A", "2024-01-01", "newest", 10)).coalesce(1), f"{folder}/feed/9")
    table = warehouse_table(spark, f"{folder}/warehouse", S.CRASHES)
    assert [r["street_name"] for r in table.read().collect()] == ["new"]
    start(spark, folder, per_batch=per_batch)
    assert [r["street_name"] for r in table.read().collect()] == ["newest"]


def stamped(spark, *rows):
    return spark.createDataFrame(list(rows), f"crash_record_id STRING, crash_date STRING, street_name STRING, `{feeds.UPDATED_AT}` STRING")


def streets(spark, folder):
    table = warehouse_table(spark, f"{folder}/warehouse", S.CRASHES)
    return sorted(tuple(r) for r in table.read().select("crash_record_id", "street_name").collect())


def increment(spark, folder, whole=False):
    return sync_incremental(spark, f"{folder}/feed/*", "crashes", f"{folder}/warehouse", lambda: NOW, whole=whole)


@pytest.mark.parametrize("per_batch", [1, 100])
def test_change_stamps_decide_in_any_file_order(spark, folder, per_batch):
    feeds.land(stamped(spark, ("A", "2024-01-01", "new", "2024-01-05T00:00:00")).coalesce(1), f"{folder}/feed/0")
    feeds.land(stamped(spark, ("A", "2024-01-01", "old", "2024-01-02T00:00:00"), ("B", "2024-01-01", "b", None)).coalesce(1), f"{folder}/feed/1")
    totals = start(spark, folder, per_batch=per_batch).first()
    assert streets(spark, folder) == [("A", "new"), ("B", "b")]
    assert (totals["inserted"], totals["updated"], totals["repeated"]) == (2, 0, 1)


def test_without_sequence_the_last_line_of_a_file_stands(spark, folder):
    lines = [(key, "2024-01-01", f"{word} {key}", None) for word in ("old", "new") for key in ("A", "B", "C", "D")]
    feeds.land(stamped(spark, *lines).coalesce(1), f"{folder}/feed/0")
    start(spark, folder)
    assert streets(spark, folder) == [(k, f"new {k}") for k in "ABCD"]


def test_an_amendment_without_sequence_replaces_a_row_that_has_one(spark, folder):
    feeds.land(raw(spark, ("A", "2024-01-01", "first", 7)).coalesce(1), f"{folder}/feed/0")
    start(spark, folder)
    feeds.land(stamped(spark, ("A", "2024-01-01", "amended", None)).drop(feeds.UPDATED_AT).coalesce(1), f"{folder}/feed/1")
    totals = start(spark, folder).first()
    assert streets(spark, folder) == [("A", "amended")] and totals["updated"] == 1


def test_first_fatality_over_several_files(spark, folder):
    ddl = "person_id STRING, crash_date STRING, victim STRING"
    for n, victim in enumerate(("DRIVER", "CYCLIST", "PEDESTRIAN")):
        feeds.land(spark.createDataFrame([("F1", "2024-01-01", victim)], ddl).coalesce(1), f"{folder}/feed/{n}")
    sync(spark, {"fatalities": f"{folder}/feed/*"}, f"{folder}/w", f"{folder}/c", lambda: NOW, files_per_batch=10)
    assert [r["victim"] for r in warehouse_table(spark, f"{folder}/w", S.FATALITIES).read().collect()] == ["DRIVER"]


def test_incremental_runs_equal_one_run(spark, folder):
    landings = [
        [("A", "2024-01-01", "a3", "2024-01-03T00:00:00"), ("B", "2024-01-01", "b1", "2024-01-01T00:00:00")],
        [("A", "2024-01-01", "a1", "2024-01-01T00:00:00"), ("C", "2024-01-01", "c2", "2024-01-02T00:00:00"), ("", "2024-01-01", "x", None)],
        [("B", "2024-02-01", "b4", "2024-01-04T00:00:00"), ("C", "2024-01-01", "c1", "2024-01-01T00:00:00")],
    ]
    seen = []
    for n, rows in enumerate(landings):
        feeds.land(stamped(spark, *rows).coalesce(1), f"{folder}/feed/{n}")
        seen.append(increment(spark, folder))
    wanted = [("A", "a3"), ("B", "b4"), ("C", "c2")]
    assert streets(spark, folder) == wanted
    assert [(c.inserted, c.updated) for c in seen] == [(2, 0), (1, 0), (0, 1)]
    cursor = warehouse_table(spark, f"{folder}/warehouse", S.CRASHES).cursor(f"{folder}/feed/*")
    assert cursor["changed"] == "2024-01-04T00:00:00" and cursor["landed"] > "2024"
    again = increment(spark, folder)
    assert (again.inserted, again.updated) == (0, 0) and streets(spark, folder) == wanted
    sync_incremental(spark, f"{folder}/feed/*", "crashes", f"{folder}/other", lambda: NOW)
    other = warehouse_table(spark, f"{folder}/other", S.CRASHES).read()
    assert sorted(tuple(r) for r in other.select("crash_record_id", "street_name").collect()) == wanted


def test_old_files_are_not_listed_again(spark, folder):
    import os

    feeds.land(stamped(spark, ("A", "2024-01-01", "a", "2024-01-03T00:00:00")).coalesce(1), f"{folder}/feed/0")
    for name in glob.glob(f"{local(folder)}/feed/0/*"):
        os.utime(name, (1_600_000_000, 1_600_000_000))
    assert increment(spark, folder).fetched == 1
    for n in (1, 2):
        feeds.land(stamped(spark, ("A", "2024-01-01", f"a{n}", f"2024-01-0{n + 3}T00:00:00")).coalesce(1), f"{folder}/feed/{n}")
        for name in glob.glob(f"{local(folder)}/feed/{n}/*"):
            os.utime(name, (1_600_000_000 + 100 * n, 1_600_000_000 + 100 * n))
        assert increment(spark, folder).fetched == 2  # the newest known file once more, nothing before it
    assert streets(spark, folder) == [("A", "a2")]


def test_whole_copies_are_cut_at_the_cursor(spark, folder):
    rows = [("A", "2024-01-01", "a", "2024-01-01T00:00:00"), ("B", "2024-01-01", "b", "2024-01-02T00:00:00")]
    feeds.land(stamped(spark, *rows).coalesce(1), f"{folder}/feed/0")
    assert increment(spark, folder, whole=True).fetched == 2
    feeds.land(stamped(spark, *rows, ("C", "2024-01-01", "c", "2024-01-03T00:00:00")).coalesce(1), f"{folder}/feed/1")
    counts = increment(spark, folder, whole=True)
    assert counts.inserted == 1 and counts.fetched <= 3
    assert [k for k, _ in streets(spark, folder)] == ["A", "B", "C"]


@pytest.mark.parametrize("letters", [feeds.DAY, feeds.MONTH])
def test_dated_landings_list_only_the_window(spark, folder, letters):
    days = ["2024-01-01T10:00:00", "2024-01-31T23:59:58", "2024-01-31T23:59:59", "2024-01-15", "2023-12-31T23:59:59",
            "2024-02-01T00:00:00", "2024-03-05", "3/4/2021", "", None, "2024-01-20Tnonsense"]
    rows = spark.createDataFrame([(f"K{i}", d) for i, d in enumerate(days)], "crash_record_id STRING, crash_date STRING")
    feeds.land_by_date(rows, folder, letters=letters)
    for start, end in [("2024-01-01", "2024-01-31"), ("2024-01-15", None), (None, "2024-01-15"), (None, None)]:
        wanted = rows.where(feeds.date_window("crash_date", start, end)).select("crash_record_id").collect()
        got = feeds.scan_dates(spark, folder, "crashes", start, end)
        assert sorted(r[0] for r in got.select("crash_record_id").collect()) == sorted(r[0] for r in wanted)
    plan = feeds.scan_dates(spark, folder, "crashes", "2024-03-01", "2024-03-31")
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "landed_for" in scan.split("PartitionFilters")[1].split("]")[0]
    plan.collect()
    files = plan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numFiles").get().value()
    assert files <= 2 < len(spark.read.json(folder).inputFiles())


def test_landings_of_an_incremental_run_grow_with_the_shuffle(spark, sf, monkeypatch):
    from crashgrid.checks import queries as Q

    spread = []

    def land(rows, path):
        spread.append(rows.rdd.getNumPartitions())
        raise StopIteration

    monkeypatch.setattr(Q.feeds, "land", land)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        with pytest.raises(StopIteration):
            Q.sync_incremental(spark, sf)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert spread == [7]
