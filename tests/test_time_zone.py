"""Local timestamps must not depend on the session time zone."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crashgrid import schemas as S
from crashgrid.functions import cleaning as C
from crashgrid.functions import labels as L
from crashgrid.operators import dashboard as D
from crashgrid.operators.merge import upsert
from crashgrid.sources.tables import warehouse_table

# Half past two on the night clocks go forward does not exist in this zone.
GAP = "2024-03-10 02:30:00"


@pytest.fixture
def chicago(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_gap_times_survive(chicago):
    rows = chicago.createDataFrame([(GAP,)], "raw STRING").select(C.parse_datetime(F.col("raw")).alias("crash_date"))
    rows = rows.withColumns({"injuries_total": F.lit(0), "injuries_fatal": F.lit(0)})
    assert rows.select(L.iso_text(F.col("crash_date"))).first()[0] == "2024-03-10T02:30:00"
    assert rows.select(L.month_text("crash_date")).first()[0] == "2024-03"
    assert D.crashes_by_hour(rows).first()["hour"] == 2
    assert D.weekly_trends(rows).first()["week"] == "2024-03-04"


def test_durations_are_local(chicago):
    rows = chicago.createDataFrame(
        [(datetime(2024, 3, 9, 12), datetime(2024, 3, 11, 13, 1, 2, 900000))], "started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ")
    assert rows.select(L.duration_seconds()).first()[0] == 2 * 86_400 + 3_600 + 62


def test_table_parts(chicago, folder):
    table = warehouse_table(chicago, folder, S.CRASHES)
    late = datetime(2024, 1, 31, 23, 59, 59)
    rows = chicago.createDataFrame([("A", late), ("B", datetime(2024, 2, 1))], "crash_record_id STRING, crash_date TIMESTAMP_NTZ")
    upsert(table, S.CRASHES, rows, datetime(2024, 3, 10, 2, 30))
    assert sorted(table.state()["parts"]) == ["2024-01", "2024-02"]
    stored = {r["crash_record_id"]: (r["crash_date"], r["created_at"]) for r in table.read().collect()}
    assert stored["A"] == (late, datetime(2024, 3, 10, 2, 30))
