"""Headline numbers, trends, rankings and map points of the dashboard."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrid import schemas as S
from crashgrid.functions import predicates as P
from crashgrid.functions.geo import in_box

DEFAULT_MAP_POINTS = 10_000
REPORT_POINTS = 5_000


def total(column: str) -> Column:
    """Sum that is zero, not null, over no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def counters() -> list[Column]:
    """The three measures every trend and ranking reports."""
    return [
        F.count("*").alias("crashes"),
        total("injuries_total").alias("injuries"),
        total("injuries_fatal").alias("fatalities"),
    ]


def side_by_side(*single_rows: DataFrame) -> DataFrame:
    """Put one-row frames with different columns next to each other without a join."""
    stacked = single_rows[0]
    for row in single_rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[total(c).alias(c) for c in stacked.columns])


def dashboard_stats(
    crashes: DataFrame,
    people: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    date_from: str = "person",
) -> DataFrame:
    """Totals of the metric cards, one row.

    ``date_from="person"`` filters people on their own crash date, as published;
    ``"crash"`` uses the parent crash, for feeds whose people rows carry no date.
    """
    in_range = crashes.where(P.in_dates("crash_date", start, end))
    crash_totals = in_range.agg(
        F.count("*").alias("total_crashes"),
        total("injuries_total").alias("total_injuries"),
        total("injuries_fatal").alias("total_fatalities"),
        F.count_if(F.col("hit_and_run_i") == "Y").alias("hit_and_run_count"),
    )
    involved = [
        F.count_if(P.is_pedestrian()).alias("pedestrians_involved"),
        F.count_if(P.is_cyclist()).alias("cyclists_involved"),
    ]
    if date_from == "person":
        person_totals = people.where(P.in_dates("crash_date", start, end)).agg(*involved)
    elif date_from == "crash":
        # Counting per crash first keeps one crowded crash from becoming one slow task.
        per_crash = people.groupBy("crash_record_id").agg(*involved)
        person_totals = per_crash.join(in_range.select("crash_record_id"), "crash_record_id").agg(
            total("pedestrians_involved").alias("pedestrians_involved"),
            total("cyclists_involved").alias("cyclists_involved"),
        )
    else:
        raise ValueError(f"date_from must be 'person' or 'crash', got {date_from!r}")
    return side_by_side(crash_totals, person_totals).select(
        "total_crashes", "total_injuries", "total_fatalities", "pedestrians_involved",
        "cyclists_involved", "hit_and_run_count",
    )


def week_start(stamp: str = "crash_date") -> Column:
    """Monday of the ISO week, by date arithmetic so that no time zone is involved."""
    day = F.col(stamp).cast("date")
    return F.date_sub(day, F.weekday(day))


def weekly_trends(
    crashes: DataFrame, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    dated = crashes.where(F.col("crash_date").isNotNull() & P.in_dates("crash_date", start, end))
    weekly = dated.groupBy(week_start().alias("week_start")).agg(*counters())
    return weekly.orderBy("week_start").select(
        F.col("week_start").cast("string").alias("week"), "crashes", "injuries", "fatalities"
    )


def crashes_by_hour(
    crashes: DataFrame, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    dated = crashes.where(F.col("crash_date").isNotNull() & P.in_dates("crash_date", start, end))
    return dated.groupBy(F.hour("crash_date").alias("hour")).agg(*counters()).orderBy("hour")


def crashes_by_cause(
    crashes: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = 10,
) -> DataFrame:
    """Leading causes by crash count, all for no limit; blank causes are left out, ties go by name."""
    _positive(limit)
    cause = F.col("prim_contributory_cause")
    named = crashes.where(
        cause.isNotNull() & (cause != "") & P.in_dates("crash_date", start, end)
    )
    return (
        named.groupBy(cause.alias("cause"))
        .agg(*counters())
        .orderBy(F.desc("crashes"), "cause")
        .transform(lambda rows: _top(rows, limit))
    )


def _positive(limit: int | None) -> None:
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")


def _top(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def newest_points(crashes: DataFrame, limit: int | None = None) -> DataFrame:
    """Map columns of the newest located crashes, all for no limit; undated rows lead, as newest."""
    return (
        crashes.where(P.has_point())
        .select(*S.MAP_POINT_COLUMNS, "longitude", "latitude")
        .orderBy(F.desc_nulls_first("crash_date"), "crash_record_id")
        .transform(lambda rows: _top(rows, limit))
    )


def crash_points(
    crashes: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = DEFAULT_MAP_POINTS,
) -> DataFrame:
    """Newest located crashes of a date range."""
    _positive(limit)
    return newest_points(crashes.where(P.in_dates("crash_date", start, end)), limit)


def density_grid(
    crashes: DataFrame,
    cell: float,
    box: tuple[float, float, float, float] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Crash counts per square grid cell, for heat maps."""
    located = crashes.where(P.has_point() & P.in_dates("crash_date", start, end))
    if box is not None:
        located = located.where(in_box(F.col("longitude"), F.col("latitude"), box))
    cells = [
        F.floor(F.col("longitude") / cell).alias("cell_x"),
        F.floor(F.col("latitude") / cell).alias("cell_y"),
    ]
    return located.groupBy(*cells).agg(*counters())


def category_counts(crashes: DataFrame, metric: str) -> DataFrame:
    """How many crashes fall into each legend entry of a map metric."""
    return crashes.groupBy(P.CATEGORIES[metric]().alias("category")).agg(*counters())


def map_layer(rows: DataFrame, table: str) -> DataFrame:
    """Columns a map layer exposes; those the rows lack are null text."""
    return rows.select(
        *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in S.MAP_LAYER_COLUMNS[table]]
    )


def coordinate_outliers(crashes: DataFrame) -> DataFrame:
    """Crashes whose coordinates fall out of the served area."""
    return crashes.where(P.outside_bounds())


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and the grand total; counts come from Parquet footers."""
    counts = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("record_count")).select(
            F.lit(name).alias("table_name"), "record_count"
        )
        counts = one if counts is None else counts.unionByName(one)
    # One rollup, so that no table is counted a second time for the total.
    return counts.rollup("table_name").agg(F.sum("record_count").alias("record_count")).select(
        F.coalesce("table_name", F.lit("total")).alias("table_name"), "record_count"
    )
