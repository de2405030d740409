"""Filter predicates and category expressions over the warehouse tables."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, time

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashgrid import schemas as S


def end_of_day(end: datetime | None) -> datetime | None:
    """An end given as a bare date (midnight) covers that whole day."""
    if end is not None and end.time() == time.min:
        return datetime.combine(end.date(), time.max)
    return end


def ntz(moment: datetime) -> Column:
    """Literal local timestamp, independent of the session time zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def all_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(True)
    for n, condition in enumerate(conditions):
        result = condition if n == 0 else result & condition
    return result


def in_dates(column: str, start: datetime | None = None, end: datetime | None = None) -> Column:
    """Inclusive date range; a bound that is not given adds no predicate at all."""
    bounds = []
    if start is not None:
        bounds.append(F.col(column) >= ntz(start))
    if end is not None:
        bounds.append(F.col(column) <= ntz(end_of_day(end)))
    return all_of(bounds)


def has_point(lon: str = "longitude", lat: str = "latitude") -> Column:
    return F.col(lon).isNotNull() & F.col(lat).isNotNull()


def is_pedestrian(person_type: str = "person_type") -> Column:
    return F.col(person_type).ilike("%PEDESTRIAN%")


def is_cyclist(person_type: str = "person_type") -> Column:
    # PEDALCYCLIST contains CYCLIST, so two patterns cover the three published ones.
    kind = F.col(person_type)
    return kind.ilike("%BICYCLE%") | kind.ilike("%CYCLIST%")


def is_unknown_injury(injury: str = "injury_classification") -> Column:
    return ~F.coalesce(F.col(injury).isin(*S.INJURY_COSTS), F.lit(False))


def is_injured_child(age: str = "age", injury: str = "injury_classification") -> Column:
    years = F.col(age)
    return (years >= 0) & (years < 18) & F.col(injury).isin(*S.INJURED_CLASSES)


def is_property_damage_only() -> Column:
    return (F.coalesce(F.col("injuries_total"), F.lit(0)) == 0) & (
        F.coalesce(F.col("injuries_fatal"), F.lit(0)) == 0
    )


def outside_bounds() -> Column:
    """Latitude present and either coordinate out of the served area.

    A missing longitude counts only when the latitude alone is already out.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    lat_out = ~lat.between(S.MIN_LATITUDE, S.MAX_LATITUDE)
    lon_out = ~lon.between(S.MIN_LONGITUDE, S.MAX_LONGITUDE)
    return lat.isNotNull() & (lat_out | lon_out)


def _count(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def severity() -> Column:
    """Worst outcome of a crash, as coloured on the map."""
    fatal, incapacitating, other, none = S.SEVERITIES
    return (
        F.when(_count("injuries_fatal") > 0, fatal)
        .when(_count("injuries_incapacitating") > 0, incapacitating)
        .when(_count("injuries_total") > 0, other)
        .otherwise(none)
    )


def hit_and_run_category() -> Column:
    return F.when(F.col("hit_and_run_i") == "Y", "Hit and Run").otherwise("Not Hit and Run")


def crash_type_category() -> Column:
    kind = F.col("crash_type")
    return (
        F.when(kind == "PEDESTRIAN", "Pedestrian")
        .when(kind == "PEDALCYCLIST", "Pedalcyclist")
        .otherwise("Other")
    )


CATEGORIES = {
    "severity": severity,
    "hit_and_run": hit_and_run_category,
    "crash_type": crash_type_category,
}


def in_categories(metric: str, visible: Iterable[str]) -> Column:
    """Rows whose category is switched on; nothing switched on keeps nothing."""
    labels = list(visible)
    return CATEGORIES[metric]().isin(*labels) if labels else F.lit(False)


def required_present(spec: S.TableSpec) -> Column:
    """Row can be stored: key parts non-empty, other required columns non-null."""
    checks = []
    for name in spec.required:
        column = F.col(name)
        checks.append(column.isNotNull())
        if name in spec.keys:
            checks.append(column != "")
    return all_of(checks)
