"""Location report: one region and date range, answered as a set of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrid import schemas as S
from crashgrid.functions import geo
from crashgrid.functions import predicates as P
from crashgrid.functions.labels import month_text
from crashgrid.operators import spatial
from crashgrid.operators.dashboard import (
    REPORT_POINTS,
    counters,
    newest_points,
    side_by_side,
    total,
)
from crashgrid.operators.joins import BROADCAST_ROWS, fits_broadcast, salted_join
from crashgrid.sources.exports import with_wkt_last

TOP_CAUSES = 15


@dataclass(frozen=True)
class Radius:
    latitude: float
    longitude: float
    radius_feet: float


@dataclass(frozen=True)
class Ring:
    """A drawn polygon, vertices as (lon, lat)."""

    vertices: tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Place:
    """A stored boundary: one row with ``place_id``, ``name`` and ``edges``."""

    place_type: str
    place_id: str
    boundary: DataFrame

    def edges(self) -> list[geo.Edge]:
        """Outline of the one place, fetched so that its box can be pushed to the scans; none for points and lines."""
        found = self.boundary.select("edges").first()
        if found is None:
            raise LookupError(f"place not found: {self.place_type}/{self.place_id}")
        return [tuple(e) for e in found["edges"] or ()]


Region = Radius | Ring | Place


def choose_region(
    place: Place | None = None,
    radius: Radius | None = None,
    ring: Sequence[Sequence[float]] | None = None,
) -> Region:
    """A place wins over a radius, a radius over a polygon; one of them is required."""
    if place is not None:
        return place
    if radius is not None:
        return radius
    if ring is not None and len(ring) >= 3:
        return Ring(tuple((float(v[0]), float(v[1])) for v in ring))
    raise ValueError("a report needs a place, a radius or a polygon of at least three points")


def in_region(rows: DataFrame, region: Region) -> DataFrame:
    """Located rows of any table with longitude and latitude that fall into a region."""
    located = rows.where(P.has_point())
    if isinstance(region, Radius):
        return spatial.within_radius(
            located, region.longitude, region.latitude, region.radius_feet
        )
    if isinstance(region, Ring):
        return spatial.within_ring(located, region.vertices)
    edges = region.edges()
    return spatial.within_edges(located, edges) if edges else located.where(F.lit(False))


def _kabco_count(injury: str) -> Column:
    return F.count_if(F.col("injury_classification") == injury)


PERSON_MEASURES = {
    "pedestrians_involved": lambda: F.count_if(P.is_pedestrian()),
    "cyclists_involved": lambda: F.count_if(P.is_cyclist()),
    "fatal_count": lambda: _kabco_count("FATAL"),
    "incapacitating_count": lambda: _kabco_count("INCAPACITATING INJURY"),
    "nonincapacitating_count": lambda: _kabco_count("NONINCAPACITATING INJURY"),
    "reported_not_evident_count": lambda: _kabco_count("REPORTED, NOT EVIDENT"),
    "no_indication_count": lambda: _kabco_count("NO INDICATION OF INJURY"),
    "unknown_injury_count": lambda: F.count_if(P.is_unknown_injury()),
    "children_injured": lambda: F.count_if(P.is_injured_child()),
}
KABCO_COUNTS = dict(
    zip(
        S.INJURY_COSTS,
        ("fatal_count", "incapacitating_count", "nonincapacitating_count",
         "reported_not_evident_count", "no_indication_count"),
    )
)


def _sum_of_products(pairs) -> Column:
    result = F.lit(0).cast("bigint")
    for column, unit in pairs:
        result = result + F.col(column) * F.lit(unit).cast("bigint")
    return result


class LocationReport:
    """All panels of a report over one filtered set of crashes.

    The region predicate is evaluated once when the report is used as a context manager:
    the few columns the panels need are then cached until the block ends. Outside a
    ``with`` block every panel is an independent lazy plan.
    """

    def __init__(
        self,
        crashes: DataFrame,
        people: DataFrame,
        vehicles: DataFrame,
        region: Region,
        start: datetime | None = None,
        end: datetime | None = None,
        broadcast_limit: int = BROADCAST_ROWS,
    ) -> None:
        self.people = people
        self.vehicles = vehicles
        self.region = region
        self.broadcast_limit = broadcast_limit
        dated = crashes.where(P.in_dates("crash_date", start, end))
        self.crashes = in_region(dated, region).select(
            *S.MAP_POINT_COLUMNS, "longitude", "latitude"
        )
        self._cached = False
        self._keys_fit: bool | None = None

    def __enter__(self) -> LocationReport:
        self.crashes = self.crashes.persist(StorageLevel.MEMORY_AND_DISK)
        self._cached = True
        return self

    def __exit__(self, *exc) -> None:
        if self._cached:
            self.crashes.unpersist()
            self._cached = False

    # -- panels --------------------------------------------------------------
    def _of_children(self, children: DataFrame, measures: dict[str, Column]) -> DataFrame:
        """Aggregate child rows of the region's crashes, one row.

        When the region's keys measurably fit, they are broadcast and children are only
        scanned. Otherwise children are first counted per crash, which reduces a crash with
        any number of children to one row per map task before the shuffle.
        """
        keys = self.crashes.select(
            "crash_record_id", P.is_property_damage_only().alias("property_damage_only")
        )
        if self._keys_fit is None:
            self._keys_fit = fits_broadcast(keys, limit=self.broadcast_limit)
        if self._keys_fit:
            joined = children.join(F.broadcast(keys), "crash_record_id")
            return joined.agg(*[m.alias(n) for n, m in measures.items()])
        return self._counted_first(children, keys, measures)

    @staticmethod
    def _counted_first(
        children: DataFrame, keys: DataFrame, measures: dict[str, Column]
    ) -> DataFrame:
        own = {n: m for n, m in measures.items() if n != "pdo_vehicle_count"}
        per_crash = children.groupBy("crash_record_id").agg(*[m.alias(n) for n, m in own.items()])
        joined = per_crash.join(keys, "crash_record_id")
        sums = [total(n).alias(n) for n in own]
        if "pdo_vehicle_count" in measures:
            undamaged = F.when(F.col("property_damage_only"), F.col("total_vehicles"))
            sums.append(
                F.coalesce(F.sum(undamaged), F.lit(0)).cast("bigint").alias("pdo_vehicle_count")
            )
        return joined.agg(*sums)

    def person_counts(self) -> DataFrame:
        return self._of_children(
            self.people.select(
                "crash_record_id", "person_type", "age", "injury_classification"
            ),
            {n: m() for n, m in PERSON_MEASURES.items()},
        )

    def vehicle_counts(self) -> DataFrame:
        return self._of_children(
            self.vehicles.select("crash_record_id"),
            {
                "total_vehicles": F.count("*"),
                "pdo_vehicle_count": F.count_if("property_damage_only"),
            },
        )

    def crash_counts(self) -> DataFrame:
        return self.crashes.agg(
            F.count("*").alias("total_crashes"),
            total("injuries_total").alias("total_injuries"),
            total("injuries_fatal").alias("total_fatalities"),
            total("injuries_incapacitating").alias("incapacitating_injuries"),
            F.count_if(F.col("injuries_total") > 0).alias("crashes_with_injuries"),
            F.count_if(F.col("injuries_fatal") > 0).alias("crashes_with_fatalities"),
            F.count_if(F.col("hit_and_run_i") == "Y").alias("hit_and_run_count"),
        )

    def stats(self) -> DataFrame:
        """One row: crash, person and vehicle counts with the two cost estimates."""
        counts = side_by_side(self.crash_counts(), self.person_counts(), self.vehicle_counts())
        economic_units = [
            (KABCO_COUNTS[k], economic) for k, (_, economic, _) in S.INJURY_COSTS.items()
        ]
        societal_units = [
            (KABCO_COUNTS[k], economic + qaly) for k, (_, economic, qaly) in S.INJURY_COSTS.items()
        ]
        economic_units.append(("pdo_vehicle_count", S.VEHICLE_ECONOMIC_COST))
        societal_units.append(
            ("pdo_vehicle_count", S.VEHICLE_ECONOMIC_COST + S.VEHICLE_QALY_COST)
        )
        return counts.select(
            "total_crashes", "total_injuries", "total_fatalities", "pedestrians_involved",
            "cyclists_involved", "hit_and_run_count", "incapacitating_injuries",
            "children_injured", "crashes_with_injuries", "crashes_with_fatalities",
            _sum_of_products(economic_units).alias("estimated_economic_damages"),
            _sum_of_products(societal_units).alias("estimated_societal_costs"),
            "total_vehicles", "unknown_injury_count",
        )

    def cost_breakdown(self) -> DataFrame:
        """One row per injury class, one for vehicles of damage-only crashes, one grand total."""
        counts = side_by_side(self.person_counts(), self.vehicle_counts())
        lines = [
            (n, key, label, KABCO_COUNTS[key], economic, qaly)
            for n, (key, (label, economic, qaly)) in enumerate(S.INJURY_COSTS.items())
        ]
        lines.append(
            (5, "VEHICLES", "Vehicles", "pdo_vehicle_count",
             S.VEHICLE_ECONOMIC_COST, S.VEHICLE_QALY_COST)
        )
        rows = F.array(
            *[
                F.struct(
                    F.lit(n).alias("line"), F.lit(key).alias("classification"),
                    F.lit(label).alias("classification_label"), F.col(count).alias("count"),
                    F.lit(economic).cast("bigint").alias("unit_economic_cost"),
                    F.lit(qaly).cast("bigint").alias("unit_qaly_cost"),
                )
                for n, key, label, count, economic, qaly in lines
            ]
        )
        units = F.col("unit_economic_cost") + F.col("unit_qaly_cost")
        breakdown = counts.select(F.inline(rows)).withColumns(
            {
                "subtotal_economic": F.col("count") * F.col("unit_economic_cost"),
                "subtotal_societal": F.col("count") * units,
            }
        )
        return breakdown.orderBy("line").drop("line")

    def causes(self, limit: int | None = TOP_CAUSES) -> DataFrame:
        """Leading causes, all for no limit, with their share of all crashes in the region, in percent.

        Blank and missing causes are one line, UNKNOWN. The share is rounded half up to
        one decimal in integer arithmetic.
        """
        cause = F.coalesce(
            F.nullif(F.col("prim_contributory_cause"), F.lit("")), F.lit("UNKNOWN")
        )
        leading = self.crashes.groupBy(cause.alias("cause")).agg(*counters())
        if limit is not None:
            leading = leading.orderBy(F.desc("crashes"), "cause").limit(limit)
        everything = self.crashes.agg(F.count("*").alias("n")).scalar()
        return (
            leading.withColumn("_all", everything)
            .withColumn("percentage", percent_half_up(F.col("crashes"), F.col("_all")))
            .drop("_all")
            .orderBy(F.desc("crashes"), "cause")
        )

    def monthly_trends(self, as_of: datetime) -> DataFrame:
        """Months of the last year before ``as_of``."""
        recent = self.crashes.where(F.col("crash_date") >= P.ntz(year_before(as_of)))
        return (
            recent.groupBy(month_text("crash_date").alias("month"))
            .agg(*counters())
            .orderBy("month")
        )

    def points(self, limit: int | None = REPORT_POINTS) -> DataFrame:
        return newest_points(self.crashes, limit)

    def area(self) -> DataFrame:
        """One row: GeoJSON Feature of the reported area."""
        return region_feature(self.people.sparkSession, self.region)


def year_before(moment: datetime) -> datetime:
    try:
        return moment.replace(year=moment.year - 1)
    except ValueError:
        return moment.replace(year=moment.year - 1, day=28)


def percent_half_up(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent with one decimal, rounded half up without fractions."""
    numerator = part * 2000 + whole
    tenths = (numerator - numerator % (whole * 2)) / (whole * 2)
    return tenths / F.lit(10.0)


def person_subtotals(breakdown: DataFrame) -> DataFrame:
    """Count and costs of the person lines of a cost breakdown."""
    people = breakdown.where(F.col("classification") != "VEHICLES")
    return people.agg(
        total("count").alias("person_count"),
        total("subtotal_economic").alias("person_economic_total"),
        total("subtotal_societal").alias("person_societal_total"),
    )


def monthly_averages(months: DataFrame) -> DataFrame:
    """Rounded averages per month and the fatality total."""
    listed = F.count("*")

    def average(column: str) -> Column:
        mean = F.sum(column) / F.nullif(listed, F.lit(0))
        return F.coalesce(F.floor(mean + F.lit(0.5)), F.lit(0)).cast("bigint")

    return months.agg(
        average("crashes").alias("avg_crashes"),
        average("injuries").alias("avg_injuries"),
        total("fatalities").alias("total_fatalities"),
    )


def region_feature(spark, region: Region) -> DataFrame:
    """The reported area as a GeoJSON Feature; a radius becomes a 64-step ring."""
    one = spark.range(1)
    if isinstance(region, Radius):
        km = region.radius_feet * S.FEET_TO_METERS / 1000
        ring = geo.circle_ring(F.lit(region.longitude), F.lit(region.latitude), F.lit(km))
        properties = F.struct(
            F.lit("radius").alias("type"),
            F.array(F.lit(region.longitude), F.lit(region.latitude)).alias("center"),
            F.lit(region.radius_feet).alias("radius_feet"),
        )
        return one.select(geo.polygon_feature(ring, properties).alias("feature"))
    if isinstance(region, Ring):
        ring = F.array(
            *[F.array(F.lit(x), F.lit(y)) for x, y in geo.close_ring(region.vertices)]
        )
        properties = F.struct(F.lit("polygon").alias("type"))
        return one.select(geo.polygon_feature(ring, properties).alias("feature"))
    properties = F.struct(
        F.lit("place").alias("type"), F.lit(region.place_type).alias("place_type"),
        F.lit(region.place_id).alias("place_id"), F.col("name"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("MultiPolygon").alias("type"), F.col("polygons").alias("coordinates")
        ).alias("geometry"),
        properties.alias("properties"),
    )
    return region.boundary.select(F.to_json(feature).alias("feature"))


def export_rows(
    datasets: Sequence[str],
    tables: dict[str, DataFrame],
    region: Region,
    start: datetime | None = None,
    end: datetime | None = None,
) -> dict[str, DataFrame]:
    """Rows of each requested dataset that belong to a report, ready for CSV.

    ``tables`` is keyed by warehouse table name. People and vehicles follow their crash.
    """
    unknown = [d for d in datasets if d not in S.EXPORT_DATASETS]
    if unknown or not datasets:
        raise ValueError(f"invalid datasets: {', '.join(unknown) or 'none given'}")
    in_range = P.in_dates("crash_date", start, end)
    result = {}
    for dataset in datasets:
        spec = S.EXPORT_DATASETS[dataset]
        rows = tables[spec.name]
        if spec.has_point:
            result[dataset] = with_wkt_last(in_region(rows.where(in_range), region))
        else:
            region_crashes = in_region(tables["crashes"].where(in_range), region)
            keys = region_crashes.select("crash_record_id")
            result[dataset] = _children(rows, keys, spec).select(*rows.columns)
    return result


def _children(rows: DataFrame, keys: DataFrame, spec: S.TableSpec) -> DataFrame:
    # Crash ids are unique, so this inner join is a semi-join.
    if fits_broadcast(keys):
        return rows.join(F.broadcast(keys), "crash_record_id", "left_semi")
    spread = [k for k in spec.keys if k != "crash_record_id"]
    return salted_join(rows, keys, ["crash_record_id"], spread)
