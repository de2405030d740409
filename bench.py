"""Time the headline queries and print one JSON line.

Tables come from ``$BENCH_SF_DIR``, cores from ``$BENCH_CPUS``. They are first loaded into crash
tables (``load`` in the result, not part of the total), as the dashboard's own queries run over
a loaded warehouse. Every query is warmed up once and then timed; results are fully computed
through the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import functions as F

from crashgrid import schemas as S
from crashgrid.checks import queries as Q
from crashgrid.checks.fixtures import store_views, view
from crashgrid.functions import predicates as P
from crashgrid.operators.merge import upsert
from crashgrid.session import local_session, new_folder
from crashgrid.sources.tables import warehouse_table

HEADLINE = (
    "dashboard_stats", "weekly_trends", "crashes_by_cause", "report_stats_radius",
    "report_stats_polygon", "report_stats_place", "crashes_per_place", "crashes_per_zone",
    "nearest_place", "crashes_near_sites", "sanitize_crashes", "remove_duplicates",
    "vehicle_occupants",
)
UPSERT_ROWS = 50_000
REPEATS = 2
TABLE_FILES = 8


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def consume(rows) -> None:
    rows.write.format("noop").mode("overwrite").save()


def bench_upsert(spark, sf_dir: str) -> float:
    """Merge a 50,000-row batch, half amended and half new, into a loaded crash table."""
    crashes = view(spark, sf_dir, "fx_crashes")
    newest = crashes.orderBy(F.desc("crash_date"), "crash_record_id").limit(UPSERT_ROWS)
    half = newest.select(F.expr("percentile(unix_timestamp(crash_date), 0.5)").alias("t")).first()["t"]
    cut = F.timestamp_seconds(F.lit(int(half))).cast("timestamp_ntz")
    table = warehouse_table(spark, new_folder(spark, "bench"), S.CRASHES)
    stored = Q.full(crashes.where(F.col("crash_date") < cut), S.CRASHES)
    table.load(stored.withColumns({"created_at": P.ntz(Q.NOW), "updated_at": P.ntz(Q.NOW)}))
    batch = newest.withColumn("injuries_total", F.col("injuries_total") + 1)
    return timed(lambda: upsert(table, S.CRASHES, batch, now=Q.NOW))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    load = timed(lambda: store_views(spark, sf_dir, new_folder(spark, "bench"), TABLE_FILES))
    seconds = {}
    for name in HEADLINE:
        run = Q.QUERIES[name]
        consume(run(spark, sf_dir))
        best = min(timed(lambda: consume(run(spark, sf_dir))) for _ in range(REPEATS))
        seconds[name] = round(best, 3)
    bench_upsert(spark, sf_dir)
    seconds["upsert_50k"] = round(min(bench_upsert(spark, sf_dir) for _ in range(REPEATS)), 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "load": round(load, 3),
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
