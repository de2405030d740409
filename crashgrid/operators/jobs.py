"""Queries over the refresh-job history."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrid import schemas as S
from crashgrid.functions.predicates import ntz
from crashgrid.operators.joins import fits_broadcast
from crashgrid.sources.tables import append_rows

HISTORY_ROWS = 50
MAX_HISTORY_ROWS = 200


def job_history(
    executions: DataFrame,
    jobs: DataFrame,
    job_id: int | None = None,
    limit: int | None = HISTORY_ROWS,
    offset: int = 0,
    newest_by: str = "started_at",
) -> DataFrame:
    """Latest executions with the name and type of their job, all for no limit."""
    if limit is not None and not 1 <= limit <= MAX_HISTORY_ROWS:
        raise ValueError(f"limit must be between 1 and {MAX_HISTORY_ROWS}, got {limit}")
    chosen = executions if job_id is None else executions.where(F.col("job_id") == job_id)
    names = jobs.select(F.col("id").alias("job_id"), "name", "job_type")
    if fits_broadcast(names):
        names = F.broadcast(names)
    # The limit is taken after the join: an execution of a deleted job is not listed.
    joined = chosen.join(names, "job_id")
    newest = joined.orderBy(F.desc_nulls_first(newest_by), "execution_id")
    newest = newest.offset(offset) if offset else newest
    return newest if limit is None else newest.limit(limit)


def job_summary(jobs: DataFrame, executions: DataFrame, as_of: datetime) -> DataFrame:
    """One row: jobs, enabled jobs, running now, failed within a day, latest start."""
    recent = F.col("started_at") >= ntz(as_of - timedelta(hours=24))
    of_jobs = jobs.agg(
        F.count("*").alias("total_jobs"), F.count_if("enabled").alias("active_jobs")
    )
    of_runs = executions.agg(
        F.count_if(F.col("status") == "running").alias("running_jobs"),
        F.count_if((F.col("status") == "failed") & recent).alias("failed_jobs_24h"),
        F.max("started_at").alias("last_execution"),
    )
    both = of_jobs.unionByName(of_runs, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def latest_execution_per_job(executions: DataFrame) -> DataFrame:
    """Newest execution of every job and whether the job is running."""
    newest = F.max_by(
        F.struct("execution_id", "status", "started_at"), F.struct("started_at", "execution_id")
    )
    return (
        executions.groupBy("job_id")
        .agg(newest.alias("last"), F.count_if(F.col("status") == "running").alias("running"))
        .select("job_id", "last.*", (F.col("running") > 0).alias("already_running"))
    )


def record_run(
    spark: SparkSession,
    path: str,
    execution_id: str,
    job_id: int,
    status: str,
    started_at: datetime,
    completed_at: datetime,
    processed: int = 0,
    inserted: int = 0,
    updated: int = 0,
    skipped: int = 0,
) -> None:
    """Append the metrics of one refresh run."""
    seconds = int((completed_at - started_at).total_seconds())
    append_rows(
        spark, path, S.RUN_METRICS_DDL,
        [(execution_id, job_id, status, started_at, completed_at, seconds,
          processed, inserted, updated, skipped)],
    )
