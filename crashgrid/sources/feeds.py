"""Landed feeds: folders of JSON rows whose every value is text or null."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrid import schemas as S
from crashgrid.functions.predicates import all_of

PAGE_ROWS = 50_000
UPDATED_AT = S.UPDATED_AT


def scan_feed(
    spark: SparkSession,
    path: str,
    dataset: str,
    select: Sequence[str] | None = None,
    where: str | Column | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Read a landed feed with an explicit all-text schema, so nothing is inferred."""
    rows = spark.read.schema(S.raw_schema(S.BY_DATASET[dataset])).json(path)
    if where is not None:
        rows = rows.where(where)
    if order_by:
        rows = rows.orderBy(*[F.col(f"`{c}`") for c in order_by])
    return rows.select(*[F.col(f"`{c}`") for c in select]) if select else rows


def date_window(field: str, start: str | None = None, end: str | None = None) -> Column:
    """Days of an ingest window, compared as ISO text like the feed does.

    The end bound is exclusive at 23:59:59, so the last second of the end day is left out.
    """
    bounds = []
    if start:
        bounds.append(F.col(field) >= f"{start}T00:00:00")
    if end:
        bounds.append(F.col(field) < f"{end}T23:59:59")
    return all_of(bounds)


DAY, MONTH = 10, 7  # letters of an ISO date that name a folder
FOLDER = "landed_for"
UNDATED = "undated"


def _folder(field: Column, letters: int) -> Column:
    return F.when(field.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(field, 1, letters)).otherwise(UNDATED)


def land_by_date(rows: DataFrame, path: str, field: str = "crash_date", letters: int = DAY) -> None:
    """Land rows in one folder per day, or per month; what is no ISO date shares a folder.

    A day with most of the rows is written by several tasks.
    """
    text = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])
    laid_out = text.withColumn(FOLDER, _folder(F.col(field), letters)).hint("rebalance", FOLDER)
    laid_out.write.mode("errorifexists").option("ignoreNullFields", "false").partitionBy(FOLDER).json(path)


def scan_dates(
    spark: SparkSession, path: str, dataset: str, start: str | None = None, end: str | None = None,
    field: str = "crash_date",
) -> DataFrame:
    """Rows of an ingest window from a landing laid out by date: the rows ``date_window`` keeps, but only the folders
    of the window, and that of undated rows, are listed."""
    schema = S.raw_schema(S.BY_DATASET[dataset]).add(FOLDER, "string")
    rows = spark.read.schema(schema).json(path)
    folder, wanted = F.col(FOLDER), F.lit(True)
    if start:
        wanted = wanted & (folder >= F.substring(F.lit(start), 1, MONTH))
    if end:
        wanted = wanted & (F.substring(folder, 1, DAY) <= end)
    return rows.where(wanted | (folder == UNDATED)).where(date_window(field, start, end)).drop(FOLDER)


def updated_since(rows: DataFrame, cursor: datetime) -> DataFrame:
    """Rows changed after the last sync, oldest change first."""
    mark = cursor.strftime("%Y-%m-%dT%H:%M:%S")
    return rows.where(F.col(f"`{UPDATED_AT}`") > mark).orderBy(f"`{UPDATED_AT}`")


def next_cursor(rows: DataFrame) -> DataFrame:
    """Latest change in a batch, to start the next incremental scan from."""
    return rows.agg(F.max(f"`{UPDATED_AT}`").alias("cursor"))


def page(rows: DataFrame, index: int, order: Sequence[str], size: int = PAGE_ROWS) -> DataFrame:
    """Rows ``[index * size, (index + 1) * size)`` in a total order.

    A top-k of ``(index + 1) * size`` rows: for early pages. Walk deep into a feed with
    :func:`pages`, and read whole feeds with :func:`scan_feed`, which splits by file.
    """
    return rows.orderBy(*order).offset(index * size).limit(size)


def page_after(
    rows: DataFrame, cursor: Sequence | None, order: Sequence[str], size: int = PAGE_ROWS
) -> DataFrame:
    """The page that follows a cursor (the order values of the last row seen).

    The cost is the same for every page: a filter and a top-k of one page.
    """
    if cursor is not None:
        position = F.struct(*[F.col(c) for c in order])
        mark = F.struct(*[F.lit(v).alias(c) for c, v in zip(order, cursor)])
        # The leading bound repeats part of the test in a form the scan can push down.
        leading = F.lit(True) if cursor[0] is None else F.col(order[0]) >= cursor[0]
        rows = rows.where(leading & (position > mark))
    return rows.orderBy(*order).limit(size)


def pages(rows: DataFrame, order: Sequence[str], size: int = PAGE_ROWS) -> Iterator[DataFrame]:
    """Every page in turn; the driver holds only the cursor. Ends at a short page."""
    cursor = None
    while True:
        batch = page_after(rows, cursor, order, size)
        tail = batch.agg(
            F.count("*").alias("n"), F.max(F.struct(*order)).alias("last")
        ).first()
        if tail["n"] == 0:
            return
        yield batch
        if tail["n"] < size:
            return
        cursor = tuple(tail["last"])


def count_rows(rows: DataFrame, where: str | Column | None = None) -> DataFrame:
    """Filtered row count, one row."""
    return (rows if where is None else rows.where(where)).agg(F.count("*").alias("count"))


def sample_rows(rows: DataFrame, n: int | None = 100, order: Sequence[str] = ()) -> DataFrame:
    """First rows of a feed, all for None, for connection tests and validation."""
    if n is not None and not 1 <= n <= 1000:
        raise ValueError(f"sample size must be between 1 and 1000, got {n}")
    ordered = rows.orderBy(*order) if order else rows
    return ordered if n is None else ordered.limit(n)


def land(rows: DataFrame, path: str) -> None:
    """Write rows the way a feed is landed: JSON lines, every value text or null."""
    text = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])
    text.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
