"""Helpers shared by the corpus operators: table access and intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrid.session import new_folder

# Fixed values of the contracts: what separates words, and what a word is.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_watching: list[list[str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are removed at the end.

    Whatever is to outlive them must have been written before that.
    """
    _watching.append([])
    try:
        yield
    finally:
        for path in _watching.pop():
            _remove(spark, path)


def stored(rows: DataFrame, purpose: str, outlives: bool = False) -> DataFrame:
    """Write rows to the shared folder and read them back.

    Cuts the lineage: lost executors cost only the tasks they ran, never the steps before. The
    folder goes when the driver's JVM ends, or with the innermost ``passing``; one that ``outlives``
    it goes with the next one around it.
    """
    spark = rows.sparkSession
    path = new_folder(spark, purpose)
    if len(_watching) > outlives:
        _watching[-1 - outlives].append(path)
    rows.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(rows.schema).parquet(path)


def words_of(text: str | Column) -> Column:
    """Array of the words of a text; empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` as a variable."""
    return F.transform(F.array(value), use)[0]
