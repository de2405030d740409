"""Validation of records: required fields and coordinate bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashgrid import schemas as S
from crashgrid.functions import cleaning as C
from crashgrid.operators.sanitize import sanitize


def _missing(rows: DataFrame, field: str) -> Column:
    """Null, blank or zero: a required value nobody filled in."""
    if field not in rows.columns:
        return F.lit(True)
    column = F.col(field)
    kind = rows.schema[field].dataType
    if isinstance(kind, T.StringType):
        return column.isNull() | (column == "")
    if isinstance(kind, T.NumericType):
        return column.isNull() | (column == 0)
    return column.isNull()


def _coordinate_warning(name: str, column: str, low: float, high: float) -> Column:
    """A number out of bounds, or text that is no number; NaN compares with nothing."""
    given = F.col(column).cast("string")
    value = C.clean_float(given)
    outside = F.concat(F.lit(f"{name} "), value.cast("string"), F.lit(f" outside {S.BOUNDS_AREA} bounds"))
    unread = F.concat(F.lit(f"{name} "), given, F.lit(" is not a number"))
    return F.when(value.isNull() & given.isNotNull(), unread).when(
        ~F.isnan(value) & (value != 0) & ((value < low) | (value > high)), outside
    )


def _bounds_warnings(rows: DataFrame) -> Column:
    if not {"latitude", "longitude"} <= set(rows.columns):
        return F.array().cast("array<string>")
    given = ~_missing(rows, "latitude") & ~_missing(rows, "longitude")
    checks = F.array(
        _coordinate_warning("Latitude", "latitude", S.MIN_LATITUDE, S.MAX_LATITUDE),
        _coordinate_warning("Longitude", "longitude", S.MIN_LONGITUDE, S.MAX_LONGITUDE),
    )
    return F.when(given, F.array_compact(checks)).otherwise(F.array().cast("array<string>"))


def validate(rows: DataFrame, dataset: str = "crashes") -> DataFrame:
    """Append ``errors``, ``warnings`` and ``valid``. Warnings never make a row invalid."""
    errors = F.array(
        *[
            F.when(_missing(rows, f), F.lit(f"Missing required field: {f}"))
            for f in S.REQUIRED_FIELDS[dataset]
        ]
    )
    return rows.withColumns(
        {"errors": F.array_compact(errors), "warnings": _bounds_warnings(rows)}
    ).withColumn("valid", F.size("errors") == 0)


def validation_summary(validated: DataFrame) -> DataFrame:
    """One row: how many records, how many valid, how many messages."""
    return validated.agg(
        F.count("*").alias("total_records"),
        F.count_if("valid").alias("valid_records"),
        F.count_if(~F.col("valid")).alias("invalid_records"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("total_errors"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("total_warnings"),
    )


def validation_messages(raw: DataFrame, dataset: str, record_key: str) -> DataFrame:
    """One row per message. Crash records are cleaned and checked; other feeds pass."""
    if dataset == "crashes":
        checked = validate(sanitize(dataset, raw, carry=[record_key]))
    else:
        nothing = F.array().cast("array<string>")
        checked = raw.withColumns({"errors": nothing, "warnings": nothing})
    tagged = F.concat(
        F.transform("errors", lambda m: F.struct(F.lit("error").alias("level"), m.alias("message"))),
        F.transform(
            "warnings", lambda m: F.struct(F.lit("warning").alias("level"), m.alias("message"))
        ),
    )
    return checked.select(record_key, F.inline(tagged))
