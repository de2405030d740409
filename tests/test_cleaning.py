from __future__ import annotations

import math
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crashgrid.functions import cleaning as C


def apply(spark, rule, values, **options):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    out = rows.select("i", rule(F.col("v"), **options).alias("o")).orderBy("i").collect()
    return [r["o"] for r in out]


STRINGS = {
    "  TEST  ": "TEST", None: None, "": None, "NULL": None, "N/A": None, "unknown": None,
    "Unk": None, "   ": None, "MULTI   SPACE   STRING": "MULTI SPACE STRING",
    "a\tb\n\nc": "a b c", " x　y ": "x y", "\x1fz\x1c": "z", "unknown road": "unknown road",
}
INTEGERS = {
    "123": 123, "123.0": 123, "123.7": 123, "-1.7": -1, " 12 ": 12, "1e2": 100, "+5": 5, "1_000": 1000,
    ".5": 0, "5.": 5, None: None, "": None, "invalid": None, "NULL": None, "N/A": None, "1.0d": None,
    "1.5f": None, "nan": None, "inf": None, "1__0": None, "_1": None, "99999999999": None, "0x1A": None,
}
FLOATS = {
    "123.45": 123.45, "123": 123.0, "1e-3": 0.001, "-0.5": -0.5, None: None, "": None, "invalid": None,
    "1.0d": None, "n/a": None, "Infinity": math.inf, "+inf": math.inf,
}
DATES = {
    "2024-01-01T12:30:00.000": datetime(2024, 1, 1, 12, 30),
    "2024-01-01T12:30:00.123456": datetime(2024, 1, 1, 12, 30, 0, 123456),
    "2024-01-01T12:30:00": datetime(2024, 1, 1, 12, 30),
    "2024-01-01 12:30:00": datetime(2024, 1, 1, 12, 30),
    "2024-01-01": datetime(2024, 1, 1),
    "2024-1-2 3:4:5": datetime(2024, 1, 2, 3, 4, 5),
    "01/02/2024 01:30:00 PM": datetime(2024, 1, 2, 1, 30),
    "01/02/2024 13:30:00 am": datetime(2024, 1, 2, 13, 30),
    "3/4/2021": datetime(2021, 3, 4),
    "invalid-date": None, None: None, "": None, "2024-13-01": None, "2024-02-30": None,
    "2024-01-01T12:30:00Z": None, "2024-01-01T12:30:00+05:00": None, "2024-01-01 12:30": None,
    "2024-01-01T12:30:60": None, "2024-01-01 12:30:00.5": None, "01/02/2024 01:30:00": None,
    "20240101": None, "12024-01-01": None,
}


@pytest.mark.parametrize(
    "rule, cases",
    [(C.clean_string, STRINGS), (C.clean_integer, INTEGERS), (C.clean_float, FLOATS),
     (C.parse_datetime, DATES)],
    ids=["string", "integer", "float", "datetime"],
)
def test_scalar_cases(spark, rule, cases):
    got = dict(zip(cases, apply(spark, rule, list(cases))))
    assert got == cases


def test_truncation(spark):
    assert apply(spark, C.clean_string, ["A" * 200], max_length=10) == ["A" * 10]


def test_nan_is_a_float(spark):
    assert math.isnan(apply(spark, C.clean_float, ["NaN"])[0])


def test_twelve_hour_option(spark):
    values = ["01/02/2024 01:30:00 PM", "01/02/2024 12:30:00 AM", "01/02/2024 13:30:00 PM", "3/4/2021"]
    assert apply(spark, C.parse_datetime, values, strict_ampm=True) == [
        datetime(2024, 1, 2, 13, 30), datetime(2024, 1, 2, 0, 30), None, datetime(2021, 3, 4),
    ]


@pytest.mark.parametrize(
    "rule, kept, dropped",
    [
        (C.clean_latitude, ["41.8781", "41.6", "42.1"], ["50.0", "41.5999", "nan", "x", None]),
        (C.clean_longitude, ["-87.6298", "-87.95", "-87.5"], ["-95.0", "87.6", "inf", ""]),
        (C.clean_age, ["25", "0", "120"], ["-5", "150", "invalid"]),
        (C.clean_vehicle_year, ["2020", "1950", "2025"], ["1800", "2030", "invalid"]),
    ],
)
def test_bounds(spark, rule, kept, dropped):
    assert apply(spark, rule, kept) == [float(v) for v in kept]
    assert apply(spark, rule, dropped) == [None] * len(dropped)


def python_clean_string(text):
    cleaned = " ".join(text.split())
    return None if cleaned == "" or cleaned.upper() in ("NULL", "N/A", "UNKNOWN", "UNK") else cleaned


TEXT = st.text(alphabet=st.sampled_from("ab \t\n  　\x1c\x85Nn/AuUkKl"), max_size=12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(TEXT, min_size=200, max_size=200))
def test_clean_string_matches_whitespace_rules(spark, values):
    assert apply(spark, C.clean_string, values) == [python_clean_string(v) for v in values]


def python_integer(text):
    try:
        value = int(float(text.strip()))
    except (ValueError, OverflowError):
        return None
    return value if -(2**31) <= value < 2**31 else None


NUMBERISH = st.text(alphabet=st.sampled_from("0123456789.-+eE_ x"), max_size=8)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(NUMBERISH, min_size=300, max_size=300))
def test_clean_integer_matches_number_rules(spark, values):
    assert apply(spark, C.clean_integer, values) == [python_integer(v) for v in values]
