"""Scalar cleaning rules as native column expressions.

Nothing here runs Python per row. Parsing is guarded by a pattern and then handed to
Spark's own ``try_cast``, so a malformed value becomes null and never fails a job under
ANSI mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashgrid import schemas as S

# Unicode whitespace as the feed's cleaner understands it; Java's \s is ASCII only.
_NON_SPACE = r"\t-\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_RUN = rf"[ {_NON_SPACE}]{{2,}}|[{_NON_SPACE}]"

_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_NON_FINITE = r"^[+-]?(?:NAN|INF|INFINITY)$"

_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
_ISO = rf"^(?!0000)\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:T{_CLOCK}(?:\.\d{{1,6}})?| {_CLOCK})?$"
_US = rf"^(\d{{1,2}})/(\d{{1,2}})/(?!0000)(\d{{4}})(?: ({_CLOCK}) [AP]M)?$"


# ASCII control characters that count as whitespace.
_CONTROLS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"


def _irregular(text: Column) -> Column:
    """Whether text may hold whitespace other than single spaces.

    Byte searches only; nearly all values of a feed pass without meeting the pattern.
    """
    suspects = text.contains("  ") | (F.octet_length(text) != F.char_length(text))
    for control in _CONTROLS:
        suspects = suspects | text.contains(control)
    return suspects


def unusual(values: Sequence[Column]) -> Column:
    """Whether any value may hold whitespace other than spaces: one search for a whole record."""
    return F.coalesce(F.concat_ws("", *values).rlike("[^ -~]"), F.lit(False))


def squeeze(value: Column, suspect: Column | None = None) -> Column:
    """Collapse whitespace runs to one space and strip both ends.

    ``suspect`` says that the value may hold whitespace other than spaces, where that is known already.
    """
    text = value.cast("string")
    search = _irregular(text) if suspect is None else suspect | text.contains("  ")
    return F.trim(F.when(search, F.regexp_replace(text, _RUN, " ")).otherwise(text))


# The rules below squeeze their value first, unless it is ``squeezed`` already.


def clean_string(value: Column, max_length: int | None = None, squeezed: bool = False) -> Column:
    """Squeezed text; blank and the usual null words become null."""
    text = value if squeezed else squeeze(value)
    kept = F.substring(text, 1, max_length) if max_length else text
    # Values of another length than all null words, the most, need not be put in capitals.
    lengths = sorted({len(word) for word in S.NULL_TOKENS})
    word = F.octet_length(text).isin(*lengths) & F.upper(text).isin(*S.NULL_TOKENS)
    return F.when((text != "") & ~word, kept)


def clean_float(value: Column, squeezed: bool = False) -> Column:
    """Number from text, else null. Accepts signs, exponents, digit underscores, nan and inf."""
    text = value if squeezed else squeeze(value)
    finite = F.when(text.rlike(_NUMBER), F.translate(text, "_", ""))
    special = F.when(F.upper(text).rlike(_NON_FINITE), F.ltrim(text, F.lit("+")))
    return F.coalesce(finite, special).try_cast("double")


def clean_integer(value: Column, squeezed: bool = False) -> Column:
    """Integer part of a number, truncated toward zero; null where it does not fit."""
    text = value if squeezed else squeeze(value)
    finite = F.when(text.rlike(_NUMBER), F.translate(text, "_", ""))
    return finite.try_cast("double").try_cast("int")


def _between(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def clean_latitude(
    value: Column, low: float = S.MIN_LATITUDE, high: float = S.MAX_LATITUDE, squeezed: bool = False
) -> Column:
    return _between(clean_float(value, squeezed), low, high)


def clean_longitude(
    value: Column, low: float = S.MIN_LONGITUDE, high: float = S.MAX_LONGITUDE, squeezed: bool = False
) -> Column:
    return _between(clean_float(value, squeezed), low, high)


def clean_age(value: Column, low: int = S.MIN_AGE, high: int = S.MAX_AGE, squeezed: bool = False) -> Column:
    return _between(clean_integer(value, squeezed), low, high)


def clean_vehicle_year(
    value: Column, low: int = S.MIN_VEHICLE_YEAR, high: int = S.MAX_VEHICLE_YEAR, squeezed: bool = False
) -> Column:
    return _between(clean_integer(value, squeezed), low, high)


def parse_datetime(value: Column, strict_ampm: bool = False, squeezed: bool = False) -> Column:
    """Local timestamp from ISO or US text; zone suffixes and impossible dates give null.

    By default the AM/PM marker of the US form is required but not applied, which is how
    the feed has always been read. ``strict_ampm=True`` reads it as a twelve-hour clock.
    """
    text = F.upper(value if squeezed else squeeze(value))
    iso = F.when(text.rlike(_ISO), text).try_cast("timestamp_ntz")
    us_text = F.trim(F.regexp_replace(text, _US, "$3-$1-$2 $4"))
    us = F.when(text.rlike(_US), us_text).try_cast("timestamp_ntz")
    if strict_ampm:
        us = _twelve_hour(text, us)
    return F.coalesce(iso, us)


def _twelve_hour(text: Column, stamp: Column) -> Column:
    hour = F.hour(stamp)
    has_marker = text.rlike("[AP]M$")
    half_day = F.expr("INTERVAL '12' HOUR")
    shifted = (
        F.when(text.endswith("PM") & (hour < 12), stamp + half_day)
        .when(text.endswith("AM") & (hour == 12), stamp - half_day)
        .otherwise(stamp)
    )
    return F.when(has_marker, F.when(hour.between(1, 12), shifted)).otherwise(stamp)
