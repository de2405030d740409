"""Record cleaning for the four feeds, and first-row-wins de-duplication.

Each sanitizer is one projection over the all-text landing frame: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrid import schemas as S
from crashgrid.functions import cleaning as C

Rule = Callable[..., Column]


# What each rule returns, for fields a feed leaves out.
_RESULT = {
    C.clean_string: "string",
    C.clean_integer: "int",
    C.clean_age: "int",
    C.clean_vehicle_year: "int",
    C.clean_float: "double",
    C.clean_latitude: "double",
    C.clean_longitude: "double",
    C.parse_datetime: "timestamp_ntz",
}


def _interpreted(value: Column) -> Column:
    """The same text by way of a higher-order function, which keeps its projection out of whole-stage code.

    There a wide projection is one method, too long for the JVM to compile; outside it is cut into short ones.
    """
    return F.get(F.transform(F.array(value), lambda text: text), F.lit(0))


def _step(rows: DataFrame, values: list[Column], rest: Sequence[str]) -> DataFrame:
    """One projection of a wide record: ``values`` as texts ``_text_0``, ``_text_1`` and so on, ``rest`` as it is."""
    first = [_interpreted(values[0])] if values else []
    named = [value.alias(f"_text_{i}") for i, value in enumerate([*first, *values[1:]])]
    return rows.select(*named, *rest)


def _apply(raw: DataFrame, rules: dict[str, Rule], carry: Iterable[str]) -> DataFrame:
    """Project every rule; a field the feed does not deliver is null.

    The texts of a record are trimmed, searched for odd whitespace together, squeezed, and then judged by their
    rules. These are projections one above the other, so that no text is worked out twice.
    """
    available, carry = set(raw.columns), list(carry)
    fields = [name for name in rules if name in available]
    kept = {name: f"_carried_{i}" for i, name in enumerate(carry)}
    texts = [F.col(f"_text_{i}") for i in range(len(fields))]
    rows = _step(
        raw.withColumns({new: F.col(f"`{old}`") for old, new in kept.items()}),
        [F.trim(F.col(f"`{name}`").cast("string")) for name in fields], [*kept.values()],
    )
    rows = rows.withColumn("_unusual", C.unusual(texts) if texts else F.lit(False))
    rows = _step(rows, [C.squeeze(text, F.col("_unusual")) for text in texts], [*kept.values()])
    squeezed = dict(zip(fields, texts))
    cleaned = [
        (rule(squeezed[name], squeezed=True) if name in squeezed else F.lit(None).cast(_RESULT[rule])).alias(name)
        for name, rule in rules.items()
    ]
    cleaned[0] = _interpreted(cleaned[0]).alias(next(iter(rules)))
    return rows.select(*cleaned, *[F.col(new).alias(old) for old, new in kept.items()])


def crash_rules() -> dict[str, Rule]:
    rules: dict[str, Rule] = {
        "crash_record_id": C.clean_string,
        "crash_date": C.parse_datetime,
        "latitude": C.clean_latitude,
        "longitude": C.clean_longitude,
    }
    rules |= dict.fromkeys(S.CRASH_INTEGERS, C.clean_integer)
    rules |= dict.fromkeys(S.CRASH_STRINGS, C.clean_string)
    return rules | {"date_police_notified": C.parse_datetime}


def person_rules(keep_links: bool = True) -> dict[str, Rule]:
    rules: dict[str, Rule] = {
        "crash_record_id": C.clean_string,
        "person_id": C.clean_string,
        "age": C.clean_age,
    }
    rules |= dict.fromkeys(S.PERSON_STRINGS, C.clean_string)
    rules["bac_result_value"] = C.clean_float
    rules |= dict.fromkeys(S.PERSON_AREA_FLAGS, C.clean_string)
    if keep_links:
        rules |= {"crash_date": C.parse_datetime, "vehicle_id": C.clean_string}
    return rules


def vehicle_rules() -> dict[str, Rule]:
    rules: dict[str, Rule] = {
        "crash_unit_id": C.clean_string,
        "crash_record_id": C.clean_string,
        "unit_no": C.clean_string,
        "vehicle_year": C.clean_vehicle_year,
    }
    rules |= dict.fromkeys(S.VEHICLE_INTEGERS, C.clean_integer)
    rules["crash_date"] = C.parse_datetime
    return rules | dict.fromkeys(S.VEHICLE_STRINGS, C.clean_string)


def fatality_rules() -> dict[str, Rule]:
    rules: dict[str, Rule] = {
        "person_id": C.clean_string,
        "rd_no": C.clean_string,
        "crash_date": C.parse_datetime,
        "latitude": C.clean_latitude,
        "longitude": C.clean_longitude,
    }
    return rules | dict.fromkeys((*S.FATALITY_TEXTS, "victim"), C.clean_string)


RULES: dict[str, Callable[[], dict[str, Rule]]] = {
    "crashes": crash_rules,
    "people": person_rules,
    "vehicles": vehicle_rules,
    "fatalities": fatality_rules,
}


def sanitize(dataset: str, raw: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    """Clean one feed. ``carry`` names landing columns to pass through untouched.

    People keep ``crash_date`` and ``vehicle_id``: without them the date-filtered
    pedestrian totals and the vehicle-occupant join would see only nulls.
    """
    if dataset not in RULES:
        raise ValueError(f"unknown dataset: {dataset}")
    return _apply(raw, RULES[dataset](), carry)


def first_row_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep the first row of every key; rows with an empty key are dropped.

    An aggregate rather than a ranking window: each map task already reduces a key to one
    row, so a key holding a third of the data costs no more than any other.
    """
    return _pick_per_key(rows.where(F.col(key).isNotNull() & (F.col(key) != "")), [key], order, F.min_by)


def last_row_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row of every key, for batches that repeat a record."""
    return _pick_per_key(rows, list(keys), order, F.max_by)


def _pick_per_key(rows, keys, order, pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest])
    rank = F.struct(*[F.col(f"`{c}`") for c in order])
    picked = rows.groupBy(*keys).agg(pick(packed, rank).alias("_row"))
    unpacked = picked.select(*keys, "_row.*")
    return unpacked.select(*[F.col(f"`{c}`") for c in rows.columns])


def stable_order(rows: DataFrame) -> list[Column]:
    """Tie-break for feeds without a sequence: a digest of the whole row."""
    return [F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])]


def table_columns(spec: S.TableSpec, rows: DataFrame) -> DataFrame:
    """Keep the columns the table knows, cast to the declared types."""
    available = set(rows.columns)
    fields = [f for f in spec.schema.fields if f.name in available]
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
