"""Names and labels: slugs, cause titles, feature names, sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: property names tried for a feature's name, in this order ---
NAME_FIELDS = (
    "name", "NAME", "Name", "title", "TITLE", "Title", "label", "LABEL", "Label",
    "display_name", "DISPLAY_NAME",
)
ID_FIELDS = (
    ("ward", "Ward "), ("WARD", "Ward "),
    ("district", "District "), ("DISTRICT", "District "),
    ("dist_num", "District "), ("DIST_NUM", "District "),
    ("beat_num", "Beat "), ("BEAT_NUM", "Beat "),
    ("community", ""), ("COMMUNITY", ""),
    ("area_numbe", "Area "), ("AREA_NUMBE", "Area "),
    ("objectid", "Feature "),
)
REPORT_NAME_FIELDS = ("name", "NAME", "title", "TITLE")
LABEL_FIELDS = ("name", "NAME", "Name", "title", "TITLE", "label", "LABEL")
# --- end of fixed values ---

_FALSY_JSON = ("", "0", "0.0", "-0", "-0.0", "false", "[]", "{}")


def slug(text: Column) -> Column:
    """URL-safe form: lower case, everything else a single dash; 'layer' when nothing is left."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    bare = F.regexp_replace(dashed, "^-|-$", "")
    return F.when(bare != "", bare).otherwise("layer")


def cause_label(cause: Column) -> Column:
    """Title-cased cause for display."""
    title = F.initcap(F.regexp_replace(cause, r"[\s_]+", " "))
    known = cause.isNotNull() & ~cause.isin("", "UNKNOWN")
    return F.when(known, title).otherwise("Unknown / Not Reported")


def month_label(month: Column) -> Column:
    """'2024-01' as 'Jan 24'."""
    return F.date_format(F.to_date(F.concat(month, F.lit("-01"))), "MMM yy")


def iso_text(stamp: Column, separator: str = "T") -> Column:
    """ISO 8601 text; microseconds appear only when there are any.

    Built from the plain cast: formatting functions would first move a local timestamp
    into the session time zone, where some local times do not exist.
    """
    text = stamp.cast("string")
    fraction = F.substring(text, 21, 6)
    return F.concat(
        F.translate(F.substring(text, 1, 19), " ", separator),
        F.when(fraction != "", F.concat(F.lit("."), F.rpad(fraction, 6, "0"))).otherwise(""),
    )


def month_text(stamp: str | Column) -> Column:
    """'2024-01' of a local timestamp."""
    column = F.col(stamp) if isinstance(stamp, str) else stamp
    return F.substring(column.cast("string"), 1, 7)


def first_number(text: Column) -> Column:
    """First run of digits as a double, or null."""
    digits = F.regexp_extract(text, r"\d+", 0)
    return F.when(digits != "", digits).try_cast("double")


def properties_map(properties: Column) -> Column:
    """Feature properties by name, every value as JSON text without quotes."""
    return F.from_json(properties, "map<string,string>")


def json_text(properties: Column, field: str | Column) -> Column:
    """Value of one property as text; null when absent or JSON null."""
    return F.try_element_at(properties_map(properties), F.lit(field) if isinstance(field, str) else field)


def is_quoted(properties: Column, field: str) -> Column:
    """Whether a property is text rather than a bare number or word."""
    value = F.try_variant_get(F.try_parse_json(properties), f"$['{field}']", "variant")
    return F.schema_of_variant(value) == "STRING"


def _truthy(properties: Column, values: Column, field: str) -> Column:
    """Property text unless it is empty, zero, false or an empty container."""
    text = F.try_element_at(values, F.lit(field))
    falsy = text.isin(*_FALSY_JSON) & ((text == "") | ~is_quoted(properties, field))
    return F.when(~falsy, text)


def _whole(text: Column, is_text: Column) -> Column:
    """A JSON number such as 5.0 printed as 5; text is left alone."""
    pattern = r"^(-?\d+)\.0+$"
    return F.when(text.rlike(pattern) & ~is_text, F.regexp_replace(text, pattern, "$1")).otherwise(
        text
    )


def label_value(properties: Column, values: Column, field: str) -> Column:
    """Chosen label property for display; a JSON null is shown as the word None."""
    shown = _whole(F.try_element_at(values, F.lit(field)), is_quoted(properties, field))
    return F.when(F.map_contains_key(values, field), F.coalesce(shown, F.lit("None")))


def _with_values(properties: Column, choose) -> Column:
    """Parse the properties once per row and hand the map to ``choose``."""
    return F.get(F.transform(F.array(properties_map(properties)), choose), F.lit(0))


def feature_name(
    properties: Column, feature_id: Column, label_field: str | None = None
) -> Column:
    """Readable name of a layer feature.

    The configured label wins; then the first usable name property; then the first usable
    identifier with its prefix; then the feature number.
    """

    def choose(values: Column) -> Column:
        choices = [label_value(properties, values, label_field)] if label_field else []
        choices += [_truthy(properties, values, f) for f in NAME_FIELDS]
        choices += [
            F.concat(
                F.lit(prefix), _whole(_truthy(properties, values, f), is_quoted(properties, f))
            )
            for f, prefix in ID_FIELDS
        ]
        return F.coalesce(*choices)

    return F.coalesce(_with_values(properties, choose), _numbered(feature_id))


def report_feature_name(properties: Column, feature_id: Column) -> Column:
    """Name used on a location report: fewer properties are tried than in listings."""
    named = _with_values(
        properties,
        lambda values: F.coalesce(*[_truthy(properties, values, f) for f in REPORT_NAME_FIELDS]),
    )
    return F.coalesce(named, _numbered(feature_id))


def _numbered(feature_id: Column) -> Column:
    return F.concat(F.lit("Feature "), feature_id.cast("string"))


def label_rank(field: Column) -> Column:
    """How good a property name is as a label; lower is better, null is unusable."""
    lowered = F.lower(field)
    rank = F.when(F.lit(False), 0)
    for position, name in enumerate(LABEL_FIELDS):
        rank = rank.when(field == name, position)
    return (
        rank.when(lowered.contains("name") | lowered.contains("_nm") | lowered.endswith("nm"), 100)
        .when(lowered.contains("desc"), 200)
        .when(lowered.rlike("district|ward|community"), 300)
    )


def natural_key(text: Column) -> Column:
    """Sort key of alternating words and numbers, numbers compared by value.

    A digit run is keyed by its length without leading zeros and then by its digits, so
    runs of any length compare exactly.
    """
    words = F.split(F.lower(text), r"\d+", -1)
    digits = F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d+)"), 1),
        lambda d: F.ltrim(d, F.lit("0")),
    )
    numbers = F.transform(digits, lambda d: F.struct(F.length(d).alias("len"), d.alias("run")))
    return F.arrays_zip(words.alias("word"), numbers.alias("number"))


SORT_TYPES = ("alphabetic", "numeric", "natural")


def sort_columns(name: str, sort_type: str) -> list[Column]:
    """Ordering of place items; unknown sort types fall back to alphabetic."""
    text = F.col(name)
    if sort_type == "numeric":
        return [F.coalesce(first_number(text), F.lit(float("inf"))), text]
    if sort_type == "natural":
        return [natural_key(text), text]
    return [F.lower(text), text]


def native_name(place_type: str) -> Column:
    """Short name of a native boundary."""
    if place_type == "wards":
        return F.concat(F.lit("Ward "), F.col("ward").cast("string"))
    if place_type == "community_areas":
        number = F.concat(F.lit("Area "), F.col("area_numbe").cast("string"))
        return F.coalesce(_non_empty("community"), number)
    if place_type in ("house_districts", "senate_districts"):
        return F.concat(F.lit("District "), F.col("district").cast("string"))
    if place_type == "police_beats":
        return F.concat(F.lit("Beat "), F.col("beat_num").cast("string"))
    raise ValueError(f"unknown place type: {place_type}")


def native_display_name(place_type: str) -> Column:
    """Short name followed by the office holder where the boundary has one."""
    holder = {
        "wards": "alderman", "house_districts": "rep_name", "senate_districts": "senator_name",
    }.get(place_type)
    name = native_name(place_type)
    if holder is None:
        return name
    return F.concat(name, F.coalesce(F.concat(F.lit(" - "), _non_empty(holder)), F.lit("")))


def native_report_name(place_type: str, place_id: str) -> Column:
    """Name of a native boundary on a location report."""
    prefixes = {
        "wards": "Ward ", "house_districts": "House District ",
        "senate_districts": "Senate District ", "police_beats": "Police Beat ",
    }
    if place_type == "community_areas":
        return F.col("community")
    return F.lit(prefixes[place_type] + place_id)


def _non_empty(column: str) -> Column:
    return F.when(F.col(column) != "", F.col(column))


def duration_seconds(started: str = "started_at", completed: str = "completed_at") -> Column:
    """Whole seconds between two local timestamps."""
    elapsed = F.col(completed) - F.col(started)

    def unit(name: str) -> Column:
        return F.extract(F.lit(name), elapsed).cast("int")

    return unit("DAY") * 86_400 + unit("HOUR") * 3_600 + unit("MINUTE") * 60 + unit("SECOND")
