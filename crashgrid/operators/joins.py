"""Join strategy helpers: broadcast only what has been measured, split hot keys otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
ROWS_PER_SALT = 1_000_000


def fits_broadcast(side: DataFrame, weight: Column | None = None, limit: int = BROADCAST_ROWS) -> bool:
    """Measure a join side before broadcasting it.

    Without a weight the count stops as soon as the limit is passed. With a weight (rows
    that carry arrays) the total weight is compared.
    """
    if weight is None:
        return side.select(F.lit(1)).limit(limit + 1).count() <= limit
    total = side.agg(F.sum(weight).alias("total")).first()["total"] or 0
    return total <= limit


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    condition: Column | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
    way: str | None = None,
) -> DataFrame:
    """Shuffled inner join that cuts keys with many rows on the big side into slices.

    Only keys above ``rows_per_salt`` are cut, and the matching small-side rows are
    repeated once per slice. At most ``rows(big) / rows_per_salt`` keys can be hot, which
    bounds the broadcast list of hot keys. Exact for any slice size. ``way`` is a join hint, "merge" where
    neither side may be broadcast whatever its packed size says.
    """
    on = list(on)
    hot = (
        big.groupBy(*on)
        .count()
        .where(F.col("count") > rows_per_salt)
        .select(*on, F.ceil(F.col("count") / rows_per_salt).cast("int").alias("_slices"))
    )
    slices = F.coalesce("_slices", F.lit(1))
    left = (
        big.join(F.broadcast(hot), on, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*spread_by), slices).cast("int"))
        .drop("_slices")
    )
    right = (
        small.join(F.broadcast(hot), on, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    joined = left.join(right if way is None else right.hint(way), [*on, "_slice"])
    return (joined if condition is None else joined.where(condition)).drop("_slice")


def measured_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    condition: Column | None = None,
    weight: Column | None = None,
    at_most: float | None = None,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join: no shuffle of the big side when the small side measurably fits, else salted.

    ``at_most`` is a known upper bound of the small side's weight; the side is measured only
    when that bound does not settle the question.
    """
    if (at_most is not None and at_most <= limit) or fits_broadcast(small, weight, limit):
        joined = big.join(F.broadcast(small), list(on))
        return joined if condition is None else joined.where(condition)
    return salted_join(big, small, on, spread_by, condition)


def restrict(big: DataFrame, keys: DataFrame, on: Sequence[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Drop rows of a large frame that cannot match, when the keys are few enough to ship.

    Only an optimisation ahead of a join on the same keys: the result of the join is the same
    with or without it.
    """
    if fits_broadcast(keys, limit=limit):
        return big.join(F.broadcast(keys), list(on), "left_semi")
    return big
