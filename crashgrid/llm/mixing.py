"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / weight`` with ``u`` drawn from its id. Sorted by key
within its source, a prefix of documents whose sizes fill the source's budget is a weighted sample
without replacement. A budget above the source's size takes complete epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrid.llm.common import stored, words_of

# Fixed values of the contract.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3

BUCKETS = 1024
ROWS_PER_BUCKET = 10_000


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """Target of each source: ``source, source_size, target``.

    Weights repeat over the sources in code point order, null last. Sources share all sizes by
    weight; none gets more than ``most`` times its own, what is over is shared by the others.
    Sorted by the share at which it is full, a source is full exactly if the even share of those
    not yet full reaches it, so one pass settles what repeated sharing would.

    Works on one row per source: a mixture is stated per source, so that table is small.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    by_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_rank") % len(weights) + 1)
    ranked = ranked.withColumn("_w", by_rank).withColumn("_cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("_all", F.sum("source_size").over(everything).cast("double"))
    share = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    ranked = ranked.withColumn("_full", share >= F.col("_cap") / F.col("_w"))
    left = F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least("_cap", left * F.col("_w") / open_weight))
    return ranked.select("source", "source_size", target.alias("target"))


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """Exponential key of a document; small keys are taken first. Reruns give the same key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), doc_id), 11)
    return -F.log((bits + 0.5) / F.lit(float(1 << 53))) / weight


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MAX_EPOCHS,
    seed: int = 0,
    row: str | None = None,
) -> DataFrame:
    """How often the mix takes each document.

    ``quality`` (``doc_id, quality``, 0 to 1) scales the sampling weight: ``0.25 + quality``, 1
    where it is unknown; repeated labels are averaged. Returns one row per row of ``docs``:
    ``doc_id, source, size, source_size, target, copies, taken``; ``copies`` is the number of
    complete epochs, plus one if the document is in the last, fractional one. A document without
    words has size 0; null sources form a source of their own. Documents with equal keys (repeated
    rows) are taken in an order of their sizes. An empty table gives no rows. ``row`` names a column
    that tells rows apart: it is returned too, and rows without id are drawn by it, each for itself.

    The prefix sums are taken in two steps, so that a source with a third of all rows is never
    sorted in one task: sums per key range first, then the rows of the single range in which the
    budget ends.
    """
    named = [] if row is None else [F.col(row).alias("row")]
    extra = ["row"] if named else []
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.size(words_of(F.col(text))).cast("long").alias("size"),
        *named,
    )
    weight = F.lit(1.0)
    if quality is not None:
        marks = quality.groupBy("doc_id").agg(F.avg("quality").alias("_quality"))
        rows = rows.join(marks, "doc_id", "left")
        weight = F.coalesce(0.25 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_quality")), F.lit(1.0))
    drawn = sampling_key(F.col("doc_id"), weight, seed)
    if extra:
        drawn = F.when(F.col("doc_id").isNull(), sampling_key(F.col("row"), weight, seed)).otherwise(drawn)
    rows = rows.select("doc_id", "source", "size", *extra, drawn.alias("_key"))
    rows = stored(rows, "mix")

    buckets = max(BUCKETS, rows.count() // ROWS_PER_BUCKET)
    rows = rows.withColumn("_bucket", F.floor((1 - F.exp(-F.col("_key"))) * buckets))
    ranges = stored(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")), "mix-ranges")
    plan = source_plan(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("_epochs", F.least(F.lit(most), epochs).cast("long"))
    plan = plan.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .where(F.col("_before") < F.col("_rest"))
        .groupBy("source")
        .agg(F.max_by(F.struct(F.col("_bucket").alias("at"), "_before"), "_bucket").alias("_end"))
        .withColumnRenamed("source", "_end_source")
    )
    plan = stored(
        plan.join(ends, F.col("source").eqNullSafe(F.col("_end_source")), "left").select(
            F.col("source").alias("_source"), "source_size", "target", "_epochs", "_rest",
            F.coalesce("_end.at", F.lit(-1)).alias("_at"), F.coalesce("_end._before", F.lit(0)).alias("_before"),
        ),
        "mix-plan",
    )
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")

    inner = Window.partitionBy("source").orderBy("_key", "doc_id", "size", *extra).rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(F.col("_bucket") == F.col("_at"))
    edge = edge.withColumn("_before", F.col("_before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    edge = edge.withColumn("_in", F.col("_before") + F.col("size") / 2 <= F.col("_rest"))
    whole = rows.where(F.col("_bucket") != F.col("_at")).withColumn("_in", F.col("_bucket") < F.col("_at"))
    copies = F.col("_epochs") + F.col("_in").cast("long")
    return edge.unionByName(whole).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), *extra,
    )
