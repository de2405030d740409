"""A training corpus from raw documents: language, near-duplicates, passages, mixture, windows.

Each stage takes ``(spark, docs, sf_dir)``; its rows are written and read again as the next stage's
documents. All but the last return the columns of documents. A row is known by all its columns, not by
``doc_id`` alone: rows without id and different rows of one id are documents of their own in every stage,
ordered by id (none last).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrid.llm.common import passing, stored, table
from crashgrid.llm.language_id import UNKNOWN, train, verdict
from crashgrid.llm.minhash import near_duplicates
from crashgrid.llm.mixing import mix
from crashgrid.llm.packing import pack_windows
from crashgrid.llm.substring_dedup import repeated_passages
from crashgrid.operators.joins import fits_broadcast
from crashgrid.session import new_folder

MIN_LANGUAGE_SCORE = 0.5
BATCH_BYTES = 4 << 20  # of text that goes to Python at once


def _text_batches(spark: SparkSession) -> None:
    """Have the session bound Arrow batches by bytes: ten thousand rows of long texts are too much for a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _ids_tell_apart(docs: DataFrame) -> bool:
    """Has every row an id that no other row has?"""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    return not odd.take(1)


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``row``, so that no column of it can clash with a stage's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _keyed(docs: DataFrame, once: bool = False) -> DataFrame:
    """``key, row``: rows that are equal in every column share a number, no others do.

    Numbers grow with the id; rows without id come last. Ids that tell all rows apart are the numbers.
    ``once`` leaves one of the rows of a number.
    """
    rows = _rows(docs)
    if _ids_tell_apart(docs):
        return rows.select(F.col("row.doc_id").alias("key"), "row")
    marked = rows.withColumn("digest", F.sha2(F.to_json("row"), 256))
    marked = marked.dropDuplicates(["digest"]) if once else marked
    order = marked.select(F.col("row.doc_id").alias("doc_id"), "digest").distinct()
    order = order.orderBy(F.col("doc_id").asc_nulls_last(), "digest")
    numbers = stored(order.select("digest", F.monotonically_increasing_id().alias("key")), "keys")
    return stored(marked.join(numbers, "digest").select("key", "row"), "keyed")


def _sized(keys: DataFrame) -> DataFrame:
    """A side of keys as a join should take it: sent to all executors where a count says that it is small, so that
    the texts stay where they are, else shuffled."""
    return F.broadcast(keys) if fits_broadcast(keys) else keys


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language, or in none for sure. Every row is judged by its own text."""
    _text_batches(spark)
    model = train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = _rows(docs).withColumn("found", verdict(model)(F.col("row.text").cast("string")))
    return found.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, and every document without a group.

    Rows that are repeated in every column leave one. Rows of one id with different texts are compared
    like any two documents, and so are rows without id.
    """
    _text_batches(spark)
    rows = _keyed(docs, once=True)
    with passing(spark):
        dropped = near_duplicates(rows.select("key", F.col("row.text").alias("text")), "key").where("not kept")
        dropped = stored(dropped.select(F.col("doc_id").alias("key")), "dropped", outlives=True)
    return rows.join(_sized(dropped), "key", "left_anti").select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages that an earlier document has; documents of nothing else go.

    Each of several texts of one id is cut by itself; rows without id are later than all others. Rows
    that are repeated in every column are the same document.
    """
    _text_batches(spark)
    rows = _keyed(docs)
    with passing(spark):
        found = repeated_passages(rows.select("key", F.col("row.text").alias("text")), "key").where("n_removed > 0")
        found = found.select(F.col("doc_id").alias("key"), "kept").dropDuplicates(["key"])
        found = stored(found, "passages", outlives=True)
    cut = _sized(found.select("key"))
    same = rows.join(cut, "key", "left_anti").select("row", F.col("row.text").alias("text"))
    changed = rows.join(cut, "key", "left_semi").join(found.where("kept <> ''"), "key")
    rows = same.unionByName(changed.select("row", F.col("kept").alias("text")))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast("long"))
    return rows.select(row.alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it.

    Each row is drawn for itself, also without id or beside others of its id; of rows that are repeated
    in every column all copies together are returned.
    """
    rows = _keyed(docs)
    with passing(spark):
        taken = mix(rows.select("key", "row.doc_id", "row.source", "row.text"), table(spark, sf_dir, "labels"), row="key")
        taken = taken.where("copies > 0").groupBy(F.col("row").alias("key")).agg(F.sum("copies").alias("copies"))
        taken = stored(taken, "taken", outlives=True)
    rows = rows if _ids_tell_apart(docs) else rows.dropDuplicates(["key"])
    rows = rows.join(_sized(taken), "key")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens."""
    _text_batches(spark)
    return pack_windows(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

# Hash-based sampling and tokenizers have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents. A stage's own tables go once its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = new_folder(spark, "pipeline")
        with passing(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
