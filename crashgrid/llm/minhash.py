"""Near-duplicates by min-max hashing.

Every permutation gives two signature values, the smallest and the largest image of a document's
shingles, for one evaluation of its hash. Bands of the signature propose candidates, full shingle
sets confirm them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrid.llm.common import stored
from crashgrid.llm.components import components
from crashgrid.llm.text import Words, mixed, slices

SHINGLE = 5
SIMILARITY = 80
VALUES = 196  # of a signature at most, two per permutation
MISSED = 1 / 15_000  # so often at most is a pair missed that has just the similarity asked for

_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (2, VALUES // 2), dtype=np.uint64)
_FACTORS, _SHIFTS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]
_CHUNK = 1024
PARITY_LONGS = 16  # a set's parity map: for each of 1024 cells, whether an odd number of shingles falls there


def layout(similarity: int) -> tuple[int, int]:
    """Rows and bands for a similarity in percent: the longest bands that miss no more than MISSED.

    85 %: 28 bands of 7, missed once in 50,000. 80 %: 32 bands of 6, missed once in 17,000.
    """
    for rows in range(VALUES // 2, 1, -1):
        bands = VALUES // rows
        bands -= rows * bands % 2
        if (1 - (similarity / 100) ** rows) ** bands <= MISSED:
            return rows, bands
    return 1, VALUES


def shingle_sets(words: Words, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a batch.

    A text of fewer words has its whole sequence as its one shingle, a text without words none.
    """
    runs = words.runs(width)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            total = np.uint64(b - a)
            for h in words.hash[a:b]:
                total = np.uint64((int(total) * 0x9E3779B97F4A7C15 + int(h)) % (1 << 64))
            yield mixed(np.array([total], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def min_max(shingles: np.ndarray, permutations: int = VALUES // 2) -> np.ndarray:
    """Signature of a set: the minima, then the maxima, of its images under so many permutations."""
    factors, shifts = _FACTORS[:permutations], _SHIFTS[:permutations]
    low = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(permutations, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        images = shingles[at : at + _CHUNK, None] * factors + shifts
        np.minimum(low, images.min(axis=0), out=low)
        np.maximum(high, images.max(axis=0), out=high)
    return np.concatenate([low, high])


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One key per band of each signature; equal bands of equal number have equal keys."""
    parts = signatures.reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for row in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, row])
    return keys.view(np.int64)


_SIGNED = "doc_id long, h1 long, h2 long, n_shingles long, digest binary, bands array<long>"


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sign(rows: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = list(shingle_sets(Words(batch.column("text"), lower=True)))
                keys = band_keys(np.stack([min_max(s, rows * bands // 2) for s in sets]), rows, bands) if sets else np.zeros((0, bands), np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                keyed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]), pa.int32()),
                    pa.array(keys[sizes > 0].reshape(-1)),
                )
                own = [batch.column(c) for c in ("doc_id", "h1", "h2")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(sizes), pa.array([_digest(s) for s in sets], pa.binary()), keyed],
                    ["doc_id", "h1", "h2", "n_shingles", "digest", "bands"],
                )

    return sign


def parity(shingles: np.ndarray) -> np.ndarray:
    """Parity map of a set. Two maps differ in at most as many bits as the sets in shingles."""
    cells = 64 * PARITY_LONGS
    at = (shingles * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells) & 1 == 1).view(np.int64)


_SETS = "id long, shingles array<long>, parity array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = list(shingle_sets(Words(batch.column("text"), lower=True)))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            maps = np.concatenate([*map(parity, sets), np.zeros(0, np.int64)])
            steps = np.arange(len(sets) + 1, dtype=np.int32) * PARITY_LONGS
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    pa.ListArray.from_arrays(pa.array(steps), pa.array(maps)),
                ],
                ["id", "shingles", "parity"],
            )


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Sizes of both sets and of their intersection for pairs ``a, b``."""
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b"))
    return pairs.join(second, "b").join(first, "a").select(
        "a",
        "b",
        F.size(F.array_intersect("_a", "_b")).alias("both"),
        F.size("_a").alias("size_a"),
        F.size("_b").alias("size_b"),
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: int = SIMILARITY
) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``similarity`` percent.

    Words are runs of other than ASCII white space, A-Z lower-cased. Returns one row per row of
    ``docs``: ``doc_id, n_shingles, component_id, kept``; the smallest document of each component
    is kept. Null and empty texts are linked with nothing, and kept. Documents with equal sets are one
    class from the start. Rows are told apart by their texts: several texts of one ``doc_id`` are compared
    like any others, each a node of its own, and equal rows get equal results. Rows without id take
    part; ``component_id`` is null only where no document of the component has an id, and of such a
    component the rows of one text (or one set of shingles) are kept.

    Candidates share a band. Every class is compared with the smallest class of any of its bands,
    then with the smallest of each band that is not yet in its component; these links already join
    most groups, so a group of thousands costs thousands of comparisons.
    What is left in a band outside that component is compared across components. Bounds that never
    rule out a link spare most of these: sizes, distances from the band's smallest class (Jaccard
    distance obeys the triangle inequality), and parity maps, which differ in no more bits than the
    sets in shingles. No candidate is capped or dropped.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(similarity), "text")})  # which text it is
    signed = stored(rows.mapInArrow(_sign(*layout(similarity)), _SIGNED), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(
        F.min(F.struct("h1", "h2", "doc_id")).alias("one"), F.min("doc_id").alias("least"),
        F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"),  # equal sets have equal bands
    )
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = classes.select("id", F.explode("bands").alias("band"))
    leaders = stored(
        members.groupBy("band").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "leaders",
    )
    members = stored(members.join(leaders, "band").withColumnRenamed("id", "b"), "members")
    wanted = stored(members.select(F.col("b").alias("id")).distinct(), "wanted")
    wanted = classes.join(wanted, "id").select("id", F.col("one.doc_id").alias("_doc"), "one.h1", "one.h2")
    sets = rows.join(wanted, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("_doc"))).select("id", "text")
    if _repeats(signed):
        sets = sets.dropDuplicates(["id"])
    sets = stored(sets.mapInArrow(_sets, _SETS), "sets")
    near = (100 * F.col("both")) >= similarity * (F.col("size_a") + F.col("size_b") - F.col("both"))
    first = members.where("a <> b").groupBy("b").agg(F.min("a").alias("a"))
    compared = stored(_compare(first, sets), "compared")
    groups = components(compared.where(near).select("a", "b"))
    apart = stored(_apart(members, groups).join(compared.select("a", "b"), ["a", "b"], "left_anti"), "apart")
    compared = stored(compared.unionByName(_compare(apart, sets)), "compared")
    links = compared.where(near).select("a", "b")
    groups = components(links)

    rest = _between(members, groups, compared, sets, similarity)
    if rest.take(1):
        more = stored(_compare(rest, sets).where(near).select("a", "b"), "more")
        groups = components(links.unionByName(more))

    linked = groups.select("id", "component").unionByName(groups.select(F.col("component").alias("id"), "component").distinct())
    linked = stored(linked.join(classes.select("id", "digest", "one", "least"), "id"), "linked")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.min("one").alias("first"))
    named = linked.join(named, "component").select("digest", "component_id", (F.col("one") == F.col("first")).alias("leads"))
    alone = classes.where("copies > 1").join(linked.select("digest"), "digest", "left_anti")
    alone = alone.select("digest", F.col("least").alias("component_id"), F.lit(True).alias("leads"))
    known = stored(named.unionByName(alone).withColumn("known", F.lit(True)), "known")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    nameless = F.col("component_id").isNull() & F.coalesce("leads", F.lit(True))
    kept = F.when(F.col("doc_id").isNull(), nameless).otherwise(F.col("doc_id") == component)
    return signed.join(known, "digest", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept")
    )


def _apart(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of a class and the smallest of one of its bands that are in different components."""
    pairs = members.where("a <> b").select("a", "b").distinct()
    of_a = groups.select(F.col("id").alias("a"), F.col("component").alias("_ca"))
    of_b = groups.select(F.col("id").alias("b"), F.col("component").alias("_cb"))
    pairs = pairs.join(of_b, "b", "left").join(of_a, "a", "left")
    return pairs.where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")


def _repeats(signed: DataFrame) -> bool:
    """Does a text come twice under one ``doc_id``?"""
    return bool(signed.groupBy("doc_id", "h1", "h2").count().where("count > 1").take(1))


def _between(
    members: DataFrame, groups: DataFrame, compared: DataFrame, sets: DataFrame, similarity: int
) -> DataFrame:
    """Candidate pairs of one band in different components that could still be near."""
    named = members.join(groups.withColumnRenamed("id", "b"), "b", "left").withColumn(
        "component", F.coalesce("component", "b")
    )
    named = stored(named, "named")
    mixed_bands = stored(
        named.groupBy("band").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        .where("_low <> _high").select("band"),
        "mixed-bands",
    )
    distance = 1 - F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))
    far = compared.select("a", "b", distance.alias("far"))
    left = named.join(mixed_bands, "band", "left_semi").where("a <> b").join(far, ["a", "b"], "left")
    maps = sets.select(F.col("id").alias("b"), F.size("shingles").alias("size"), "parity")
    left = stored(left.join(maps, "b"), "left-over")
    one, two = left.alias("x"), left.alias("y")
    reach = 1 - similarity / 100 + 1e-9
    differ = sum(F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i])) for i in range(PARITY_LONGS))
    pairs = one.join(
        two,
        (F.col("x.band") == F.col("y.band"))
        & (F.col("x.b") < F.col("y.b"))
        & (F.col("x.component") != F.col("y.component"))
        & F.coalesce(F.abs(F.col("x.far") - F.col("y.far")) <= reach, F.lit(True))
        & (100 * F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size"))
        & (differ * (100 + similarity) <= (F.col("x.size") + F.col("y.size")) * (100 - similarity)),
    )
    return stored(pairs.select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct(), "between")
