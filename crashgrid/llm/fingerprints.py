"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

Each distinct paragraph of a text adds its digest to three cells. Two sketches subtract cell by
cell; what they share cancels, and cells with a single digest left are peeled until the digests
that differ are all known. If peeling gets stuck, the pair is sketched anew with more cells.

Small sketches are made and peeled inside the row, at a cost of their fixed size per paragraph. Pairs
that need more cells than that have a table of cells, a row per cell, in which all of them are
peeled together, round by round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrid.llm.common import bind, stored

PARAGRAPH = r"[^\n]{1,512}"  # lines, long ones in parts
CELLS = 8  # cells per table of the first, smallest sketch; three tables
GROWTH = 4
IN_ROW = 2  # sizes that are tried inside the row
ROUNDS = 12
TABLE_ROUNDS = 100
ROWS_PER_RANGE = 100_000


def paragraph_digests(text: Column) -> Column:
    """Digests of the distinct paragraphs of a text; none for null."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PARAGRAPH})"), F.lit(1))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(digest, F.lit(1)), 32)


def _places(digest: Column, cells: int | Column) -> list[Column]:
    """The cell of a digest in each of the three tables."""
    size = cells if isinstance(cells, Column) else F.lit(cells)
    return [F.lit(t) * size + F.pmod(F.shiftright(digest, 21 * t), size) for t in range(3)]


def _entry(digest: Column, cells: int, sign: Column | None = None) -> Column:
    """A digest with its check sum and its cells."""
    places = _places(digest, cells)
    fields = [digest.alias("k"), _check(digest).alias("c"), *(p.cast("int").alias(f"p{t}") for t, p in enumerate(places))]
    return F.struct(*fields, *([sign.alias("n")] if sign is not None else []))


def _at(entry: Column, i: Column) -> Column:
    return (entry["p0"] == i) | (entry["p1"] == i) | (entry["p2"] == i)


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"))


def sketch(digests: Column, cells: int) -> Column:
    """Cells ``(n, k, c)``: count, digests and check sums (both by exclusive or)."""

    def filled(entries: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(3 * cells - 1)),
            lambda i: F.aggregate(
                F.filter(entries, lambda e: _at(e, i)),
                _cell(F.lit(0), F.lit(0), F.lit(0)),
                lambda a, e: _cell(a["n"] + 1, a["k"].bitwiseXOR(e["k"]), a["c"].bitwiseXOR(e["c"])),
            ),
        )

    return bind(F.transform(digests, lambda d: _entry(d, cells)), filled)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"]))
    )


def peel(difference: Column, cells: int, rounds: int = ROUNDS) -> Column:
    """The digests that differ, as ``(k, n)`` with n = 1 for those of the first text and -1 for
    those of the second, or null if some could not be told."""

    def single(state: Column) -> Column:
        lone = F.filter(state, lambda x: (F.abs(x["n"]) == 1) & (x["c"] == _check(x["k"])))
        return F.array_distinct(F.transform(lone, lambda x: _entry(x["k"], cells, x["n"])))

    def without(state: Column, found: Column) -> Column:
        return F.transform(
            state["cells"],
            lambda x, i: F.aggregate(
                F.filter(found, lambda e: _at(e, i)),
                x,
                lambda a, e: _cell(a["n"] - e["n"], a["k"].bitwiseXOR(e["k"]), a["c"].bitwiseXOR(e["c"])),
            ),
        )

    def step(state: Column, _: Column) -> Column:
        return bind(
            single(state["cells"]),
            lambda found: F.when(F.size(found) == 0, state).otherwise(
                F.struct(
                    without(state, found).alias("cells"),
                    F.concat(state["found"], F.transform(found, lambda e: _told(e["k"], e["n"]))).alias("found"),
                )
            ),
        )

    def all_told(state: Column) -> Column:
        left = F.exists(state["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))
        return F.when(~left, state["found"])

    start = F.struct(difference.alias("cells"), F.array().cast("array<struct<k:bigint,n:int>>").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, all_told)


def _told(digest: Column, sign: Column) -> Column:
    return F.struct(digest.alias("k"), sign.cast("int").alias("n"))


def render(cells: Column) -> Column:
    """A sketch as a string of hexadecimal digits."""
    return F.array_join(
        F.transform(
            cells,
            lambda x: F.concat(
                F.lpad(F.hex(x["n"]), 4, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["c"]), 8, "0")
            ),
        ),
        "",
    )


def differing(pairs: DataFrame, key: list[str], cells: int = CELLS) -> DataFrame:
    """The digests in which ``a`` and ``b`` (arrays of distinct digests) differ, from their sketches.

    ``pairs`` has ``key``, ``a`` and ``b``. Returns ``key, only_a, only_b`` and ``cells``, the number
    of cells per table with which the sketches of the pair could be peeled. Pairs that cannot be
    peeled go on to sketches ``GROWTH`` times as large, beyond ``IN_ROW`` of them to sketches that
    could hold every digest of both, until none is left. They are few but slow, so they are dealt out anew.
    """
    done, rest = [], pairs
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(IN_ROW):
        tried = rest.select(*key, "a", "b", subtract(sketch(F.col("a"), cells), sketch(F.col("b"), cells)).alias("_d"))
        tried = stored(tried.select(*key, "a", "b", peel(F.col("_d"), cells).alias("found")), "peeled")
        done.append(_sides(tried.where(F.col("found").isNotNull()), key, F.lit(cells).cast("long")))
        rest = tried.where(F.col("found").isNull()).drop("found")
        if not rest.take(1):
            return reduce(DataFrame.unionByName, done)
        rest, cells = rest.repartition(tasks), cells * GROWTH
    return reduce(DataFrame.unionByName, [*done, _peeled_in_tables(rest, key, cells)])


def _sides(told: DataFrame, key: list[str], cells: Column) -> DataFrame:
    of = lambda sign: F.transform(F.filter("found", lambda x: x["n"] == sign), lambda x: x["k"])
    return told.select(*key, of(1).alias("only_a"), of(-1).alias("only_b"), cells.alias("cells"))


def _cells(entries: DataFrame) -> DataFrame:
    """Cells that hold something, from ``pair, cells, k, n`` digests or from cells and their changes."""
    if "cell" not in entries.columns:
        cell = F.explode(F.array(*_places(F.col("k"), F.col("cells"))))
        entries = entries.select("pair", "cells", cell.alias("cell"), "n", "k", _check(F.col("k")).alias("c"))
    summed = entries.groupBy("pair", "cells", "cell").agg(
        F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")
    )
    return summed.where("n <> 0 or k <> 0 or c <> 0")


def _peeled_in_tables(pairs: DataFrame, key: list[str], cells: int) -> DataFrame:
    """``differing`` for pairs of any size: the work of a round grows with the number of filled cells."""
    wanted = F.greatest(F.lit(cells), F.ceil((F.size("a") + F.size("b")) / 2)).cast("long")
    rest = stored(pairs.withColumns({"pair": F.monotonically_increasing_id(), "cells": wanted}), "large")
    done = []
    while rest.take(1):
        of = lambda side, sign: rest.select("pair", "cells", F.explode(side).alias("k"), F.lit(sign).cast("long").alias("n"))
        table, found = stored(_cells(of("a", 1).unionByName(of("b", -1))), "cells"), []
        for _ in range(TABLE_ROUNDS):
            lone = table.where((F.abs("n") == 1) & (F.col("c") == _check(F.col("k"))))
            lone = stored(lone.select("pair", "cells", "k", "n").distinct(), "lone")
            if not lone.take(1):
                break
            found.append(lone)
            gone = lone.select(
                "pair", "cells", F.explode(F.array(*_places(F.col("k"), F.col("cells")))).alias("cell"),
                (-F.col("n")).alias("n"), "k", _check(F.col("k")).alias("c"),
            )
            table = stored(_cells(table.unionByName(gone)), "cells")
        stuck = stored(table.select("pair").distinct(), "stuck")
        told = rest.drop("a", "b").join(stuck, "pair", "left_anti")
        if found:
            lists = reduce(DataFrame.unionByName, found).groupBy("pair").agg(F.collect_list(_told(F.col("k"), F.col("n"))).alias("found"))
            told = told.join(lists, "pair", "left")
        else:
            told = told.withColumn("found", F.lit(None).cast("array<struct<k:bigint,n:int>>"))
        told = told.withColumn("found", F.coalesce("found", F.array().cast("array<struct<k:bigint,n:int>>")))
        done.append(stored(_sides(told, key, F.col("cells")), "told"))
        rest = stored(rest.join(stuck, "pair").withColumn("cells", F.col("cells") * GROWTH), "large")
    return reduce(DataFrame.unionByName, done)


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """Shared paragraphs over all paragraphs of two texts; 1 if neither has any."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise((total - differ) / (total + differ))


def successors(ids: DataFrame) -> DataFrame:
    """Next row by ``key`` for each row, the first after the last: adds ``next``.

    ``ids`` holds distinct numbers. They are range-partitioned, each range looks at itself, and
    only the first key of each range is passed to the range before.
    """
    ranges = max(1, ids.count() // ROWS_PER_RANGE)
    ranged = ids.repartitionByRange(ranges, "key").withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    firsts = ranged.groupBy("_range").agg(F.min("key").alias("_first"))
    firsts = firsts.select(
        "_range",
        F.coalesce(
            F.lead("_first").over(Window.orderBy("_range")), F.min("_first").over(Window.partitionBy())
        ).alias("_after"),
    )
    inner = F.lead("key").over(Window.partitionBy("_range").orderBy("key"))
    ranged = ranged.withColumn("_next", inner).join(firsts, "_range")
    return ranged.withColumn("next", F.coalesce("_next", "_after")).drop("_range", "_next", "_after")


def _documents(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``key, text`` of each document, and the ``key, doc_id, copies`` behind it where ids do not tell rows apart.

    Rows of one id and one text are one document. Keys go by id, none first, then by a digest of the text.
    """
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if not odd.take(1):
        return rows.select(F.col("doc_id").alias("key"), "text"), None
    marked = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    named = marked.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    named = named.orderBy(F.col("doc_id").asc_nulls_first(), "digest")
    named = stored(named.select(F.monotonically_increasing_id().alias("key"), "doc_id", "digest", "copies"), "keys")
    keys = named.select("key", "digest", F.col("doc_id").alias("_doc"))
    texts = marked.dropDuplicates(["doc_id", "digest"]).join(keys, "digest").where(F.col("doc_id").eqNullSafe(F.col("_doc")))
    return stored(texts.select("key", "text"), "texts"), named


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has the last half of the code points (rounded down) replaced by as many first
    ones of the next document, or all of them. Returns ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, cells_edited, cells_next``: the last two are the
    cells per table with which the two pairs of sketches can be peeled. Null texts are empty.

    One row per row of ``docs``. Documents go by id, rows without id first; different texts of one id are
    documents of their own, ordered by a digest; repeated rows are one document and get equal rows.

    Only the parts of texts that the neighbours need are moved a second time; everything after
    works on paragraph digests.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    rows, named = _documents(rows)
    known = stored(
        rows.select("key", F.length("text").cast("long").alias("n_chars"), paragraph_digests(F.col("text")).alias("own")), "digests"
    )
    order = stored(successors(known.select("key", "n_chars")), "order")
    half = F.floor(F.col("n_chars") / 2)
    wanted = order.select(F.col("next").alias("key"), F.col("key").alias("to"), half.cast("int").alias("half"))
    heads = rows.join(wanted, "key").select(F.col("to").alias("key"), F.expr("substring(text, 1, half)").alias("head"), "half")
    edited = rows.join(heads, "key").select(
        "key", F.concat(F.expr("substring(text, 1, length(text) - half)"), "head").alias("edited")
    )
    edited = stored(
        edited.select(
            "key", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            paragraph_digests(F.col("edited")).alias("edited"),
        ),
        "edited",
    )
    follow = order.select(F.col("next"), F.col("key").alias("_to")).join(
        known.select(F.col("key").alias("next"), F.col("own").alias("following")), "next"
    ).select(F.col("_to").alias("key"), "following")
    base = stored(known.join(edited, "key").join(follow, "key"), "sketched")
    pairs = base.select("key", F.lit(0).alias("side"), F.col("own").alias("a"), F.col("edited").alias("b")).unionByName(
        base.select("key", F.lit(1).alias("side"), F.col("own").alias("a"), F.col("following").alias("b"))
    )
    apart = differing(pairs, ["key", "side"], cells).select(
        "key", "side", (F.size("only_a") + F.size("only_b")).alias("differ"), F.col("cells").alias("_size")
    )
    of = lambda side, column: F.max(F.when(F.col("side") == side, F.col(column)))
    apart = apart.groupBy("key").agg(
        of(0, "differ").alias("_edited"), of(1, "differ").alias("_next"),
        of(0, "_size").alias("cells_edited"), of(1, "_size").alias("cells_next"),
    )
    found = base.join(apart, "key").select(
        "key",
        "n_chars",
        "edited_sha256",
        render(sketch(F.col("own"), cells)).alias("fingerprint"),
        render(sketch(F.col("edited"), cells)).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("following"), F.col("_next")).alias("near_next"),
        "cells_edited",
        "cells_next",
    )
    if named is None:
        return found.withColumnRenamed("key", "doc_id")
    found = found.join(named.drop("digest"), "key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select("doc_id", *[c for c in found.columns if c not in ("key", "doc_id", "copies", "_copy")])
