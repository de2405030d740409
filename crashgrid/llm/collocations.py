"""Phrase collocations by stripes.

Every prefix of up to three words keys a stripe: a counter of the words that follow it, and one slot
for all its own occurrences. Tasks fill the stripes of a slice of text, slots are added up over all
tasks, and the merged stripes hold everything the scores need: how often a phrase occurs (the slot of its
last word), how often a prefix occurs (its own slot) and the most frequent extension of a phrase.

A phrase is no more frequent than any part of it. So before any stripe is filled, phrases are counted by
hash, one word longer in each pass over the texts, and a pass looks only at phrases whose parts were
frequent enough in the pass before. Stripes then hold only slots that pass these filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrid.llm.common import stored
from crashgrid.llm.text import BASE, BASE_INVERSE, BYTES, mixed, powers, slices

# Fixed values of the contract.
BLANKS, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
NO_LANGUAGE = "und"
LONGEST = 4
LEAST = 30
SUBSUMED = 80
TOP = 2000
SCALE = 2_000_000

SLICE_BYTES = 1 << 21
BITS_PER_PHRASE = 16
MOST_BITS = 1 << 27  # of the filter that travels to the tasks: 16 MB, at any size of the corpus

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of many texts: ``code`` into ``spelled``, ``hash`` and ``text`` of each, and whether the next one ``follows``
    it in the same piece."""

    def __init__(self, column: pa.Array) -> None:
        texts = column.fill_null("").cast(pa.large_binary()).to_pylist()
        data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)]
        kind = _KIND[data]
        inside = np.concatenate([[False], kind == 0])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        self.follows = np.append(piece[1:] == piece[:-1], False)[: len(start)]
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
        letters, offsets = data[kind == 0], np.concatenate([[0], np.cumsum(end - start)])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]
        ).dictionary_encode()
        self.spelled, self.code = words.dictionary.cast(pa.string()), words.indices.to_numpy().astype(np.int64)
        self.hash = _hashes(words.dictionary)[self.code]

    def grams(self, n: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on (``of``: what else tells phrases apart), and if they are of one piece."""
        total, whole = of.copy(), np.ones(len(self.code), bool)
        for k in range(n):
            after = max(len(total) - k, 0)
            total[:after] = mixed(total[:after] * np.uint64(BASE) + self.hash[k:])
            if k:
                whole[:after] &= self.follows[k - 1 : k - 1 + after]
                whole[after:] = False
        return total, whole

    def phrase(self, at: np.ndarray, n: int) -> pa.Array:
        """The n words from each of some words on, joined by spaces."""
        parts = [self.spelled.take(pa.array(self.code[at + k])) for k in range(n)]
        return pc.binary_join_element_wise(*parts, " ") if parts else pa.array([""] * len(at), pa.string())


def _hashes(words: pa.Array) -> np.ndarray:
    """A number for the bytes of each string, the same in every task."""
    words = words.cast(pa.large_binary())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words) or bounds[-1] == bounds[0]:
        return mixed(np.full(len(words), 5, np.uint64))
    data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * powers(BASE, len(data)))])
    low, high = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    return mixed((total[high] - total[low]) * powers(BASE_INVERSE, len(data) + 1)[low] + (high - low + 5).astype(np.uint64))


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(34) & mask).astype(np.int64)


class Frequent:
    """Filter of frequent phrases (a Bloom filter with two probes): it lets all of them pass, and a few others.

    It only saves work. What it lets pass is counted under its own words, so no result depends on its size,
    nor on two phrases of one hash.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.words = words  # 64 bits each

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for probe in _probes(hashes, 64 * len(self.words)):
            found &= (self.words[probe >> 6] >> (probe & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found

    @staticmethod
    def of(hashes: DataFrame) -> Frequent:
        """Filter of a table of distinct ``hash`` values."""
        wanted = max(64, BITS_PER_PHRASE * hashes.count())
        bits = min(MOST_BITS, 1 << (wanted - 1).bit_length())

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                probes = np.unique(np.concatenate(_probes(batch.column("hash").to_numpy().view(np.uint64), bits)))
                mask = np.left_shift(np.uint64(1), (probes & 63).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(probes >> 6), pa.array(mask)], ["slot", "mask"])

        rows = hashes.select("hash").mapInArrow(marked, "slot long, mask long")
        table = rows.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[table.column("slot").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
        return Frequent(words)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array, np.ndarray]]:
    """Words of slices of bounded text, the languages of the slice, and which of them each word is in."""
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            words = Words(batch.column("text"))
            if len(words.code):
                langs = batch.column("lang").dictionary_encode()
                yield words, langs.dictionary, langs.indices.to_numpy().astype(np.int64)[words.text]


def _hashed(length: int, shorter: Frequent | None) -> Mapper:
    """``hash, n`` of the phrases of ``length`` words whose first and last part, a word shorter, may be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, lang in _texts(batches):
            of = _hashes(langs)[lang]
            if shorter is not None:
                parts, one_piece = words.grams(length - 1, of)
                usable = shorter.passes(parts) & one_piece
                usable[:-1] &= usable[1:]
                usable[-1] = False
            hashes, one_piece = words.grams(length, of)
            found, n = np.unique(hashes[one_piece if shorter is None else one_piece & usable], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["hash", "n"])

    return count


_STRIPES = "length int, lang string, prefix string, next array<string>, n array<long>"


def _stripe_batches(
    words: Words, langs: pa.Array, lang: np.ndarray, at: np.ndarray, extends: np.ndarray, length: int
) -> Iterator[pa.RecordBatch]:
    """Stripes of the prefixes that begin at some words; ``extends`` says whose next word has a slot."""
    size, first = len(words.spelled), None
    stripe = lang[at]
    for k in range(length):
        stripe = stripe * size + words.code[at + k]
        _, first, stripe = np.unique(stripe, return_index=True, return_inverse=True)
    if first is None:
        _, first, stripe = np.unique(stripe, return_index=True, return_inverse=True)
    slot, n = np.unique(stripe[extends] * size + words.code[at[extends] + length], return_counts=True)
    owner = slot // size
    order = np.argsort(np.concatenate([np.arange(len(first)), owner]), kind="stable")  # the prefix's own slot first
    following = np.concatenate([np.full(len(first), -1), slot % size])[order]
    n = np.concatenate([np.bincount(stripe, minlength=len(first)), n])[order]
    ends = np.concatenate([[0], np.cumsum(1 + np.bincount(owner, minlength=len(first)))]).astype(np.int32)
    spelled = words.spelled.take(pa.array(following, mask=following < 0))
    for low in range(0, len(first), 20_000):
        high = min(low + 20_000, len(first))
        a, b = int(ends[low]), int(ends[high])
        offsets, heads = pa.array(ends[low : high + 1] - ends[low]), at[first[low:high]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(high - low, length, np.int32)),
                langs.take(pa.array(lang[heads])).cast(pa.string()),
                words.phrase(heads, length),
                pa.ListArray.from_arrays(offsets, spelled[a:b]),
                pa.ListArray.from_arrays(offsets, pa.array(n[a:b])),
            ],
            [c.split()[0] for c in _STRIPES.split(", ")],
        )


def _stripes(frequent: list[Frequent]) -> Mapper:
    """Stripes of the empty prefix and of those that may be frequent; the slot without a word counts the prefix itself.

    ``frequent`` holds the filters of phrases of one word, of two, and so on.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, lang in _texts(batches):
            of, counts = _hashes(langs)[lang], np.ones(len(words.code), bool)
            for length, longer in enumerate(frequent):
                hashes, one_piece = words.grams(length + 1, of)
                extended = longer.passes(hashes) & one_piece
                at = np.flatnonzero(counts)
                yield from _stripe_batches(words, langs, lang, at, extended[at], length)
                counts = extended

    return fill


def merged_stripes(rows: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """Slots of all stripes with a count of ``least`` or more: ``length, lang, prefix, next, n``.

    ``length`` is that of the prefix; ``next`` is null in the slot of the prefix itself. The merge
    works slot by slot, so a stripe is never gathered: that of a very common prefix (the stripe of the
    empty prefix is the whole vocabulary) spreads over all tasks.
    """
    filters: list[Frequent] = []
    for length in range(1, longest + 1):
        hashed = rows.mapInArrow(_hashed(length, filters[-1] if filters else None), "hash long, n long")
        hashed = hashed.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash")
        filters.append(Frequent.of(stored(hashed, "frequent")))
    slots = rows.mapInArrow(_stripes(filters), _STRIPES)
    slots = slots.select("length", "lang", "prefix", F.inline(F.arrays_zip("next", "n")))
    slots = slots.groupBy("length", "lang", "prefix", "next").agg(F.sum("n").alias("n"))
    return stored(slots.where(F.col("n") >= least), "stripes")


def _phrase() -> Column:
    return F.when(F.col("length") == 0, F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
    subsumed: int = SUBSUMED, top: int | None = TOP,
) -> DataFrame:
    """The phrases of each language whose words belong together most.

    A-Z are lower-cased, texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    spaces and tabs. A phrase of 2 to ``longest`` words that occurs ``a >= least`` times within
    pieces is a candidate. Its weakest cut into two parts that occur l and r times gives its score
    floor(2000000 a / (l + r)), at equal scores the first cut. Candidates inside a longer one that
    occurs at least ``subsumed`` percent as often are left out. Returns ``lang, rank, phrase, a, l,
    r, n, score`` with ``n`` words in the language, ranked by score, ``a``, then phrase (bytes), the
    first ``top`` of each language or all.

    Null languages are ``und``, null texts empty; repeated rows count as often as they occur; ids and
    other columns are not looked at. An empty table gives no rows.
    """
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).cast("string").alias("text")
    )
    slots = merged_stripes(rows.where(F.col("text") != ""), longest, least)
    extended = F.col("next").isNotNull()
    phrases = slots.where(extended & (F.col("length") > 0)).select(
        "lang", _phrase().alias("phrase"), (F.col("length") + 1).alias("words"), F.col("n").alias("a")
    )
    own = slots.where(~extended)
    counts = own.where("length > 0").select("lang", F.col("prefix").alias("part"), "n")

    parts = F.split("phrase", " ")
    cut = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select(
        "*", F.array_join(F.slice(parts, 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.lit(longest)), " ").alias("rest"),
    )
    cut = cut.join(counts.select("lang", F.col("part").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cut = cut.join(counts.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    exact = "cast(cast(a as decimal(20,0)) * {} div (cast(l as decimal(20,0)) + r) as long)"
    cut = cut.withColumn("score", F.expr(exact.format(SCALE)))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the most frequent extension by a word in front or behind; a longer one is no more frequent than these
    behind = slots.where(extended & (F.col("length") > 1)).select("lang", F.col("prefix").alias("phrase"), "n")
    in_front = phrases.where("words > 2").select(
        "lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), F.col("a").alias("n")
    )
    longer = behind.unionByName(in_front).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    inside = F.expr(f"cast(longer as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {int(subsumed)}")
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(inside, F.lit(False)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    words = own.where("length = 0").select("lang", "n")
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
