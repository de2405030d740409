"""Spelling variants by a trie over letter counts.

A word's vector counts its letters by group. One edit adds at most one surplus and one deficit to the
vector, so near words are found in a trie of the successive counts by a depth-first search with a budget of one of
each. What the search reaches is compared letter by letter.

The top of the trie (the length and the first counts) deals the words out over tasks: a word is
stored under its own top and looks for others under every top its budget reaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrid.llm.common import stored
from crashgrid.llm.text import byte_buffer, slices

# Fixed values of the contract.
EVERY = 199
SHORTEST = 6
LEAST = 5
RATIO = 5

#: Letters that are counted together, the commonest first; all others are one more group.
GROUPS = ["e", "t", "a", "n", "i", "o", "r", "s", "h", "l", "d", "u", "c", "gm", "fwy", "bp", "kv", "jqxz"]
TOP = 3  # counts that deal the words out
LEAF = 48  # stored words of a node that is searched no deeper
PER_TASK = 20_000  # stored words of one top that one task takes
PAIRS = 1 << 18  # compared at once
SLICE_BYTES = 1 << 22

_GROUP = np.full(256, len(GROUPS), np.int8)
for _g, _letters in enumerate(GROUPS):
    _GROUP[[ord(c) for c in _letters]] = _g

_START = np.zeros(256, bool)  # ASCII letters, and the first byte of U+00C0 to U+00FF
_START[[*range(65, 91), *range(97, 123), 0xC3]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLED = 64  # byte lengths whose check sums come from a table


def without(word: str, place: int) -> str:
    return word[:place] + word[place + 1 :]


def _sums(prefixes: list[bytes], words: list[bytes], doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """CRC-32 of prefix ``doc`` followed by word ``code``, for many such pairs.

    Check sums are affine: that of A and B is that of A and as many zeros, changed by what B alone
    differs from zeros. So a few sums per prefix and per word give those of all pairs.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    zeros = [bytes(n) for n in range(_TABLED)]
    padded = np.array([[zlib.crc32(z, s) for z in zeros] for s in map(zlib.crc32, prefixes)], np.uint32)
    own = np.fromiter((zlib.crc32(w) ^ zlib.crc32(bytes(len(w))) for w in words), np.uint32, len(words))
    sums = padded[doc, np.minimum(sizes[code], _TABLED - 1)] ^ own[code]
    for i in np.flatnonzero(sizes[code] >= _TABLED).tolist():
        sums[i] = zlib.crc32(prefixes[doc[i]] + words[code[i]])
    return sums


def _count(every: int, shortest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                data, bounds = byte_buffer(batch.column("text"))
                after_lead = np.concatenate([[False], data[:-1] == 0xC3])[: len(data)]
                inside = np.concatenate([[False], _START[data] | after_lead, [False]])
                cut = np.zeros(len(data) + 1, bool)
                cut[bounds] = True  # a run ends with its text
                edges = inside[1:-1]
                starts = np.flatnonzero(edges & (~inside[:-2] | cut[:-1]))
                ends = np.flatnonzero(edges & (~inside[2:] | cut[1:])) + 1
                if not len(starts):
                    continue
                offsets = np.concatenate([[0], np.cumsum(ends - starts)])
                letters = _LOWER[data[edges]]
                runs = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]
                ).dictionary_encode()
                words, code = runs.dictionary.to_pylist(), runs.indices.to_numpy()
                doc = np.searchsorted(bounds, starts, "right") - 1
                ids = ["" if d is None else str(d) for d in batch.column("doc_id").to_pylist()]
                sums = _sums([f"{d}:".encode() for d in ids], words, doc, code)
                hit = sums % np.uint32(every) == 0
                n = np.bincount(code[~hit], minlength=len(words))
                spelled = [w.decode() for w in words]
                counts = {w: k for w, k in zip(spelled, n.tolist(), strict=True) if k and len(w) >= shortest}
                for h, c in zip(sums[hit].tolist(), code[hit].tolist(), strict=True):
                    word = without(spelled[c], h % len(spelled[c]))
                    if len(word) >= shortest:
                        counts[word] = counts.get(word, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
                )

    return count


def counted_words(docs: DataFrame, every: int = EVERY, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """Words of ``doc_id, text`` rows and how often they occur: ``word, n``."""
    found = docs.mapInArrow(_count(every, shortest), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def vectors(words: pa.Array) -> np.ndarray:
    """Letter counts by group, a row per word. A letter beyond ASCII counts once."""
    data, bounds = byte_buffer(words)
    owner = np.repeat(np.arange(len(words)), np.diff(bounds))
    letters = data & 0xC0 != 0x80  # first bytes only
    flat = np.bincount(owner[letters] * (len(GROUPS) + 1) + _GROUP[data[letters]], minlength=len(words) * (len(GROUPS) + 1))
    return flat.reshape(len(words), len(GROUPS) + 1)


_KEYED = "word string, n long, key array<int>"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The top of the trie for each word: length, then the first counts."""
    for batch in batches:
        counts = vectors(batch.column("word"))
        keys = np.concatenate([counts.sum(axis=1, keepdims=True), counts[:, :TOP]], axis=1).astype(np.int32)
        steps = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), batch.column("n"), pa.ListArray.from_arrays(steps, pa.array(keys.reshape(-1)))], ["word", "n", "key"]
        )


def _reachable() -> list[list[int]]:
    """Changes of the top within the budget: to words as long or longer by one; of those as long, only one of both directions."""
    unit = lambda i: [int(k == i) for k in range(TOP)]
    none = [0] * TOP
    added = [none, *(unit(i) for i in range(TOP))]
    moved = [[a - b for a, b in zip(x, y, strict=True)] for x in added for y in added]
    moved = [m for m in dict.fromkeys(map(tuple, moved)) if m >= tuple(none)]
    return [[0, *m] for m in moved] + [[1, *m] for m in added]


def _near(letters: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Do words of n letters (rows) turn into the others, of n or n + 1, by one edit?"""
    n = letters.shape[1]
    differ = letters != others[:, :n]
    if others.shape[1] == n:
        return differ.sum(axis=1) == 1
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
    rest = np.arange(n) >= first[:, None]
    return ~((letters != others[:, 1:]) & rest).any(axis=1)


class Trie:
    """Words of one length by their letter counts. A node is a range of the sorted vectors."""

    def __init__(self, words: list[str]) -> None:
        counts = vectors(pa.array(words, pa.string()))
        self.order = np.lexsort(counts.T[::-1])
        self.counts = counts[self.order]
        self.letters = _letters([words[i] for i in self.order.tolist()])

    def search(self, counts: np.ndarray, letters: np.ndarray, surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs ``(query, word)`` of near words; budgets are those of the stored words against the queries."""
        every = np.arange(len(counts))
        stack = [(0, 0, len(self.counts), every, np.full(len(counts), surplus), np.full(len(counts), deficit))]
        while stack:
            level, low, high, queries, more, less = stack.pop()
            if high - low <= LEAF or level == self.counts.shape[1]:
                yield from self._compare(low, high, queries, counts, letters, more, less, level)
                continue
            column = self.counts[low:high, level]
            values, starts = np.unique(column, return_index=True)
            wanted = counts[queries, level]
            for value, a, b in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), high - low], strict=True):
                change = value - wanted
                left_more, left_less = more - np.maximum(change, 0), less - np.maximum(-change, 0)
                alive = (left_more >= 0) & (left_less >= 0)
                if alive.any():
                    stack.append((level + 1, low + a, low + b, queries[alive], left_more[alive], left_less[alive]))

    def _compare(self, low, high, queries, counts, letters, more, less, level) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, PAIRS // (high - low))
        stored_rest = self.counts[low:high, level:]
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            query, word = np.repeat(np.arange(len(some)), high - low), np.tile(np.arange(high - low), len(some))
            change = stored_rest[word] - counts[some, level:][query]
            good = (np.maximum(change, 0).sum(axis=1) <= more[at : at + step][query]) & (
                np.maximum(-change, 0).sum(axis=1) <= less[at : at + step][query]
            )
            query, word = some[query[good]], word[good] + low
            good = _near(letters[query], self.letters[word])
            yield query[good], self.order[word[good]]


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return flat.reshape(len(words), -1).astype(np.int32)


_PAIRS = "word string, n long, near string, near_n long"


def _meet(asking: pa.Table, kept: pa.Table) -> pa.Table:
    """Near pairs of the words that look for others under one top and those stored there."""
    found: list[list] = [[], [], [], []]
    if len(asking) and len(kept):
        words, n = kept.column("word").to_pylist(), kept.column("n").to_numpy()
        trie = Trie(words)
        for longer in (0, 1):
            mine = asking.filter(pc.equal(asking.column("longer"), longer))
            if not len(mine):
                continue
            queries, counted = mine.column("word").to_pylist(), mine.column("n").to_numpy()
            own, same_top = vectors(mine.column("word").combine_chunks()), mine.column("same").to_numpy(zero_copy_only=False)
            for q, w in trie.search(own, _letters(queries), 1, 1 - longer):
                for a, b in zip(q.tolist(), w.tolist(), strict=True):
                    if not same_top[a] or queries[a] < words[b]:  # under one's own top each pair meets twice
                        found[0].append(queries[a])
                        found[1].append(counted[a])
                        found[2].append(words[b])
                        found[3].append(n[b])
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], ["word", "n", "near", "near_n"])


def near_words(words: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """Pairs of words one edit apart, each pair once: ``word, n, near, near_n``.

    A top with more than ``per_task`` words is dealt out over several tasks; the words that look for
    others there visit each of them.
    """
    keyed = stored(words.select("word", "n").mapInArrow(_keys, _KEYED), "keyed")
    tops = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("parts"))
    tops = stored(tops, "tops")
    kept = keyed.join(tops, "key").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    change = F.explode(F.array(*[F.array(*map(F.lit, m)) for m in _reachable()]))
    asking = keyed.select("word", "n", F.col("key").alias("own"), change.alias("change"))
    asking = asking.select(
        "word", "n", F.zip_with("own", "change", lambda a, b: a + b).alias("key"), F.col("change")[0].alias("longer"),
        F.forall("change", lambda x: x == 0).alias("same"),
    )
    asking = asking.join(tops, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kept = kept.select(*[F.col(c).alias(c) for c in ("key", "part", "word", "n")])  # columns of its own, apart from those asking
    asking = asking.select("key", "part", "word", "n", "longer", "same")
    return asking.groupBy("key", "part").cogroup(kept.groupBy("key", "part")).applyInArrow(_meet, _PAIRS)


def _roots(forms: DataFrame) -> DataFrame:
    """Follow forms to the last: ``word, root``. Each round doubles the steps; a form's count is ``RATIO`` times its word's, so
    chains are no longer than a logarithm of the largest count."""
    links = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while links.where("moved").take(1):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = stored(
            links.join(onward, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")
            ),
            "roots",
        )
    return links.select("word", "root")


def spelling_variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = EVERY, shortest: int = SHORTEST,
    least: int = LEAST, ratio: int = RATIO, per_task: int = PER_TASK,
) -> DataFrame:
    """Words and the more frequent word each is a variant of: ``word, form, root, n, n_near, form_n``.

    Runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, are counted; a run of one in ``every``
    (by check sum of document and run) loses one letter first. Words have ``shortest`` letters and occur ``least`` times or more.
    Near words differ by one inserted, deleted or replaced letter; ``n_near`` counts them. The form is the most frequent near
    word (ties: the smallest) if it occurs ``ratio`` times as often or more, else null; the root is where forms lead, the word itself without form.

    Null and empty texts have no words; a null id reads as an empty string; repeated rows count again;
    an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = stored(counted_words(rows.where(F.col("text") != ""), every, shortest, least), "words")
    pairs = stored(near_words(words, per_task), "near")
    both = pairs.unionByName(
        pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    )
    best: Column = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = stored(both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "best")
    near = near.select(
        "word", "n_near",
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("n"))).alias("of"),
    )
    roots = _roots(near.where(F.col("of").isNotNull()).select("word", "of.form"))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", F.col("of.form").alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("of.n").alias("form_n"),
    )
