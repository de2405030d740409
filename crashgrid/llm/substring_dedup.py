"""Remove passages that another document had before: repeated-phrase automata.

1. Every text is scanned for anchors: of each window of 50 words, the least hash among its phrases
   of 10 words. Equal windows have equal anchors, and few phrases are anchors.
2. Anchors found in several documents point to windows that may recur; these are compared across
   documents. The first document of each recurring window holds it as part of a passage.
3. Passages are compiled into sharded Aho-Corasick automata over words. Phrases are set so closely
   that every window of a passage contains one. Documents stream through the automata of the
   shards that hold passages of theirs; every hit in such a passage is extended word by word, and
   a match of a window or more is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrid.llm.common import stored
from crashgrid.llm.text import Words, sliding_min, slices

# Fixed value of the contract.
WINDOW = 50

PHRASE = 10  # words of an anchor, and of a phrase in the automata
SHARD_WORDS = 400_000  # passage words of one shard
SLICE_CHARS = 8_000_000  # document text that meets a shard in one task


def _anchors(words: Words) -> np.ndarray:
    """Anchor of the window from each word on."""
    runs = words.runs(PHRASE)
    width = WINDOW - PHRASE + 1
    return sliding_min(runs, width).view(np.int64) if len(runs) >= width else np.zeros(0, np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            words = Words(batch.column("text"))
            anchors, first = _anchors(words), words.first
            found = [
                np.unique(anchors[a : b - WINDOW + 1]) if b - a >= WINDOW else np.zeros(0, np.int64)
                for a, b in zip(first[:-1], first[1:], strict=True)
            ]
            texts = batch.column("text").fill_null("").cast(pa.large_binary()).to_pylist()
            digests = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            flat = np.concatenate([*found, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                ["doc_id", "n_words", "sha256", "anchors"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, document and position of every window whose anchor recurs."""
    for whole in batches:
        for batch in slices(whole, "text"):
            words = Words(batch.column("text"))
            anchors, hashes, first = _anchors(words), words.runs(WINDOW).view(np.int64), words.first
            out = []
            for doc, known, a, b in zip(
                batch.column("doc_id").to_pylist(), batch.column("anchors"), first[:-1], first[1:], strict=True
            ):
                if b - a >= WINDOW:
                    at = np.flatnonzero(np.isin(anchors[a : b - WINDOW + 1], known.values.to_numpy()))
                    out.append((hashes[a + at], np.full(len(at), doc, np.int64), at.astype(np.int32)))
            if out:
                columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["window", "doc_id", "pos"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of a document: runs of windows of which it is the first document."""
    for whole in batches:
        for batch in slices(whole, "text"):
            words = Words(batch.column("text"))
            first, data = words.first, words.data.tobytes()
            docs, texts, sizes = [], [], []
            for doc, marks, a, b in zip(
                batch.column("doc_id").to_pylist(), batch.column("marks"), first[:-1], first[1:], strict=True
            ):
                at = np.unique(marks.values.to_numpy())
                at = at[at + WINDOW <= b - a]
                for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                    low, high = int(a + run[0]), int(a + run[-1] + WINDOW)
                    docs.append(doc)
                    texts.append(data[words.start[low] : words.end[high - 1]])
                    sizes.append(high - low)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(sizes, pa.int64()),
                ],
                ["first_doc", "passage", "size"],
            )


class Automaton:
    """Aho-Corasick automaton over the words of passages.

    A phrase leads to the places where passages have it, by the document of the passage.
    """

    def __init__(self, passages: pa.Array, docs: list[int]) -> None:
        words = Words(passages)
        self.hash, self.first = words.hash, words.first.tolist()
        keys = (words.hash >> np.uint64(33)).tolist()
        phrases: dict[tuple, dict[int, list]] = {}
        for i, (doc, a, b) in enumerate(zip(docs, self.first[:-1], self.first[1:], strict=True)):
            last = b - PHRASE
            for at in [*range(a, last, WINDOW - PHRASE + 1), last] if last >= a else []:
                places = phrases.setdefault(tuple(keys[at : at + PHRASE]), {})
                places.setdefault(doc, []).append((i, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, places in phrases.items():
            self.automaton.add_word(phrase, places)
        if phrases:
            self.automaton.make_automaton()
        self.empty = not phrases

    def repeats(self, sources: list[int], hashes: np.ndarray) -> np.ndarray:
        """Which words of a document lie in a window that a passage of the sources has."""
        covered = np.zeros(len(hashes), bool)
        if self.empty or len(hashes) < WINDOW:
            return covered
        wanted = set(sources)
        for end, places in self.automaton.iter(tuple((hashes >> np.uint64(33)).tolist())):
            at = end - PHRASE + 1
            for source in wanted & places.keys():
                for passage, there in places[source]:
                    if covered[max(0, at + PHRASE - WINDOW) : at + WINDOW].all():
                        break  # every window with this phrase is known to recur
                    low, high = self.first[passage], self.first[passage + 1]
                    n = min(at, there - low)
                    differ = np.flatnonzero(hashes[at - n : at][::-1] != self.hash[there - n : there][::-1])
                    left = int(differ[0]) if len(differ) else n
                    n = min(len(hashes) - at, high - there)
                    differ = np.flatnonzero(hashes[at : at + n] != self.hash[there : there + n])
                    right = int(differ[0]) if len(differ) else n
                    if left + right >= WINDOW:
                        covered[at - left : at + right] = True
        return covered


_SPANS = "doc_id long, sha256 string, spans array<int>"


def _locate(passages: pa.Table, docs: pa.Table) -> pa.Table:
    """Spans (from, to, from, to ...) of repeated words of the documents of one slice of a shard."""
    automaton = Automaton(passages.column("passage").combine_chunks(), passages.column("first_doc").to_pylist())
    ids, digests, spans = [], [], []
    for batch in docs.combine_chunks().to_batches():
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            texts = part.column("text").cast(pa.large_binary()).to_pylist()
            for doc, sources, text, a, b in zip(
                part.column("doc_id").to_pylist(),
                part.column("sources").to_pylist(),
                texts,
                words.first[:-1],
                words.first[1:],
                strict=True,
            ):
                covered = automaton.repeats(sources, words.hash[a:b])
                if covered.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
                    ids.append(doc)
                    digests.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                    spans.append(edges.tolist())
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "sha256": pa.array(digests, pa.string()),
            "spans": pa.array(spans, pa.list_(pa.int32())),
        }
    )


_KEPT = "doc_id long, sha256 string, n_removed long, kept string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept, wanted = [], [], []
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        for text, digest, spans in zip(texts, batch.column("sha256").to_pylist(), batch.column("spans"), strict=True):
            words = text.split()
            wanted.append(hashlib.sha256(b" ".join(words)).hexdigest() == digest)
            gone = np.zeros(len(words) + 1, np.int32)
            edges = spans.values.to_numpy()
            if wanted[-1]:
                np.add.at(gone, edges[0::2], 1)
                np.add.at(gone, edges[1::2], -1)
            mask = np.cumsum(gone)[:-1] > 0
            removed.append(int(mask.sum()))
            kept.append(b" ".join([w for w, g in zip(words, mask.tolist(), strict=True) if not g]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("sha256"),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "sha256", "n_removed", "kept"],
        ).filter(pa.array(wanted, pa.bool_()))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of each document without those that a smaller document has in a window of 50 words.

    Returns one row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, kept``. ``kept``
    joins the remaining words by one space and is null where nothing was removed; the digest is of
    the words that are kept. Windows are judged on the input. Null and empty texts, texts of less
    than 50 words and rows without id lose nothing; repeated rows of one id are the same document;
    of different texts under one id each is judged by itself.

    Documents of equal words are one class from the start: all but the smallest lose everything,
    so a text that makes up a third of all rows is read once. Counts over anchors and windows are
    reduced before they are shuffled; a shard's documents meet it in slices of bounded text.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scanned = stored(rows.mapInArrow(_scan, "doc_id long, n_words long, sha256 string, anchors array<long>"), "scan")
    classes = scanned.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    first = stored(classes.groupBy("sha256").agg(F.min("doc_id").alias("doc_id")), "classes")
    anchored = classes.join(first, ["doc_id", "sha256"]).select("doc_id", F.explode("anchors").alias("anchor")).distinct()
    anchored = stored(anchored, "anchors")
    recurring = stored(
        anchored.groupBy("anchor").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
        .where("_low < _high").select("anchor"),
        "recurring",
    )
    mine = anchored.join(recurring, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    texts = stored(rows.join(mine, "doc_id"), "candidates")

    windows = texts.mapInArrow(_windows, "window long, doc_id long, pos int")
    heads = windows.groupBy("window").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_last"), F.min_by("pos", "doc_id").alias("pos")
    )
    heads = stored(heads.where("first_doc < _last").drop("_last"), "heads")
    marks = heads.groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_list("pos").alias("marks"))
    passages = texts.drop("anchors").join(marks, "doc_id")
    passages = stored(passages.mapInArrow(_cut, "first_doc long, passage string, size long"), "passages")
    sources = windows.select("window", "doc_id").join(heads.drop("pos"), "window").where("first_doc < doc_id")
    sources = stored(sources.select("doc_id", "first_doc").distinct(), "sources")

    total = passages.agg(F.sum("size")).first()[0] or 0
    shards = -(-total // SHARD_WORDS) or 1
    shard = F.pmod(F.xxhash64("first_doc"), F.lit(shards)).cast("int").alias("shard")
    routed = sources.select("doc_id", "first_doc", shard).groupBy("doc_id", "shard").agg(
        F.collect_list("first_doc").alias("sources")
    )
    routed = stored(routed.join(texts.select("doc_id", F.length("text").alias("chars")), "doc_id"), "routed")
    counts = routed.groupBy("shard").agg(F.ceil(F.sum("chars") / SLICE_CHARS).cast("int").alias("slices"))
    counts = stored(counts, "slices")
    sliced = routed.join(counts, "shard").select(
        "doc_id", "shard", "sources", F.pmod(F.xxhash64("doc_id"), "slices").cast("int").alias("slice")
    )
    there = texts.select("doc_id", "text").join(sliced, "doc_id").select("shard", "slice", "doc_id", "sources", "text")
    patterns = passages.select(shard, "first_doc", "passage").join(counts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "first_doc", "passage"
    )
    spans = patterns.groupBy("shard", "slice").cogroup(there.groupBy("shard", "slice")).applyInArrow(_locate, _SPANS)
    spans = stored(spans, "spans").groupBy("doc_id", "sha256").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    changed = stored(texts.drop("anchors").join(spans, "doc_id").mapInArrow(_remove, _KEPT), "changed")

    changed = changed.dropDuplicates(["doc_id", "sha256"])
    leads = first.select(F.col("doc_id"), "sha256", F.lit(True).alias("_leads"))
    out = scanned.drop("anchors").join(leads, ["doc_id", "sha256"], "left").join(changed, ["doc_id", "sha256"], "left")
    copy = F.col("_leads").isNull() & F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW)
    gone = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(copy, F.lit("")).otherwise(F.col("kept"))
    return out.select("doc_id", "n_words", gone.cast("long").alias("n_removed"), kept.alias("kept"), "sha256").select(
        "doc_id", "n_words", "n_removed",
        F.coalesce(F.sha2(F.col("kept").cast("binary"), 256), F.col("sha256")).alias("kept_sha256"), "kept",
    )
