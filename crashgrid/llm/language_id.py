"""Language identification by segmentation-marginalised unigrams.

Each language gives every piece of a public vocabulary a probability, fitted by expectation
maximisation on a bounded sample of labelled documents. A text's probability in a language is the
product over its words of the sum over all ways to cut the word into pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from crashgrid.llm.text import slices
from crashgrid.llm.unigrams import LONGEST_WORD, START, Unigrams

# Fixed values of the contract.
UNKNOWN = "und"
FOLDS = 5

SAMPLE_PER_LANGUAGE = 500
MAX_CACHED = 100_000
SLICE_BYTES = 1 << 22


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def words_in(text: str) -> list[str]:
    """Runs of letters, lower-cased and marked as words; very long runs in parts."""
    words = []
    for run in regex.findall(r"\p{L}+", text):
        run = run.lower()
        words.append(START + run[:LONGEST_WORD])
        words += [run[i : i + LONGEST_WORD] for i in range(LONGEST_WORD, len(run), LONGEST_WORD)]
    return words


def pieces_of(path: str) -> list[str]:
    """Pieces of a sentencepiece vocabulary that stand for text."""
    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p for p in (model.id_to_piece(i) for i in ids) if p.strip(START) and p.lower() == p]


def train(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> Unigrams | None:
    """Fit on about ``per_language`` documents of each language, chosen by a hash of their ids.

    Only documents outside the held-out fold with text, id and language are looked at. The sample
    and the number of languages bound what reaches the driver. None without such documents.
    """
    usable = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sizes = {r["lang"]: r["count"] for r in usable.where(F.col("text").isNotNull()).groupBy("lang").count().collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for name, n in sizes.items():
        chosen = chosen | ((F.col("lang") == name) & (draw < per_language / n))
    sample = usable.where(chosen & F.col("text").isNotNull()).select("lang", "text").collect()
    languages = sorted(sizes)
    counted: dict[str, Counter] = {name: Counter() for name in languages}
    for row in sample:
        counted[row["lang"]].update(words_in(row["text"]))
    words = sorted(set().union(*counted.values()))
    counts = np.array([[counted[name][w] for name in languages] for w in words], float).reshape(len(words), len(languages))
    model = Unigrams(pieces_of(vocabulary), languages)
    model.fit(words, counts)
    return model


class _Scorer:
    """Scores of the units (text between spaces) met so far: one row per unit."""

    def __init__(self, model: Unigrams) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages) + 1))

    def look_up(self, units: list[str]) -> np.ndarray:
        if len(self.rows) > MAX_CACHED:
            self.reset()
        new = [u for u in units if u not in self.rows]
        if new:
            words = [words_in(u) for u in new]
            distinct = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
            scores = self.model.score(list(distinct))
            rows = np.zeros((len(new), self.table.shape[1]))
            owner = np.repeat(np.arange(len(new)), [len(ws) for ws in words])
            order = np.array([distinct[w] for ws in words for w in ws], np.int64)
            if len(order):
                np.add.at(rows[:, :-1], owner, scores[order])
                np.add.at(rows[:, -1], owner, 1)
            self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, rows])
        return self.table[np.fromiter(map(self.rows.__getitem__, units), np.int64, len(units))]


def _judge(model: Unigrams | None, scorer: _Scorer | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. What a text gets does not depend on the texts beside it."""
    n = len(texts)
    if not scorer or not n:
        return [UNKNOWN] * n, np.zeros(n)
    units = pc.split_pattern(pc.replace_substring(texts.fill_null("").cast(pa.large_string()), "\n", " "), " ")
    bounds = units.offsets.to_numpy()
    coded = pc.dictionary_encode(units.flatten())
    rows = scorer.look_up(coded.dictionary.to_pylist())
    order = coded.indices.to_numpy()
    # a text has one unit at least, so no sum is over nothing
    totals = np.stack([np.add.reduceat(column[order], bounds[:-1] - bounds[0]) for column in rows.T], axis=1)
    scores = np.exp(totals[:, :-1] - totals[:, :-1].max(axis=1, keepdims=True))
    scores /= scores.sum(axis=1, keepdims=True)
    top = scores.argmax(axis=1)
    known = totals[:, -1] > 0.5
    best = [model.languages[t] if k else UNKNOWN for t, k in zip(top.tolist(), known.tolist(), strict=True)]
    return best, np.where(known, scores[np.arange(n), top], 0.0)


def _predict(model: Unigrams | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model) if model else None
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                best, sure = _judge(model, scorer, batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(sure)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return predict


def verdict(model: Unigrams | None) -> Callable[[Column], Column]:
    """``text -> struct(lang_pred, score)`` as a column, judged like ``identify``.

    Only the texts go to Python; the other columns of a row stay where they are. The result is
    meant for a filter: used in several places it would be computed for each.
    """

    def judged(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(model) if model else None
        for column in columns:
            found = []
            for batch in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text", SLICE_BYTES):
                best, sure = _judge(model, scorer, batch.column("text"))
                arrays = [pa.array(best, pa.string()), pa.array(sure)]
                found.append(pa.StructArray.from_arrays(arrays, ["lang_pred", "score"]))
            yield pa.concat_arrays(found) if found else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    judged.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(judged, "lang_pred string, score double")


def identify(docs: DataFrame, model: Unigrams | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of every text: ``doc_id, held_out, lang_pred, score``.

    The score is the share of the predicted language in the probability of the text under all
    languages. Null texts and texts without a letter get ``und`` and 0, and so does every text if
    there was nothing to learn from. Equally likely languages: the first by name. One row per row
    of ``docs``, also for repeated rows and rows without id; nothing is shuffled.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        held_out(F.col(doc_id)).alias("held_out"),
        F.col(text).cast("string").alias("text"),
    )
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
