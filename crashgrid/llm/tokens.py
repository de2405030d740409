"""Encode whole texts with a public tokenizer, word by word where that is the same.

Both vocabularies never merge across a change from other characters to a space or newline, so a
text can be cut there, and each distinct piece of a task's texts is encoded once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from tokenizers import Tokenizer

from crashgrid.llm.text import slices

# Letters that need neither normalising nor splitting, so that a word of them is one pre-token.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_LETTERS_THEN_MARK = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?])").fullmatch
_NO_CUT = re.compile(r"[^\S \n]|\0").search
_SPACE_RUN = re.compile(r"[ \n][ \n]|[ \n]\Z").search
_UNITS = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
_BYTE_LETTERS = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else "" for b in range(256)}
for _n, _b in enumerate(b for b in range(256) if not _BYTE_LETTERS[b]):
    _BYTE_LETTERS[_b] = chr(256 + _n)

# A mark after a letter begins a new pre-token in both vocabularies.
_MARK = "([A-Za-z])([.,;:!?])"

# What the cut at single spaces and newlines does not cover: runs, ends, any other white space, NUL.
_UNEVEN = (
    r"[ \n][ \n]|[ \n]\z|[\x00\t\r\v\f\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

MAX_CACHED = 400_000
SLICE_BYTES = 1 << 24


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    As a mapping it holds the ids of text pieces met so far; it forgets all of them when they
    become too many, which changes nothing but the speed.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        """``spaced``: the vocabulary attaches a space to the word after it; else it drops white
        space and lower-cases."""
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced = spaced

    def __missing__(self, unit: str) -> bytes:
        ids = self[unit] = self._spaced(unit) if self.spaced else self._word(unit)
        return ids

    def _letters(self, letters: str) -> bytes:
        if letters.isascii():
            mapped = letters
        else:
            mapped = "".join([_BYTE_LETTERS[b] for b in letters.encode()])
        return _packed([t.id for t in self.model.tokenize(mapped)])

    def _full(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, unit: str) -> bytes:
        if _LETTERS(unit):
            low = unit.lower()
            return self._letters(low) if low == unit else self[low]
        if marked := _LETTERS_THEN_MARK(unit):
            return self[marked[1]] + self[marked[2]]
        return self._full(unit) if unit else b""

    def _spaced(self, unit: str) -> bytes:
        """Unit keys: what follows a space; or starts with a newline; or, after NUL, with neither."""
        if unit[:1] == "\n":
            return self["\0\n"] + self["\0" + unit[1:]] if len(unit) > 1 else self._full("\n")
        if not unit or unit == "\0":
            return self._full(" ") if not unit else b""
        bare = unit[:1] == "\0"
        body = unit[1:] if bare else unit
        if _LETTERS(body):
            mapped = body if body.isascii() else "".join([_BYTE_LETTERS[b] for b in body.encode()])
            return _packed([t.id for t in self.model.tokenize(mapped if bare else _BYTE_LETTERS[32] + mapped)])
        if marked := _LETTERS_THEN_MARK(body):
            return self["\0" + marked[1] if bare else marked[1]] + self["\0" + marked[2]]
        return self._full(body if bare else " " + body)

    def encode(self, text: str) -> bytes:
        if not self.spaced:
            return b"".join([self[u] for u in text.replace("\n", " ").split(" ")])
        if _NO_CUT(text):
            return self._full(text)
        if _SPACE_RUN(text):
            return b"".join([self._run(u) for u in _UNITS(text)])
        if not text:
            return b""
        units = text.replace("\n", " \n").split(" ")
        units[0] = "\0" + units[0]
        return b"".join([self[u] for u in units])

    def _run(self, unit: str) -> bytes:
        """A run of spaces and newlines with the word after it."""
        if unit[0] == " " and unit[1:2] not in ("", " ", "\n"):
            return self[unit[1:]]
        if unit[0] not in " \n":
            return self["\0" + unit]
        key = "\0\0" + unit
        if key not in self:
            self[key] = self._full(unit)
        return self[key]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts in one flat array, and where each text's ids begin.

        The texts are cut and their distinct pieces found outside Python; only distinct pieces
        are looked up here. Null counts as empty.
        """
        if len(self) > MAX_CACHED:
            self.clear()
        texts = texts.fill_null("")
        if self.spaced:
            odd = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
            even = pc.if_else(pa.array(odd), "", texts)
            cut = pc.replace_substring_regex(even, _MARK, "\\1 \0\\2")
            cut = pc.replace_substring(pc.binary_join_element_wise("", cut, "\0"), "\n", " \n")
        else:
            odd = np.zeros(len(texts), bool)
            special = pc.match_substring(texts, "<|")  # names of special tokens are told by their case
            cut = pc.if_else(special, texts, pc.ascii_lower(texts))
            cut = pc.replace_substring(pc.replace_substring_regex(cut, _MARK, r"\1 \2"), "\n", " ")
        units = pc.split_pattern(cut.cast(pa.large_string()), " ")
        bounds = units.offsets.to_numpy()
        coded = pc.dictionary_encode(units.flatten())
        found = [self[u] for u in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        ids, counts = _gather(flat, sizes, coded.indices.to_numpy())
        starts = np.concatenate([[0], np.cumsum(counts)])[bounds - bounds[0]]
        if not odd.any():
            return ids, starts
        parts = [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for i in np.flatnonzero(odd):
            parts[i] = np.frombuffer(self.encode(texts[int(i)].as_py()), "<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def encoder_of(path: str, spaced: bool) -> Encoder:
    """The encoder of this worker process, with the pieces its earlier tasks met.

    This package travels with each task, so its own globals last for one task only; what is to
    last longer hangs on an installed module.
    """
    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if (path, spaced) not in kept:
        kept[path, spaced] = Encoder(path, spaced)
    return kept[path, spaced]


def _gather(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` (of the given sizes, one after the other) in the given order."""
    counts = sizes[order]
    ends = np.cumsum(counts)
    begins = np.cumsum(sizes) - sizes
    shift = np.repeat(begins[order] - (ends - counts), counts)
    return flat[shift + np.arange(len(shift))], counts


def encoded(
    batches: Iterator[pa.RecordBatch], encoder: Encoder, end: bytes, most: int = SLICE_BYTES
) -> Iterator[tuple[int | None, bytes]]:
    """Document id and ids, with the end id, of the ``doc_id, text`` rows of a task; ``most`` bytes of text at once."""
    for whole in batches:
        for batch in slices(whole, "text", most):
            ids, starts = encoder.encode_column(batch.column("text"))
            data = memoryview(ids.tobytes())
            docs = batch.column("doc_id").to_pylist()
            for doc, a, b in zip(docs, (4 * starts[:-1]).tolist(), (4 * starts[1:]).tolist(), strict=True):
                yield doc, bytes(data[a:b]) + end
