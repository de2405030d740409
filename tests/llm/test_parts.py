"""The algorithms inside the operators."""

from __future__ import annotations

import itertools
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crashgrid.llm.minhash import parity
from crashgrid.llm.packing import difference, windows
from crashgrid.llm.suffix_sort import common, deep_shallow_sort, reach
from crashgrid.llm.text import Words
from crashgrid.llm.token_files import WaveletMatrix
from crashgrid.llm.tokens import Encoder
from crashgrid.llm.unigrams import Unigrams

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


@pytest.fixture(scope="module", params=FILES, ids=[f[0] for f in FILES])
def encoder(request):
    return Encoder(public_tokenizers.path(request.param[0]), request.param[1])


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(" \n\t\0\x1c\xa0aBé'sll.,!12<|ßİ日")), max_size=5))
def test_encoding_by_pieces_is_encoding(encoder, texts):
    ids, starts = encoder.encode_column(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        assert ids[a:b].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.binary(max_size=90).map(lambda b: bytes(x % 2 for x in b)), max_size=40), st.sampled_from([0, 8, 64]))
def test_deep_shallow_sort(strings, shallow):
    assert [strings[i] for i in deep_shallow_sort(strings, shallow)] == sorted(strings)


@given(st.lists(st.tuples(*[st.binary(min_size=3, max_size=8).map(lambda b: bytes(x % 2 for x in b))] * 2), min_size=2, max_size=12), st.integers(4, 9))
def test_reach(places, length):
    lefts, rights = [p[0] for p in places], [p[1] for p in places]
    wanted = []
    for x, y in itertools.groupby(itertools.permutations(range(len(places)), 2), lambda p: p[0]):
        both = [(common(lefts[x], lefts[b]), common(rights[x], rights[b])) for _, b in y]
        both = [b for b in both if sum(b) >= length]
        wanted.append((max((b[0] for b in both), default=0), max((b[1] for b in both), default=0)))
    assert reach(lefts, rights, length) == wanted


@given(st.lists(st.integers(1, 256), min_size=1, max_size=120), st.integers(1, 9))
def test_differencing(sizes, parts):
    split = difference(sizes, parts)
    assert len(split) == parts and sorted(itertools.chain(*split)) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in part) for part in split]
    assert max(sums) - min(sums) <= max(sizes)
    assert all(sum(sizes[i] for i in w) <= 2048 for w in windows(sizes))


@given(st.lists(st.integers(0, 40), max_size=1500))
@settings(max_examples=40, deadline=None)
def test_wavelet_matrix(ids):
    data = np.array(ids, np.uint32)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.build(data, np.array([7]), np.array([len(ids)])).to_bytes())
    assert matrix.to_array().tolist() == ids and matrix.doc_ids.tolist() == [7]
    for at in range(0, len(ids), 97):
        assert matrix.access(at) == ids[at]
    for value in {*ids[:2], 41, 1 << 20}:
        assert matrix.count(value) == ids.count(value)
        assert matrix.rank(value, len(ids) // 2) == ids[: len(ids) // 2].count(value)
        assert matrix.occurrences(value)[:20] == [i for i, x in enumerate(ids) if x == value][:20]


def test_forward_sums_over_all_segmentations():
    model = Unigrams(["a", "b", "ab", "ba", "aba", "▁", "▁a"], ["x", "y"])
    model.fit(["▁abab", "▁ba"], np.array([[3.0, 1.0], [1.0, 5.0]]))
    rank = {h: i for i, h in enumerate(model.hashes.tolist())}

    def chance(word, language):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            _, codes = next(iter(__import__("crashgrid.llm.unigrams", fromlist=["by_length"]).by_length([word[:n]])))
            hashed = int(__import__("crashgrid.llm.unigrams", fromlist=["_prefixes"])._prefixes(codes)[0, -1])
            piece = rank.get(hashed, model.unknown if n == 1 else None)
            if piece is not None:
                total += model.p[piece, language] * chance(word[n:], language)
        return total

    for word in ["▁abba", "▁aqb", "ba" * 7, "▁" + "ab" * 20]:
        if len(word) < 16:
            assert model.score([word])[0] == pytest.approx([math.log(chance(word, i)) for i in range(2)])
        assert np.isfinite(model.score([word])).all()


@given(st.lists(st.text(st.sampled_from("ab \n\té")), max_size=6))
def test_words_of_a_batch(texts):
    words = Words(pa.array(texts, pa.string()))
    found = [words.data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
    wanted = [t.encode().split() for t in texts]
    assert found == list(itertools.chain(*wanted)) and np.diff(words.first).tolist() == [len(w) for w in wanted]
    by_hash = {}
    for word, h in zip(found, words.hash.tolist(), strict=True):
        assert by_hash.setdefault(word, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_parity_maps_differ_in_no_more_bits_than_sets_in_members(shared, one, two):
    a, b = shared | one, shared | two
    maps = [parity(np.array(sorted(s), np.uint64)) for s in (a, b)]
    assert int(np.bitwise_count((maps[0] ^ maps[1]).view(np.uint64)).sum()) <= len(a ^ b)


def test_bands_follow_the_similarity():
    from crashgrid.llm.minhash import VALUES, layout

    assert (layout(85), layout(80)) == ((7, 28), (6, 32))
    for percent in range(5, 100):
        rows, bands = layout(percent)
        assert rows * bands <= VALUES and rows * bands % 2 == 0
        assert (1 - (percent / 100) ** rows) ** bands <= 1 / 15_000
