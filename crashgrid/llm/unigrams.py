"""Unigram pieces over a fixed vocabulary, summed over all segmentations of a word."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20

START = "▁"  # what the vocabulary writes before a word
LONGEST_WORD = 64  # longer runs of letters are scored in parts of this length
RENEW = 16  # positions between renormalisations


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _MULTIPLY)]))


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of each row of code points."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _MULTIPLY + codes[:, j] + np.uint64(1)
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _FILTER_BITS)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and code points of the words, for each length."""
    groups = defaultdict(list)
    for i, word in enumerate(words):
        groups[len(word)].append(i)
    for length, members in groups.items():
        flat = np.frombuffer("".join([words[i] for i in members]).encode("utf-32-le"), "<u4")
        yield np.array(members), flat.reshape(len(members), length).astype(np.uint64)


class Unigrams:
    """Piece probabilities per language. The last row of ``p`` is for characters without piece."""

    def __init__(self, pieces: list[str], languages: list[str]) -> None:
        pieces = sorted(set(pieces))
        self.languages, self.longest = languages, max(map(len, pieces))
        hashes = np.zeros(len(pieces), np.uint64)
        for members, codes in by_length(pieces):
            hashes[members] = _prefixes(codes)[:, -1]
        order = np.argsort(hashes)
        self.hashes, self.unknown = hashes[order], len(pieces)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[_slot(self.hashes)] = True
        self.p = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))

    def edges(self, codes: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """For each end position: start positions, rows and pieces of the strings that end there."""
        prefix, power = _prefixes(codes), _powers(codes.shape[1])
        rows = np.arange(len(codes))
        for j in range(1, codes.shape[1] + 1):
            found = []
            for i in range(max(0, j - self.longest), j):
                hashes = prefix[:, j] - prefix[:, i] * power[j - i]
                at = rows[self.filter[_slot(hashes)]]
                ids = np.searchsorted(self.hashes, hashes[at])
                good = self.hashes[np.minimum(ids, len(self.hashes) - 1)] == hashes[at]
                at, ids = at[good], ids[good]
                if i == j - 1:  # a character without piece stands for itself
                    every = np.full(len(codes), self.unknown)
                    every[at] = ids
                    at, ids = rows, every
                if len(at):
                    found.append((i, at, ids))
            yield j, found

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language: forward sums over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        for members, codes in by_length(words):
            n = codes.shape[1]
            alpha = np.zeros((n + 1, len(codes), len(self.languages)))
            alpha[0] = 1.0
            scale = np.zeros((len(codes), len(self.languages)))
            for j, found in self.edges(codes):
                for i, at, ids in found:
                    if len(at) == len(codes):
                        alpha[j] += alpha[i] * self.p[ids]
                    else:
                        alpha[j, at] += alpha[i, at] * self.p[ids]
                if j % RENEW == 0 and j < n:
                    low = max(0, j + 1 - self.longest)
                    top = alpha[j].copy()
                    alpha[low : j + 1] /= top
                    scale += np.log(top)
            out[members] = np.log(alpha[n]) + scale
        return out

    def fit(self, words: list[str], counts: np.ndarray, rounds: int = 3, smooth: float = 0.05) -> None:
        """Expectation maximisation. ``counts`` has a row per word and a column per language.

        Every piece keeps a small share in every language, so that no text is impossible.
        """
        short = [w[:LONGEST_WORD] for w in words]
        for _ in range(rounds):
            expected = np.full_like(self.p, smooth)
            for members, codes in by_length(short):
                for low in range(0, len(members), 20_000):
                    part = slice(low, low + 20_000)
                    self._expect(codes[part], counts[members[part]], expected)
            self.p = expected / expected.sum(axis=0)

    def _expect(self, codes: np.ndarray, counts: np.ndarray, expected: np.ndarray) -> None:
        n, width = codes.shape[1], len(self.languages)
        lattice = list(self.edges(codes))
        alpha = np.zeros((n + 1, len(codes), width))
        beta = np.zeros_like(alpha)
        alpha[0], beta[n] = 1.0, 1.0
        for j, found in lattice:
            for i, at, ids in found:
                alpha[j, at] += alpha[i, at] * self.p[ids]
        for j, found in reversed(lattice):
            for i, at, ids in found:
                beta[i, at] += beta[j, at] * self.p[ids]
        weight = counts / np.maximum(alpha[n], 1e-300)
        for j, found in lattice:
            for i, at, ids in found:
                share = alpha[i, at] * self.p[ids] * beta[j, at] * weight[at]
                for language in range(width):
                    expected[:, language] += np.bincount(ids, share[:, language], len(expected))
