"""Repeats within one shard of text, from a run-length index.

The index keeps, of the shard's Burrows-Wheeler transform, the ends of its runs: for each
first position of a run the text position and how long it matches the suffix sorted before
it, for each last position the same towards the suffix sorted after it.  Those samples
suffice: within a run a match shrinks by one from each text position to the next.  Matching
statistics are then streamed over the text from sample to sample.
"""

from __future__ import annotations

import numpy as np

#: Symbols of 9 bits in a word: a byte plus one; 0 parts the texts.
_PACKED = 7


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each followed by a 0, and the texts' starts."""
    sizes = np.array([len(x) + 1 for x in texts])
    starts = np.cumsum(sizes) - sizes
    symbols = np.zeros(int(sizes.sum()), "i8")
    inside = np.ones(len(symbols), bool)
    inside[starts + sizes - 1] = False
    symbols[inside] = np.frombuffer(b"".join(texts), "u1").astype("i8") + 1
    return symbols, starts


def _words(symbols: np.ndarray) -> np.ndarray:
    padded = np.concatenate([symbols, np.zeros(_PACKED, "i8")])
    out = np.zeros(len(symbols), "i8")
    for i in range(_PACKED):
        out = (out << 9) | padded[i : i + len(symbols)]
    return out


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order, by doubling the sorted length until none tie."""
    n, length, key = len(words), _PACKED, words
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.concatenate([[False], sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(n, "i8")
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1 or length >= n:
            return order
        after = np.zeros(n, "i8")
        after[: n - length] = rank[length:] + 1
        key = rank * (n + 1) + after
        length *= 2


def _matches(symbols: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at i and j share."""
    n = len(symbols)
    out, todo = np.zeros(len(i), "i8"), np.arange(len(i))
    while len(todo):  # whole words
        a, b = i[todo] + out[todo], j[todo] + out[todo]
        inside = (a < n) & (b < n)
        todo, a, b = todo[inside], a[inside], b[inside]
        todo = todo[words[a] == words[b]]
        out[todo] += _PACKED
    todo = np.arange(len(i))
    for _ in range(_PACKED):  # and the symbols of the word that differs
        a, b = i[todo] + out[todo], j[todo] + out[todo]
        inside = (a < n) & (b < n)
        todo, a, b = todo[inside], a[inside], b[inside]
        todo = todo[symbols[a] == symbols[b]]
        out[todo] += 1
    return out


class RunIndex:
    """Sampled run ends of the texts' Burrows-Wheeler transform."""

    def __init__(self, texts: list[bytes]):
        symbols, self.starts = _symbols(texts)
        self.size = len(symbols)
        words = _words(symbols)
        order = suffix_order(words)
        last = np.where(order > 0, symbols[order - 1], -1)
        change = np.flatnonzero(last[1:] != last[:-1]) + 1
        heads, tails = change, change - 1
        self.runs = len(change) + 1
        first, final = order[:1], order[-1:]  # no suffix before the first or after the last
        shared = _matches(symbols, words, order[heads], order[heads - 1])
        self.before = np.concatenate([order[heads], first]), np.concatenate([shared, [0]])
        self.after = np.concatenate([order[tails], final]), np.concatenate([_matches(symbols, words, order[tails], order[tails + 1]), [0]])

    def statistics(self) -> np.ndarray:
        """For each position the longest match that also starts at another position."""
        out = np.zeros(self.size, "i8")
        for at, shared in (self.before, self.after):
            sample = np.full(self.size, -1, "i8")
            sample[at] = shared
            source = np.maximum.accumulate(np.where(sample >= 0, np.arange(self.size), -1))
            held = np.where(source >= 0, sample[np.maximum(source, 0)] - (np.arange(self.size) - source), 0)
            out = np.maximum(out, held)
        return out


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` bytes stand anywhere else among the texts."""
    if not texts:
        return []
    index = RunIndex(texts)
    long = index.statistics() >= length
    return [long[a : a + max(0, len(x) - length + 1)] for a, x in zip(index.starts, texts, strict=True)]
