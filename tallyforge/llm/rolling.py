"""Hashes of any stretch of a byte array, from prefix sums, and the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: ASCII white space, which ends words.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_OF_BYTE = [mix(np.arange(1, 257, dtype="u8") * np.uint64(m)) for m in _MULTIPLIERS]
#: Powers of each multiplier and of its inverse, as far as any block of this task needed them; longer arrays are made anew.
_POWERS = [[np.ones(1, "u8"), np.ones(1, "u8")] for _ in _MULTIPLIERS]
_MOST_POWERS = 2_100_000


def _powers(n: int, which: int) -> list[np.ndarray]:
    """The first ``n`` powers of a multiplier and of its inverse."""
    kept = _POWERS[which]
    if len(kept[0]) < n:
        grown = []
        for base in (_MULTIPLIERS[which], pow(_MULTIPLIERS[which], -1, 1 << 64)):
            steps = np.full(n, base, "u8")
            steps[0] = 1
            grown.append(np.multiply.accumulate(steps))
        if n > _MOST_POWERS:
            return grown
        _POWERS[which] = kept = grown
    return [x[:n] for x in kept]


def forget_powers() -> None:
    """Drop the powers that are kept (up to 67 MB a process); the next block makes them anew in milliseconds."""
    _POWERS[:] = [[np.ones(1, "u8"), np.ones(1, "u8")] for _ in _MULTIPLIERS]


class PrefixHash:
    """64-bit hash of ``data[a:b]`` for any arrays of a and b, alike wherever the bytes stand; ``which`` of two that are unrelated."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _powers(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, "u8")
        np.cumsum(_OF_BYTE[which][data] * up[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a])

    def each(self, size: int) -> np.ndarray:
        """Hashes of all stretches of ``size`` bytes, by their start."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, "u8")


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, in order, and how many words each text has."""
    data = np.frombuffer(b"\n".join([*texts, b""]), "u1")
    ends_of = np.cumsum([len(x) + 1 for x in texts])
    edges = np.flatnonzero(np.diff(np.concatenate([[True], WHITE[data], [True]])))
    starts, ends = edges[::2], edges[1::2]
    upto = np.searchsorted(starts, ends_of)
    return PrefixHash(data).of(starts, ends), np.diff(np.concatenate([[0], upto]))


def blocks(texts: list[bytes], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``most`` bytes each, one text at least; bounds memory alone."""
    a = size = 0
    for b, x in enumerate(texts):
        if size and size + len(x) > most:
            yield a, b
            a, size = b, 0
        size += len(x)
    if a < len(texts):
        yield a, len(texts)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as Spark's long."""
    return x.astype("u8").view("i8")
