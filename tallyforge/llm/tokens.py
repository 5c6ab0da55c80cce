"""Token ids of whole texts, from a tokenizers file.

A tokenizer that never lets a token cross from a word into the white space after it
gives the same ids for a text as for its words one by one.  Words of plain letters,
digits and signs are cut into pre-tokens by arrays and merged many texts at once; the
library is asked for the others, whose ids each worker process keeps for a while.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Words in the cache above which those not used just now are dropped; bounds memory alone.
CACHE_WORDS = 150_000
#: White space to Python but not to the tokenizers' patterns: such texts are encoded whole.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: White space to both.
WHITE_SPACE = re.compile("[\t-\r ]")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class MergeRanks:
    """The merges of a tokenizers BPE file, by bytes, applied by tiktoken.

    An end-of-word suffix becomes a space, which no pre-token of such a tokenizer holds;
    joining it to a word's last byte comes before all merges.
    """

    END = b" "

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte, ids, ranks = alphabet(), model["vocab"], {}
        suffix = model.get("end_of_word_suffix") or ""
        self.ids: list[int] = []

        def add(token: str) -> None:
            end = bool(suffix) and token.endswith(suffix)
            key = bytes(byte[c] for c in (token[: -len(suffix)] if end else token)) + self.END * end
            if key not in ranks:
                ranks[key] = len(self.ids)
                self.ids.append(ids.get(token, -1))

        for c in byte:
            add(c)
        if suffix:
            for c in byte:
                add(c + suffix)
        for merge in model["merges"]:
            add("".join(merge.split(" ") if isinstance(merge, str) else merge))
        self.lookup = np.asarray(self.ids, dtype="<i8")
        self.ranks = ranks
        self.bpe = tiktoken.Encoding("file", pat_str="[^ ]+ " if suffix else PATTERN, mergeable_ranks=ranks, special_tokens={})

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return [self.ids[x] for x in self.bpe._encode_single_piece(piece)]

    def array(self, text: str) -> np.ndarray:
        """Ids of a text under the byte-level pre-tokenizer."""
        return self.lookup[self.bpe.encode_ordinary(text)]


# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def merge_ranks(path: str) -> MergeRanks:
    return MergeRanks(path)


@lru_cache(maxsize=1)
def alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class CachedEncoder:
    """Ids of texts as bytes.

    ``split`` cuts a text into words whose ids can be strung together; ``word`` gives a
    word's ids, or None to ask the library.
    """

    def __init__(self, path: str, split, word):
        self.path, self.split, self.word = path, split, word
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return packed(tokenizer(self.path).encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [None if ODD_SPACE.search(x) else self.split(x) for x in texts]
        used = set().union(*(x for x in words if x is not None))
        cache = self.cache
        for word in used.difference(cache):
            ids = self.word(word)
            cache[word] = self.whole(word) if ids is None else packed(ids)
        get = cache.__getitem__
        out = [self.whole(x) if own is None else b"".join(map(get, own)) for x, own in zip(texts, words, strict=True)]
        if len(cache) > CACHE_WORDS:
            self.cache = {x: cache[x] for x in used} if len(used) < CACHE_WORDS // 2 else {}
        return out


SPACE, LETTER, DIGIT, SIGN, ODD = range(5)


@lru_cache(maxsize=1)
def plain_characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each character of Latin-1, and one entry for all others."""
    kind, lower = np.full(257, ODD, "u1"), np.arange(257).astype("u1")
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[33:127] = SIGN
    kind[48:58] = DIGIT
    for first, last in ("az", "AZ", "ÀÖ", "Øö", "øÿ"):
        kind[ord(first) : ord(last) + 1] = LETTER
    for first, last in ("AZ", "ÀÖ", "ØÞ"):
        lower[ord(first) : ord(last) + 1] += 32
    return kind, lower


class StreamEncoder:
    """Ids of many texts in one array, each text ended by ``end_id``, under the lower-casing word tokenizer.

    Words of ASCII and of Latin-1's letters are cut where letters, digits and signs meet,
    and go through :class:`MergeRanks` in one string.  Words with other characters, of more
    than LONG characters, with an apostrophe that may begin a contraction or with what may
    be a special token go to ``others``, by word.
    """

    LONG = 1000
    #: Control characters, which plain words don't hold: where another word stands, and where a text ends.
    HOLE, STOP = 1, 2

    def __init__(self, path: str, others: CachedEncoder, end_id: int, most: int):
        self.ranks, self.others, self.end_id, self.most = merge_ranks(path), others, end_id, most
        if min(self.ranks.ids) < 0:
            raise ValueError(f"{path} lacks ids of single bytes")
        self.ids = self.ranks.lookup.astype("<u4")
        self.hole, self.stop = (self.ranks.ranks[bytes([x]) + self.ranks.END] for x in (self.HOLE, self.STOP))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's end."""
        parts, last = [], []
        for x in texts:
            for a, b in self._cuts(x):
                parts.append(x[a:b])
                last.append(b == len(x))
        ids, ends, n = [], [], 0
        for a, b in slices(parts, self.most):
            own, at = self._encode(parts[a:b], np.array(last[a:b]))
            ids.append(own)
            ends.append(at + n)
            n += len(own)
        return np.concatenate(ids or [np.zeros(0, "<u4")]), np.concatenate(ends or [np.zeros(0, "i8")])

    def _cuts(self, text: str) -> Iterator[tuple[int, int]]:
        """Parts of about ``most`` characters that end at white space; bounds memory alone."""
        a = 0
        while len(text) - a > self.most and (m := WHITE_SPACE.search(text, a + self.most)):
            if m.end() == len(text):
                break
            yield a, m.end()
            a = m.end()
        yield a, len(text)

    def _encode(self, parts: list[str], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = "\n".join([*parts, ""])
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 256).astype("u2")
        kinds, lower = plain_characters()
        kind, out = kinds[codes], lower[codes]
        kept = kind != SPACE
        edges = np.flatnonzero(np.diff(kept, prepend=False))  # no word at the end, which is a line feed
        first, after = edges[::2], edges[1::2]
        odd = kind == ODD
        quoted = np.flatnonzero(out == ord("'"))
        odd[quoted[np.isin(out[quoted + 1], np.frombuffer(b"strvmld", "u1"))]] = True
        special = np.flatnonzero(out == ord("<"))
        odd[special[out[special + 1] == ord("|")]] = True
        of = np.concatenate([np.searchsorted(first, np.flatnonzero(odd), side="right") - 1, np.flatnonzero(after - first > self.LONG)])
        others = np.unique(of)
        inside = np.zeros(len(out), "i1")
        inside[first[others]], inside[after[others]] = 1, -1
        kept &= np.cumsum(inside, dtype="i1") == 0
        closes = kept & ((kind != np.append(kind[1:], SPACE)) | (kind == DIGIT))
        stops = np.cumsum([len(x) + 1 for x in parts]) - 1
        for at, mark in ((first[others], self.HOLE), (stops, self.STOP)):
            out[at], kept[at], closes[at] = mark, True, True
        width = kept.astype("u1") + closes
        places = np.cumsum(width, dtype="i8")
        stream = np.full(places[-1], ord(" "), "u1")
        stream[(places - width)[kept]] = out[kept]
        tokens = self.ranks.bpe.encode_to_numpy(stream.tobytes().decode("latin-1"), disallowed_special=())
        holes, stops = np.flatnonzero(tokens == self.hole), np.flatnonzero(tokens == self.stop)
        ids = self.ids[tokens]
        ids[stops] = self.end_id
        fills = self.others.encode([text[a:b] for a, b in zip(first[others].tolist(), after[others].tolist(), strict=True)]) if len(others) else []
        sizes = np.ones(len(tokens), "i8")
        sizes[holes] = [len(x) // 4 for x in fills]
        sizes[stops[~last]] = 0
        ends = np.cumsum(sizes)[stops][last]
        if len(ends) < len(stops) or fills:
            plain = np.repeat(tokens != self.hole, sizes)
            ids = np.repeat(ids, sizes)
            ids[~plain] = np.frombuffer(b"".join(fills), "<u4")
        return ids, ends


def slices(texts: list[str], most: int = 4_000_000):
    """Index ranges of ``texts`` of about ``most`` characters each, one text at least."""
    a = size = 0
    for b, x in enumerate(texts):
        if size and size + len(x) > most:
            yield a, b
            a, size = b, 0
        size += len(x)
    if a < len(texts):
        yield a, len(texts)
