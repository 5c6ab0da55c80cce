"""Byte-level BPE encoding and decoding of whole texts by tree concatenation.

A text is halved, wherever that is, until its parts are leaves of LEAF bytes, and the leaves
are encoded apart.  Then neighbours are joined: a window around the join is encoded anew and
grows until its first and last tokens are those that the two sides have there, which are
kept outside the window.  Texts over PARALLEL bytes are halved into rows of their own, which
tasks encode in parallel before the last joins.

Where a window may end: between a word or sign and the white space after it, which the
pre-tokenizer never joins, so that a window is read there as the whole text is.  Stretches
over LONG_WORD characters without such a place are one word to the pre-tokenizer or nearly
so, and are halved and joined token by token (:class:`TreeBpe`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_small_batches, release_memory
from .tokens import alphabet, merge_ranks, slices, tokenizer

#: Bytes of a part that is encoded in one go.
LEAF = 2048
#: Bytes to each side of a join that a window begins with.
WINDOW = 48
#: Characters of a word that is halved and joined by itself.
LONG_WORD = 2048
#: Bytes of a text whose halves are rows of their own, and of such a row.
PARALLEL = 32_768
#: A place where a window may end lies between these two.
_EDGE = re.compile(rb"(?<=[!-~])(?=[ \n])")
_LONG = re.compile(r"[\S\x1c-\x1f]{%d,}" % (LONG_WORD + 1))

Encoded = tuple[np.ndarray, np.ndarray]


class TreeText:
    """Ids of a text, and where in it each ends in bytes, by halves; ``encode`` gives a short text's ids, ``sizes`` their bytes."""

    def __init__(self, encode: Callable[[bytes], np.ndarray], sizes: np.ndarray, leaf: int = LEAF, window: int = WINDOW):
        self.plain, self.sizes, self.leaf, self.window = encode, sizes, leaf, window
        self.joins = 0

    def _encoded(self, data: bytes, lo: int, hi: int) -> Encoded:
        ids = self.plain(data[lo:hi])
        return ids, lo + np.cumsum(self.sizes[ids])

    def encode(self, data: bytes, lo: int = 0, hi: int | None = None) -> Encoded:
        hi = len(data) if hi is None else hi
        middle = (lo + hi) // 2
        while middle < hi and data[middle] & 0xC0 == 0x80:  # a character stays whole
            middle += 1
        if hi - lo <= self.leaf or middle == hi:
            return self._encoded(data, lo, hi)
        return self.join(data, lo, middle, hi, self.encode(data, lo, middle), self.encode(data, middle, hi))

    def join(self, data: bytes, lo: int, middle: int, hi: int, left: Encoded, right: Encoded) -> Encoded:
        """The whole of ``data[lo:hi]`` from its halves, of which ``middle`` parts the ends."""
        self.joins += 1
        reach = self.window
        while True:
            start, stop = max(lo, middle - reach), min(hi, middle + reach)
            if start > lo:
                found = _EDGE.search(data, start, middle)
                start = found.start() if found else middle
            if stop < hi:
                edges = [m.start() for m in _EDGE.finditer(data, middle + 1, stop + 1)]
                stop = edges[-1] if edges else middle
            if (start < middle or start == lo) and (stop > middle or stop == hi):
                ids, ends = self._encoded(data, start, stop)
                i, j = np.searchsorted(left[1], start, side="right"), np.searchsorted(right[1], stop, side="right")
                agree = len(ids) and (start == lo or ids[0] == left[0][i]) and (stop == hi or ids[-1] == right[0][j - 1])
                if agree or (start == lo and stop == hi):
                    return np.concatenate([left[0][:i], ids, right[0][j:]]), np.concatenate([left[1][:i], ends, right[1][j:]])
            reach *= 2


class TreeBpe:
    """BPE of long words: halves are encoded apart and mended around their join.

    The window around a join is encoded anew and grows until its first and last tokens
    are the ones that the halves have there.  Each adjacent pair of tokens of the result
    then also occurs so in a BPE encoding, which makes the whole the BPE encoding.
    """

    def __init__(self, bpe, leaf: int = LEAF):
        self.bpe, self.leaf = bpe, leaf

    def encode(self, word: str) -> list[tuple[int, str]]:
        """Ids and the characters that each stands for."""
        if len(word) <= self.leaf:
            return self.bpe(word)
        middle = len(word) // 2
        return self.join(self.encode(word[:middle]), self.encode(word[middle:]))

    def join(self, a: list[tuple[int, str]], b: list[tuple[int, str]], window: int = 4) -> list[tuple[int, str]]:
        while True:
            left, right = max(len(a) - window, 0), min(window, len(b))
            again = self.bpe("".join(x for _, x in a[left:]) + "".join(x for _, x in b[:right]))
            if (left == 0 or again[0] == a[left]) and (right == len(b) or again[-1] == b[right - 1]):
                return a[:left] + again + b[right:]
            window *= 2


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    library, byte = tokenizer(path), alphabet()
    table = [b""] * library.get_vocab_size(with_added_tokens=True)
    for token, i in library.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return table


def encode_long_word(path: str, word: str, leaf: int = LEAF) -> list[int]:
    """Ids of a text without inner white space, however long."""
    library = tokenizer(path)
    tree = TreeBpe(lambda x: [(t.id, t.value) for t in library.model.tokenize(x)], leaf)
    added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    ids: list[int] = []
    for part in re.split("(" + "|".join(map(re.escape, added)) + ")", word) if added else [word]:
        if part in added:
            ids.append(added[part])
        elif part:
            for piece, _ in library.pre_tokenizer.pre_tokenize_str(part):
                ids += [i for i, _ in tree.encode(piece)]
    return ids


class TreeEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        self.path, self.ranks = path, merge_ranks(path)
        self.added = {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.tree = TreeText(self._plain, np.array([len(x) for x in token_bytes(path)]), leaf, window)

    def _plain(self, data: bytes) -> np.ndarray:
        return self.ranks.array(data.decode())

    def segments(self, text: str) -> list[str]:
        """Added tokens, long words and what lies between; each is encoded by itself."""
        out = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.added:
                out.append(part)
                continue
            at = 0
            for m in _LONG.finditer(part):
                start = m.start()
                while start > at and part[start - 1].isspace():  # white space is read with the word after it
                    start -= 1
                out += [part[at:start], part[start : m.end()]]
                at = m.end()
            out.append(part[at:])
        return [x for x in out if x]

    def encode(self, text: str) -> bytes:
        ids = []
        for part in self.segments(text):
            if part in self.added:
                ids.append(np.array([self.added[part]]))
            elif _LONG.search(part):
                ids.append(np.array(encode_long_word(self.path, part), dtype="i8"))
            else:
                ids.append(self.tree.encode(part.encode())[0])
        return np.concatenate([np.zeros(0, "i8"), *ids]).astype("<u4").tobytes()

    def encode_part(self, data: bytes) -> bytes:
        return self.tree.encode(data)[0].astype("<u4").tobytes()

    def join_parts(self, parts: list[tuple[bytes, bytes]]) -> bytes:
        """Ids of a text from its consecutive parts (bytes, ids), joined as neighbours."""
        data = b"".join(x for x, _ in parts)
        at, done = 0, []
        for own, ids in parts:
            ids = np.frombuffer(ids, "<u4").astype("i8")
            done.append((at, at + len(own), (ids, at + np.cumsum(self.tree.sizes[ids]))))
            at += len(own)
        while len(done) > 1:
            halves = [(a[0], b[1], self.tree.join(data, a[0], a[1], b[1], a[2], b[2])) for a, b in zip(done[::2], done[1::2], strict=False)]
            done = halves + done[len(done) // 2 * 2 :]
        return done[0][2][0].astype("<u4").tobytes()


def decode(path: str, ids: bytes) -> str:
    """Text of little-endian 32-bit ids; special tokens are written out, broken UTF-8 is replaced."""
    table = token_bytes(path)
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _ids(docs: DataFrame, path: str, made: Callable[[list[bytes]], dict[str, list]], schema: str) -> DataFrame:
    """doc_id and what ``made`` makes of the ids of each row's text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    added = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    whole = F.octet_length("text") <= PARALLEL
    for x in [F.col("text").rlike(_LONG.pattern), *(F.contains(F.col("text"), F.lit(x)) for x in added)]:
        whole |= x  # texts of several segments are worked on in one task

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = TreeEncoder(path)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slices(texts):
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].array, **made([own.encode(x) for x in texts[a:b]])})
        release_memory()

    def halved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def halves(data: bytes) -> list[bytes]:
            middle = len(data) // 2
            while data[middle : middle + 1] and data[middle] & 0xC0 == 0x80:
                middle += 1
            return [data] if len(data) <= PARALLEL else halves(data[:middle]) + halves(data[middle:])

        for pdf in batches:
            for doc_id, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"], strict=True):
                own = halves(text.encode())
                yield pd.DataFrame({"doc_id": doc_id, "row": row, "part": range(len(own)), "data": own})

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = TreeEncoder(path)
        for pdf in batches:
            yield pdf.assign(ids=[own.encode_part(x) for x in pdf["data"]])
        release_memory()

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        own, pdf = joiner(path), pdf.sort_values("part")
        ids = own.join_parts(list(zip(pdf["data"], pdf["ids"], strict=True)))
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1].array, **made([ids])})

    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema, part = f"doc_id string, {schema}", "doc_id string, row string, part int, data binary"
    large = cut(rows.where(~whole).withColumn("row", F.expr("uuid()")).mapInPandas(halved, part), "halves")
    parts = large.repartition("row", "part").mapInPandas(encoded, f"{part}, ids binary")
    out = rows.where(whole).mapInPandas(run, schema).unionByName(parts.groupBy("row").applyInPandas(joined, schema))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


@lru_cache(maxsize=1)
def joiner(path: str) -> TreeEncoder:
    return TreeEncoder(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` of each row's whole text.

    Null text counts as empty, which has no ids; rows are independent, so repeated rows
    and null or repeated doc_ids are kept as they are; extra columns are ignored; an empty
    table gives an empty result.
    """
    return _ids(docs, path, lambda ids: {"ids": ids, "decoded": [decode(path, x) for x in ids]}, "ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of :func:`encode_decode`, digested where they are made."""

    def made(ids: list[bytes]) -> dict[str, list]:
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(decode(path, x).encode()).hexdigest() for x in ids],
        }

    return _ids(docs, path, made, "n_tokens long, ids_sha256 string, decoded_sha256 string")


@in_small_batches()
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
