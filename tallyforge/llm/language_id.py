"""Language ID by prediction by partial matching (PPM).

For each language a variable-order context tree over bytes is counted on a bounded
sample of labelled texts and then frozen.  A text's code length under a language sums,
byte by byte, the cost of the longest context that predicts the byte, plus an escape
(method C) for each longer context that the language knows but that does not.  The
shortest code names the language.

The trees of all languages are laid out together: one table for each order, keyed by the
bytes of context and symbol, with one column of bits for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, crc_mod, drawn, in_small_batches, release_memory

#: Bytes of context.
ORDER = 3
#: Expected bytes of training text for each language; bounds the model, whatever the corpus.
TRAIN_BYTES = 2_000_000
#: Bytes of all languages together.
MOST_BYTES = 64_000_000
#: Bytes of a piece of text that is drawn for training, so that few long texts don't decide alone.
PIECE = 4096
#: Bytes scored at once; bounds memory alone.
BLOCK = 1_000_000
_PAD = b"\n" * ORDER


class ByteTable:
    """Rows of floats by 64-bit key, in a hash table that is read by whole arrays."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, "int32")
        self.keys, self.rows = keys, rows.astype("float32")
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several for one slot the last wins
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (len(self.slots) - 1)
        self.slot_keys = np.where(self.slots >= 0, self.keys[self.slots] if len(keys) else 0, np.uint64(1 << 63))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype("int64")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for those that aren't there."""
        at = self._slot(keys)
        out = np.where(self.slot_keys[at] == keys, self.slots[at], -1)
        look = np.flatnonzero((out < 0) & (self.slots[at] >= 0))
        while len(look):
            at[look] = (at[look] + 1) & (len(self.slots) - 1)
            hit = self.slot_keys[at[look]] == keys[look]
            out[look[hit]] = self.slots[at[look[hit]]]
            look = look[~hit & (self.slots[at[look]] >= 0)]
        return out


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes that end at each position from ``size`` - 1 on, as numbers."""
    out = data[: len(data) - size + 1].astype("uint64")
    for i in range(1, size):
        out = (out << np.uint64(8)) | data[i : len(data) - size + 1 + i]
    return out


class PpmModel:
    """Frozen trees; ``counts`` has lang, order, gram (bytes of context and symbol as a number), n."""

    def __init__(self, counts: pd.DataFrame, langs: list[str]):
        self.langs = langs
        column = {x: i for i, x in enumerate(langs)}
        self.grams: list[ByteTable] = []
        self.escapes: list[ByteTable] = []
        lower = None
        for order in range(ORDER + 1):
            own = counts[counts["order"] == order]
            keys, at = np.unique(own["gram"].to_numpy("uint64"), return_inverse=True)
            n = np.zeros((len(keys), len(langs)))
            n[at, own["lang"].map(column).to_numpy("int64")] = own["n"].to_numpy()
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                hit = -np.log2(n / (total + kinds)[of])
            if lower is None:
                below = np.full(n.shape, 8.0)
            else:
                below = lower[1][np.searchsorted(lower[0], keys & np.uint64((1 << 8 * order) - 1))]
            bits = np.where(n > 0, hit, escape[of] + below)
            self.grams.append(ByteTable(keys, bits))
            self.escapes.append(ByteTable(contexts, escape))
            lower = keys, bits

    def _bits(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte after the first ORDER of ``data``, by language."""
        keys = grams(data, ORDER + 1)
        found = self.grams[ORDER].find(keys)
        out = self.grams[ORDER].rows[np.maximum(found, 0)] if len(self.grams[ORDER].rows) else np.zeros((len(keys), len(self.langs)), "float32")
        rest = np.flatnonzero(found < 0)
        out[rest] = 0
        for order in range(ORDER, -1, -1):
            if not len(rest):
                break
            if order < ORDER:
                at = self.grams[order].find(keys[rest] & np.uint64((1 << 8 * (order + 1)) - 1))
                hit = at >= 0
                out[rest[hit]] += self.grams[order].rows[at[hit]]
                rest = rest[~hit]
            context = (keys[rest] >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
            at = self.escapes[order].find(context)
            known = at >= 0
            out[rest[known]] += self.escapes[order].rows[at[known]]
        out[rest] += 8
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language; long texts go piece by piece, context kept."""
        out = np.zeros((len(texts), len(self.langs)))
        block: list[bytes] = []
        owner: list[int] = []

        def flush() -> None:
            if not block:
                return
            bits = self._bits(np.frombuffer(b"".join(block), "uint8"))
            ends = np.cumsum([len(x) for x in block])
            for i, a, b in zip(owner, ends - [len(x) for x in block], ends - ORDER, strict=True):
                out[i] += bits[a:b].sum(axis=0, dtype="float64")
            block.clear()
            owner.clear()

        size = 0
        for i, text in enumerate(texts):
            whole = _PAD + text
            for a in range(0, len(text), BLOCK):
                block.append(whole[a : a + BLOCK + ORDER])
                owner.append(i)
                size += len(block[-1])
                if size >= BLOCK:
                    flush()
                    size = 0
        flush()
        return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, own in pdf.groupby("lang"):
            data = np.frombuffer(b"".join(_PAD + x for x in own["bytes"]), "uint8")
            symbol = np.ones(len(data), bool)  # not the padding
            starts = np.cumsum([0, *(len(x) + ORDER for x in own["bytes"])])[:-1]
            for i in range(ORDER):
                symbol[starts + i] = False
            full = grams(data, ORDER + 1)[symbol[ORDER:]]
            for order in range(ORDER + 1):
                gram, n = np.unique(full & np.uint64((1 << 8 * (order + 1)) - 1), return_counts=True)
                yield pd.DataFrame({"lang": lang, "order": order, "gram": gram.astype("int64"), "n": n})


def train(labelled: DataFrame, train_bytes: int = TRAIN_BYTES) -> PpmModel:
    """Trees from about ``train_bytes`` for each value of ``lang`` in (doc_id, text, lang), drawn as pieces of texts by the hash of doc_id and piece.

    However many values there are, MOST_BYTES are drawn in all, which bounds what reaches the driver.
    """
    rows = labelled.where(F.col("lang").isNotNull()).select("doc_id", "lang", bytes_of(F.col("text")).alias("bytes"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("bytes")).alias("n")).collect()}
    each = min(train_bytes, MOST_BYTES // max(1, len(sizes)))
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, each / max(n, 1))) for lang, n in sizes.items()], "lang string, share double")
    pieces = F.sequence(F.lit(0), F.floor((F.octet_length("bytes") - 1) / PIECE).cast("int"))
    chosen = F.filter(pieces, lambda k: drawn(F.col("share"), "doc_id", k))
    found = rows.where(F.octet_length("bytes") > 0).join(F.broadcast(shares), "lang").select("lang", "bytes", F.explode(chosen).alias("k"))
    counts = found.select("lang", F.substring("bytes", F.col("k") * PIECE + 1, F.lit(PIECE)).alias("bytes")).mapInPandas(_count, "lang string, order int, gram long, n long")
    summed = counts.groupBy("lang", "order", "gram").agg(F.sum("n").alias("n")).toPandas()
    return PpmModel(summed, sorted(summed["lang"].unique()))


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: PpmModel) -> DataFrame:
    """``docs`` (text and any others) with ``lang_pred`` and ``score`` in place of text; columns named like those are replaced.

    score is the posterior of the language under equal priors.  Null, empty and letterless
    texts are ``und`` with score 0, as are all if nothing was learned; ties go to the first
    language by name; repeated rows are predicted alike, ids may be null; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            at = np.flatnonzero(texts.notna())
            if own.langs and len(at):
                bits = own.code_lengths([x.encode() for x in texts.iloc[at]])
                pred[at] = np.array(own.langs, object)[bits.argmin(axis=1)]
                score[at] = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": pred, "score": score})
        release_memory()

    text = F.when(has_letters(docs["text"]), docs["text"])
    row = docs.select(F.struct(F.lit(1).alias("_"), *(docs[c] for c in kept)).alias("row"), text.alias("text"))
    out = row.select("row", predicted("text").alias("p"))
    return out.select(*(F.col("row")[c].alias(c) for c in kept), "p.lang_pred", "p.score")


@in_small_batches()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model)
