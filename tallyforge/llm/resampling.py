"""Importance resampling towards a target's distribution of hashed n-grams.

Features are runs of one to three words, each hashed into a bucket.  A document's weight
adds up, over its features, how much likelier their buckets are in the target than in the
corpus; with Gumbel noise on top, the highest scores are a draw without replacement.

Texts are worked on a block at a time.  A block's words become ids, its suffixes are sorted
by as many words as the longest feature has, and the common prefixes of neighbours (LCP)
show which suffixes begin with the same n-gram: such a run is hashed once, from the CRCs of
its words, and the bucket is scattered back to where the run's suffixes stand.  One pass adds up
counts by bucket in each task, a second one scores.  Only the gains (one number a bucket)
reach the driver; ranks come from a range partitioning of the scores.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release_memory, table

BUCKETS = 10_000
LONGEST = 3
SEED = 42
#: Percent of the eligible documents that are drawn, and the words that make one eligible.
PERCENT, LEAST_WORDS = 5, 20
#: Bytes of text whose words are taken apart at once, and words whose suffixes are sorted together (ids must fit 21 bits); bound memory alone.
PIECE_BYTES, BLOCK_WORDS = 2_000_000, 400_000

#: Lower-cases A-Z and blanks what is no word: ASCII but letters and digits.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> Iterator[list[bytes]]:
    """The words of a text, about PIECE_BYTES of them at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES) if at + PIECE_BYTES < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


@lru_cache(maxsize=8192)
def _advance(n: int) -> np.ndarray:
    """What ``n`` more zero bytes make of each bit of a CRC-32."""
    if n == 1:
        byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], "u4")
        bits = np.uint32(1) << np.arange(32, dtype="u4")
        return (bits >> np.uint32(8)) ^ byte[bits & np.uint32(255)]
    half = _advance(n // 2)
    out = _applied(half, half)
    return _applied(_advance(1), out) if n % 2 else out


def _applied(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@lru_cache(maxsize=4096)
def _by_byte(n: int) -> np.ndarray:
    """The same by byte of the CRC: 4 x 256."""
    return np.stack([_applied(_advance(n), np.arange(256, dtype="u4") << np.uint32(8 * k)) for k in range(4)])


class Block:
    """Buckets of all n-grams in sequences of words, the first ``old`` of which (at most two) only lead into the rest."""

    def __init__(self, sequences: list[tuple[int, list[bytes]]], buckets: int = BUCKETS):
        ids: dict[bytes, int] = {}
        at: list[int] = []
        new: list[bool] = []
        self.starts = []
        for old, own in sequences:
            self.starts.append(len(at))
            at += [ids.setdefault(w, len(ids) + 1) for w in own]
            new += [False] * old + [True] * (len(own) - old)
            at.append(0)
            new.append(False)
        w = np.array(at + [0] * LONGEST, "i8")
        is_new = np.array(new + [False] * LONGEST)
        n = len(at)
        follow = [w[k : n + k] for k in range(LONGEST)]
        # suffixes in order of their first three words
        key = (follow[0].astype("u8") << np.uint64(42)) | (follow[1].astype("u8") << np.uint64(21)) | follow[2].astype("u8")
        order = np.argsort(key)
        ordered = key[order]
        crc = np.array([0, *(zlib.crc32(x) for x in ids)], "u4")
        after = np.array([0, *(zlib.crc32(b" " + x) for x in ids)], "u4")  # of a word that follows another
        sizes = np.array([1, *(len(x) + 1 for x in ids)])
        kinds, kind = np.unique(sizes, return_inverse=True)
        shift = np.stack([_by_byte(int(x)) for x in kinds]).reshape(-1)
        kind *= 1024
        self.buckets, self.valid = [], []
        value = crc[follow[0]][order]
        whole = np.ones(n, bool)
        for k in range(LONGEST):
            prefix = ordered >> np.uint64(21 * (LONGEST - 1 - k))
            heads = np.concatenate([[True], prefix[1:] != prefix[:-1]])  # LCP of at most k: another run of k + 1 words
            run = np.cumsum(heads) - 1
            first = np.flatnonzero(heads)
            if k == 0:
                of_run = value[first]
            else:  # the run's n-gram is one word longer than what the run above it was hashed to
                word, before = follow[k][order[first]], value[first]
                base = kind[word]
                of_run = after[word]
                for byte in range(4):
                    of_run = of_run ^ shift[base + byte * 256 + (before >> np.uint32(8 * byte) & np.uint32(255)).astype("i8")]
            value = of_run[run]
            scattered = np.empty(n, "i4")
            scattered[order] = (of_run % np.uint32(buckets)).astype("i4")[run]
            whole &= follow[k] > 0
            self.buckets.append(scattered)
            self.valid.append(whole & is_new[k : n + k])

    def counts(self, buckets: int) -> np.ndarray:
        return sum(np.bincount(b[v], minlength=buckets) for b, v in zip(self.buckets, self.valid, strict=True))

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Gains of each sequence's n-grams, added up."""
        each = sum(np.where(v, gains[b], 0) for b, v in zip(self.buckets, self.valid, strict=True))
        return np.add.reduceat(each, self.starts)


def blocks(texts: list[str | None], buckets: int) -> Iterator[tuple[list[int], list[int], Block]]:
    """Block by block: of which text each sequence is, its new words, and the block."""
    of, new, sequences, size = [], [], [], 0
    for i, text in enumerate(texts):
        before: list[bytes] = []
        for own in words(text or ""):
            for a in range(0, len(own), BLOCK_WORDS):
                part = own[a : a + BLOCK_WORDS]
                of.append(i)
                new.append(len(part))
                sequences.append((len(before), before + part))
                before = (before + part)[1 - LONGEST :]
                size += len(part)
                if size >= BLOCK_WORDS:
                    yield of, new, Block(sequences, buckets)
                    of, new, sequences, size = [], [], [], 0
    if sequences:
        yield of, new, Block(sequences, buckets)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``, its features in the column ``text`` of all rows; buckets without features are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, "i8")
        for pdf in batches:
            for _, _, block in blocks(pdf["text"].tolist(), buckets):
                total += block.counts(buckets)
        release_memory()
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found.astype("i4"), "n": total[found]})

    return texts.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in target and corpus, rounded down."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = ((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], "i8")


def learned(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gains by bucket from all texts of both; at most ``buckets`` counts of each reach the driver."""
    corpus, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(x, buckets).collect()} for x in (docs, target))
    return bucket_gains(corpus, wanted, buckets)


def weighed(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """``docs`` and, as ``_weighed``, their words, features, weight and score; texts are read whole, null counts as no words."""
    buckets = len(gains)

    @F.pandas_udf("words long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, weight = np.zeros(len(texts), "i8"), np.zeros(len(texts), "i8")
            for of, new, block in blocks(texts.tolist(), buckets):
                np.add.at(n, of, new)
                np.add.at(weight, of, block.sums(gains))
            yield pd.DataFrame({"words": n, "weight": weight})
        release_memory()

    @F.pandas_udf("long")
    def noise(ids: pd.Series) -> pd.Series:
        drawn = (int(hashlib.sha256(f"{seed}:{x}".encode()).hexdigest()[:8], 16) for x in ids)
        return pd.Series([math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in drawn], dtype="i8")

    found = docs.withColumn("_found", weigh(docs["text"])).withColumn("_noise", noise(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))))
    n = F.col("_found.words")
    features = n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))
    fields = F.struct(n.alias("words"), features.alias("n_features"), F.col("_found.weight").alias("weight"), (F.col("_found.weight") + F.col("_noise")).alias("score"))
    return found.select(*(found[c] for c in docs.columns), fields.alias("_weighed"))


def ranks(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``row`` and ``rank`` (from 1) of the highest ``percent`` of the rows (row, doc_id, words, score) with ``least_words`` at least.

    Ties go to the smaller ``doc_id`` (null: last), then by ``row``.  Scores are sorted by ranges; a row's
    rank is its place in its range and the rows of the ranges before, one number a range.
    """
    spark = scored.sparkSession
    eligible = scored.where(F.col("words") >= least_words).select("row", "doc_id", "score")
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = eligible.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = cut(ordered.select("row", F.monotonically_increasing_id().alias("at")), "placed")  # number of the range, and place in it
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a range
    drawn = percent * placed.count() // 100
    ranked = placed.join(F.broadcast(before), part == F.col("part"))
    rank = F.coalesce("before", F.lit(0)) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranked.select("row", rank.alias("rank")).where(F.col("rank") <= drawn)


def _numbered(docs: DataFrame, gains: np.ndarray, seed: int, texts: bool = True) -> DataFrame:
    """Written once, so that a row's number stays."""
    found = weighed(docs, gains, seed).withColumn("_row", F.monotonically_increasing_id())
    return cut(found if texts else found.drop("text"), "weighed")


def _ranked(found: DataFrame, percent: int, least_words: int) -> DataFrame:
    return ranks(found.select(F.col("_row").alias("row"), "doc_id", F.col("_weighed.words").alias("words"), F.col("_weighed.score").alias("score")), percent, least_words)


def scores(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``docs``; see :func:`resample`."""
    found = _numbered(docs.select("doc_id", "text"), learned(docs, target, buckets), seed, texts=False)
    drawn = _ranked(found, percent, least_words).withColumnRenamed("row", "_row")
    return found.join(drawn, "_row", "left").select("doc_id", "_weighed.n_features", "_weighed.weight", "_weighed.score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that are drawn, whole, with ``rank``: ``percent`` of those of ``least_words`` words, nearest ``target``.

    A null text has no words, and a null id is hashed as nothing and comes last among ties;
    rows repeated whole are documents of their own; a target without words leaves the
    smoothed shares of the corpus alone to decide.  An empty table gives an empty
    result.  Columns are kept, whatever their names; one called ``rank`` is replaced.
    """
    found = _numbered(docs, learned(docs, target, buckets), seed)
    drawn = _ranked(found, percent, least_words).withColumnsRenamed({"row": "_row", "rank": "_rank"})
    met = found.join(drawn, "_row")
    return met.select(*(met[c] for c in docs.columns if c != "rank"), F.col("_rank").alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
