"""Quality classifier: ordinal cumulative-link regression on graded ratings.

With grades 0 .. K-1, P(grade >= k) = sigmoid(score - threshold_k): one score from shared
weights of hashed text features, and ordered thresholds.  It gives an expected grade and,
for selection, the probability of the upper grades.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drawn, in_small_batches, release_memory

#: log2 of the number of hashed weights.
BITS = 20
#: Expected rated documents of each grade that the fit uses; bounds what reaches the driver.
TRAIN_PER_GRADE = 4000
#: Features of fewer sampled documents get no weight.
MIN_DOCUMENTS = 4
L1 = 2e-5
STEPS = 120
#: Documents with P(grade >= SELECT_GRADE) of at least SELECT_PROBABILITY are selected.
SELECT_GRADE = 2
SELECT_PROBABILITY = 0.5
#: Words whose features a worker keeps; bounds memory alone.
CACHE_WORDS = 100_000
#: Drawn ids (12 bytes each) that are sent to every task; more are joined.
MOST_DRAWN = 200_000
#: Columns that :func:`grade` makes; input columns of these names are replaced.
MADE = ("expected_grade", "tail_probability", "selected")


def rating(quality: Column, toxic: Column) -> Column:
    """Grades of the label table: 0 low quality, 1 good but toxic, 2 good; null where a label is null."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) >> (32 - BITS)


def word_features(word: str) -> tuple[int, ...]:
    """The word, its beginnings, and the signs it ends with."""
    core = word.lower().rstrip(".,;:!?*#%&$|")
    out = {_hash("w" + core), _hash("e" + word[len(core) :])}
    if len(core) > 4:
        out |= {_hash("4" + core[:4]), _hash("5" + core[:5])}
    return tuple(out)


def _shape(words: list[str], kinds: int) -> tuple[int, ...]:
    """Length, variety and capitals of a text, in steps."""
    n = len(words)
    if not n:
        return (_hash("empty"),)
    size = n.bit_length()
    capitals = sum(map(str.isupper, words))
    return (_hash(f"n{size}"), _hash(f"u{size}.{10 * kinds // n}"), _hash(f"c{10 * capitals // n}"))


class Features:
    """Distinct hashed features of a text; only those with a weight, if ``weighted`` tells which."""

    def __init__(self, weighted: np.ndarray | None = None):
        self.weighted = weighted
        self.cache: dict[str, tuple[int, ...]] = {}

    def _keep(self, features: tuple[int, ...]) -> tuple[int, ...]:
        return features if self.weighted is None else tuple(x for x in features if self.weighted[x])

    def __call__(self, text: str) -> set[int]:
        words = text.split()
        kinds = set(words)
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cache = self.cache
        for word in kinds.difference(cache):
            cache[word] = self._keep(word_features(word))
        return set(self._keep(_shape(words, len(kinds)))).union(*map(cache.__getitem__, kinds))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, by column."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))


def fit(features: list[np.ndarray], grades: np.ndarray, importance: np.ndarray, n_grades: int) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty, by proximal steps with per-weight rates.

    Without any rated document all weights are 0 and all grades equally likely.
    """
    thresholds = -np.log(np.arange(n_grades - 1, 0, -1) / np.arange(1, n_grades))  # equal shares
    weights = np.zeros(1 << BITS)
    if not len(features):
        return OrdinalModel(weights, thresholds)
    columns = np.concatenate(features)
    owner = np.repeat(np.arange(len(features)), [len(x) for x in features])
    often = np.bincount(columns, minlength=1 << BITS) >= MIN_DOCUMENTS
    keep = often[columns]
    names = np.flatnonzero(often)
    place = np.cumsum(often) - 1  # of a weight among those that are kept
    columns, owner = place[columns[keep]], owner[keep]
    del place, keep, often
    importance = importance / importance.sum()
    w, n, k = np.zeros(len(names)), len(features), np.arange(n_grades - 1)
    m1, m2, t1, t2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(thresholds), np.zeros_like(thresholds)
    for step in range(1, STEPS + 1):
        s = np.bincount(owner, w[columns], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - thresholds, -30, 30)))
        full = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
        upper, lower = full[np.arange(n), grades], full[np.arange(n), grades + 1]
        g_s = -importance * (1 - upper - lower)
        chance = np.maximum(upper - lower, 1e-9)
        slope = p * (1 - p) / chance[:, None] * importance[:, None]
        g_t = (slope * (k == grades[:, None] - 1)).sum(0) - (slope * (k == grades[:, None])).sum(0)
        g = np.bincount(columns, g_s[owner], minlength=len(w))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        t1, t2 = 0.9 * t1 + 0.1 * g_t, 0.99 * t2 + 0.01 * g_t * g_t
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        rate = 0.1 / (np.sqrt(m2 / fix2) + 1e-5)
        w = w - rate * m1 / fix1
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        thresholds = np.sort(thresholds - 0.1 / (np.sqrt(t2 / fix2) + 1e-5) * t1 / fix1)
    weights[names] = w
    return OrdinalModel(weights, thresholds)


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, per_grade: int = TRAIN_PER_GRADE) -> OrdinalModel:
    """Fit on about ``per_grade`` documents of each grade, drawn by doc_id's hash and weighted back to their shares.

    ``ratings``: doc_id, grade; null grades and ids are ignored, a doc_id rated more than
    once counts once with its lowest grade.
    """
    rated = ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sizes = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {g: min(1.0, per_grade / n) for g, n in sizes.items()}
    chosen = F.lit(0.0)
    for g, x in share.items():
        chosen = F.when(F.col("grade") == g, x).otherwise(chosen)
    own = rated.where(drawn(chosen, "doc_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for pdf in batches:
            yield pd.DataFrame({"grade": pdf["grade"], "f": [np.fromiter(features(x), "int32").tobytes() for x in pdf["text"]]})

    ids = cut(own.select("doc_id", "grade"), "drawn")
    ids = F.broadcast(ids) if ids.count() <= MOST_DRAWN else ids.hint("merge")  # the texts of others stay where they are
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").select("grade", "text").mapInPandas(run, "grade int, f binary").toPandas()
    grades = sample["grade"].to_numpy("int64")
    importance = np.array([1 / share[g] for g in grades]) ** 0.5  # half way to equal shares
    features = [np.frombuffer(x, "int32") for x in sample["f"]]
    del sample
    release_memory()
    model = fit(features, grades, importance, n_grades)
    del features
    release_memory()
    return model


def grade(docs: DataFrame, model: OrdinalModel, select_grade: int = SELECT_GRADE, probability: float = SELECT_PROBABILITY) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` (of ``select_grade`` or more) and ``selected``.

    Null text counts as empty and is graded like any other; rows are independent, so
    repeated rows are graded alike; an empty table gives an empty result; the other columns
    of ``docs`` are kept as they are, but for those named like the new ones, which go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_probability double, selected boolean")
    def grades(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        features = Features(own.weights != 0)
        for texts in batches:
            scores = np.array([own.weights[list(features(x or ""))].sum() for x in texts])
            tails = own.tails(scores)
            upper = tails[:, select_grade - 1]
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_probability": upper, "selected": upper >= probability})
        del features
        release_memory()

    kept = [c for c in docs.columns if c not in MADE]
    row = docs.select(F.struct(F.lit(1).alias("_"), *(docs[c] for c in kept)).alias("row"), docs["text"])
    graded = row.select("row", grades("text").alias("grades"))
    return graded.select(*(F.col("row")[c].alias(c) for c in kept), "grades.expected_grade", "grades.tail_probability", "grades.selected")


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> OrdinalModel:
    """A model from the labels of ``sf_dir`` on ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(docs, labels.select("doc_id", rating(F.col("quality"), F.col("toxic")).alias("grade")))


@in_small_batches()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return grade(docs, trained(spark, docs, sf_dir)).drop("text")
