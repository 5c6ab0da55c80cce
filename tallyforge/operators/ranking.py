"""Top-k by group, newest row of a key, diverse picks and fair quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``; Spark keeps k a group before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def newest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in ``order``."""
    return top_per_group(df, key, order, 1).drop("rank")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def diversity_pick(df: DataFrame, by: Sequence[str], kind: str, order: Sequence[Column], n: int) -> DataFrame:
    """``n`` rows of each group in two passes: first the best of each kind (rows without one all pass), then the rest.

    ``order`` must be total.  Adds ``pick``, from 1.  Only the first ``n`` of each kind can be
    picked, and Spark keeps so many in each task, before groups meet anywhere.
    """
    kinds = F.coalesce(F.col(kind), F.lit(""))
    few = df.withColumn("_kind", kinds).withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_kind").orderBy(*order))).where(F.col("_place") <= n)
    second = (F.col("_kind") != "") & (F.col("_place") > 1)
    pick = F.row_number().over(Window.partitionBy(*by).orderBy(second, *order))
    return few.withColumn("pick", pick).where(F.col("pick") <= n).drop("_kind", "_place")


def round_robin(df: DataFrame, by: str, score: str, tie: str, quota: int, cap: int) -> DataFrame:
    """At most ``quota`` rows of each group, then ``cap`` in all, taking turns: wave after wave, groups by their best score."""
    own = Window.partitionBy(by).orderBy(F.desc(score), tie)
    queued = df.withColumn("wave", F.row_number().over(own)).where(F.col("wave") <= quota)
    best = queued.groupBy(F.col(by).alias("best_of")).agg(F.max(score).alias("best"))
    turns = queued.join(best, F.col(by).eqNullSafe(F.col("best_of"))).orderBy("wave", F.desc("best"), by, tie).limit(cap)
    return turns.drop("best_of", "best")


def nearest_by_cosine(vectors: DataFrame, queries: DataFrame, key: str, x: str, k: int, block: int = 2000) -> DataFrame:
    """query_id, ``key`` and rank of the ``k`` rows of the largest cosine to each query but itself (rounded to 6 places; ties by key).

    A stated set of queries against all rows, in blocks: both sides are packed into rows of
    about ``block`` vectors, each pair of blocks is scored at once and leaves ``k`` rows a
    query, so nothing is shuffled but those and the blocks themselves.
    """
    import numpy as np
    import pandas as pd

    def packed(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.pmod(F.xxhash64(key), F.lit(max(1, df.count() // block))).alias("b"), F.struct(F.col(key).alias("k"), F.col(x).alias("x")).alias("v"))
        return own.groupBy("b").agg(F.collect_list("v").alias("v")).select(F.col("v.k").alias(f"{name}_id"), F.col("v.x").alias(f"{name}_x"))

    def run(batches):
        unit = lambda rows: (m := np.stack([np.asarray(r, "f8") for r in rows])) / np.sqrt((m * m).sum(axis=1, keepdims=True))
        for pdf in batches:
            for own, m, ids, wanted in zip(pdf["v_id"], pdf["v_x"], pdf["q_id"], pdf["q_x"], strict=True):
                own, ids = np.asarray(own), np.asarray(ids)
                score = np.round(unit(wanted) @ unit(m).T, 6)
                score[ids[:, None] == own[None, :]] = -np.inf
                best = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(ids)), best.shape[1])
                out = pd.DataFrame({"query_id": ids[rows], key: own[best.ravel()], "cosine": score[rows, best.ravel()]})
                yield out[np.isfinite(out["cosine"])]

    found = packed(vectors, "v").crossJoin(packed(queries, "q")).mapInPandas(run, f"query_id long, {key} long, cosine double")
    return top_per_group(found, ["query_id"], [F.desc("cosine"), F.asc(key)], k).select("query_id", key, "rank")
