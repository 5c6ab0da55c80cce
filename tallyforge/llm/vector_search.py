"""Approximate nearest neighbours by largest inner product over robust-pruned graphs.

Vectors are dealt to bands of length, each at most twice as long as another of its band, and
the bands to shards of bounded size.  In each shard a directed graph is grown in batches: a
greedy search of the graph so far proposes neighbours for a point, and of them, nearest
first, those stay that no kept one is much nearer to (relaxed pruning).  One task reads a
shard's graph once and lets all queries stream past it in blocks, each by beam search, and
the best of all shards are ranked by exact scores.  Within a band one more coordinate makes
all vectors equally long, so that the nearest are those of the largest inner product; as
lengths differ so little there, it leaves the distances their precision.  Bands of few
vectors share shards that are compared whole, as is a shard for a query that finds too few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release_memory

TOP = 20
QUERY_STEP = 20
SHARD_ROWS = 16384
#: Points of a band that make a graph worth while; smaller bands share shards that are compared whole.
GRAPH_ROWS = 1024
#: Queries that search a shard's graph at once; bounds memory alone.
QUERY_ROWS = 512
DEGREE = 32
BEAM = 256
BUILD_BEAM = 80
#: How much nearer a kept neighbour must be to a candidate for it to go.
RELAX = 1.2
#: Beam members expanded in one step.
WIDTH = 4


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest points found for each query, nearest first, and their squared distances; -1 and infinity where fewer."""
    n, m = len(points), len(queries)
    square = np.einsum("ij,ij->i", points, points)
    seen = np.zeros((m, n), bool)
    ids, dist, done = np.full((m, beam), -1), np.full((m, beam), np.inf, "f4"), np.ones((m, beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = square[entry] - 2 * queries @ points[entry]
    seen[:, entry] = True
    active = np.arange(m)
    while len(active):
        waiting = np.where(done[active], np.inf, dist[active])
        pick = np.argsort(waiting, axis=1, kind="stable")[:, :WIDTH]
        ok = np.isfinite(np.take_along_axis(waiting, pick, 1))
        some = ok[:, 0]
        active, pick, ok = active[some], pick[some], ok[some]
        if not len(active):
            break
        chosen = ids[active[:, None], pick]
        np.put_along_axis(sub := done[active], pick, True, 1)
        done[active] = sub
        near = np.where(ok[:, :, None], graph[chosen], -1).reshape(len(active), -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[active[:, None], near]
        row, col = np.nonzero(fresh)
        point = near[row, col]
        seen[active[row], point] = True
        d = np.full(near.shape, np.inf, "f4")
        d[row, col] = square[point] - 2 * np.einsum("ij,ij->i", queries[active[row]], points[point])
        all_d = np.concatenate([dist[active], d], 1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(all_d, best, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, near, -1)], 1), best, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], 1), best, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Of each own point's candidates (-1: none), nearest first, those that no kept one is ``relax`` times nearer to."""
    vectors = points[candidates]
    d = ((vectors - points[own][:, None]) ** 2).sum(2)
    repeated = np.zeros(candidates.shape, bool)
    order = np.argsort(candidates, axis=1, kind="stable")
    sorted_ = np.take_along_axis(candidates, order, 1)
    np.put_along_axis(repeated, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
    d[(candidates < 0) | (candidates == own[:, None]) | repeated] = np.inf
    out = np.full((len(own), degree), -1)
    rows = np.arange(len(own))
    left = d.copy()
    for k in range(degree):
        best = left.argmin(axis=1)
        alive = np.isfinite(left[rows, best])
        if not alive.any():
            break
        out[alive, k] = candidates[rows, best][alive]
        between = ((vectors - vectors[rows, best][:, None]) ** 2).sum(2)
        left[(relax * relax * between <= d) & alive[:, None]] = np.inf
        left[rows, best] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, batch: int = 512) -> tuple[np.ndarray, int]:
    """Neighbours of each point (-1: none) and the point where searches start."""
    n = len(points)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    draw = np.random.default_rng(n)
    room = 2 * degree  # links back wait in the upper half until it is full
    graph, filled = np.full((n, room), -1), np.zeros(n, "i8")

    def shorten(own: np.ndarray) -> None:
        for a in range(0, len(own), 256):
            part = own[a : a + 256]
            graph[part] = -1
            graph[part, :degree] = prune(points, part, held[part], degree, relax)
            filled[part] = (graph[part] >= 0).sum(axis=1)

    order = draw.permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    placed = 1
    while placed < n:
        own = order[placed : placed + max(8, min(batch, placed))]
        found, _ = beam_search(points, graph, entry, points[own], beam)
        for a in range(0, len(own), 256):
            graph[own[a : a + 256], :degree] = prune(points, own[a : a + 256], found[a : a + 256], degree, relax)
        filled[own] = (graph[own] >= 0).sum(axis=1)
        source, column = np.nonzero(graph[own] >= 0)
        target, source = graph[own][source, column], own[source]
        while len(target):
            by = np.argsort(target, kind="stable")
            target, source = target[by], source[by]
            slot = filled[target] + np.arange(len(target)) - np.searchsorted(target, target)
            fits = slot < room
            graph[target[fits], slot[fits]] = source[fits]
            np.add.at(filled, target[fits], 1)
            target, source = target[~fits], source[~fits]
            held = graph.copy() if len(target) else graph
            shorten(np.unique(target))
        placed += len(own)
    held = graph.copy()
    shorten(np.flatnonzero(filled > degree))
    graph = graph[:, :degree]
    return graph, entry


def _augmented(vectors: np.ndarray, band: int) -> np.ndarray:
    """Vectors of a band, scaled to less than 1, and one more coordinate that brings their length to 1."""
    scaled = np.ldexp(vectors, -(band + 1))
    rest = np.sqrt(np.maximum(1 - (scaled**2).sum(axis=1), 0))
    return np.concatenate([scaled, rest[:, None]], axis=1).astype("f4")


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, whatever their size."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _vectors(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "f8").reshape(len(column), -1)


class ShardGraph:
    """A shard's graph from its rows (at, vector, rows, band, entry, near), and its points' exact vectors; without a graph it is compared whole."""

    def __init__(self, graph: pd.DataFrame):
        graph = graph.sort_values("at")
        self.exact = _vectors(graph["vector"])
        self.rows = graph["rows"].tolist()
        self.near = None
        if len(graph["near"].iloc[0]):
            self.points = _augmented(self.exact, int(graph["band"].iloc[0]))
            self.near = np.frombuffer(b"".join(graph["near"]), "i4").reshape(len(graph), -1)
            self.entry = int(graph["entry"].to_numpy(bool).argmax())

    def answers(self, queries: pd.DataFrame, top: int) -> pd.DataFrame:
        """query, query_id, vec_id and score of the ``top`` found for each of (query, query_id, vector), by exact scores."""
        asking = _vectors(queries["vector"])
        if self.near is not None:
            ends = np.concatenate([_unit(asking), np.zeros((len(asking), 1))], axis=1).astype("f4")
            found, _ = beam_search(self.points, self.near, self.entry, ends, BEAM)
        out, every = [], np.arange(len(self.rows))
        for i, (query, query_id) in enumerate(zip(queries["query"], queries["query_id"], strict=True)):
            at = every if self.near is None else found[i][found[i] >= 0]
            if len(at) <= top:  # a part of the graph that can't be left
                at = every
            with np.errstate(over="ignore", invalid="ignore"):
                scores = self.exact[at] @ asking[i]
            scores[np.isnan(scores)] = -np.inf  # infinities of both signs
            if len(at) > BEAM:
                least = np.argpartition(-scores, top)[: top + 1]  # a point may be the query's own row alone
                keep = scores >= scores[least].min()
                at, scores = at[keep], scores[keep]
            ranked = sorted((-s, r["vec_id"]) for s, k in zip(scores.tolist(), at, strict=True) for r in self.rows[k] if r["row"] != query)
            out += [(query, query_id, v, -s) for s, v in ranked[:top]]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """row, vec_id, vector (doubles as bytes) and band (whole part of the binary logarithm of its length) of the rows that take part.

    Those have an id and a vector that is not null, empty or zero, without null or
    non-finite components, of the most frequent dimension (of equals the smallest).
    """

    def band(x: np.ndarray) -> int:
        most = np.abs(x).max()
        fraction, exponent = np.frexp(most)  # no square of a component can overflow or vanish
        return int(exponent + np.floor(np.log2(fraction) + np.log2(((x / most) ** 2).sum()) / 2))

    @F.pandas_udf("vector binary, band int")
    def packed(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(x.tobytes(), band(x)) for x in (np.asarray(v, "f8") for v in column)], columns=["vector", "band"])

    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(good)
    kept = cut(rows.select("vec_id", F.size(x).alias("dimension"), packed(x).alias("p")).select(F.expr("uuid()").alias("row"), "vec_id", "dimension", "p.vector", "p.band"), "vectors")
    common = kept.groupBy("dimension").count().orderBy(F.desc("count"), "dimension").first()
    return kept.where(F.col("dimension") == (common["dimension"] if common else 0))


def bands_to_shards(counts: dict[int, int], shard_rows: int, graph_rows: int) -> dict[int, tuple[int, int, bool]]:
    """First shard, how many, and whether they have graphs, of each band (by its points; there are at most 2,100 bands)."""
    out, next_, room = {}, 0, 0
    for band, n in sorted(counts.items()):
        if n >= graph_rows:
            out[band] = next_, -(-n // shard_rows), True
            next_ += out[band][1]
    shared = next_ - 1
    for band, n in sorted(counts.items()):
        if n < graph_rows:
            if n > room:
                shared, room = shared + 1, max(graph_rows, shard_rows // 4)
            room -= n
            out[band] = shared, 1, False
    return out


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, shard_rows: int = SHARD_ROWS, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest rows of ``vectors`` found for each of ``queries``.

    Both as from :func:`usable`.  A query's own row is no candidate, others of its id are.
    Equal scores go by the smaller vec_id; rows of equal vectors are one point of the graph
    that keeps the ``top`` + 1 least ids, more of which can't be in any answer.  Lengths may
    differ as much as doubles can.  No rows give no result.
    """
    spark = vectors.sparkSession
    same = Window.partitionBy("vector").orderBy("vec_id", "row")
    least = vectors.withColumn("k", F.row_number().over(same)).where(F.col("k") <= top + 1)
    points = cut(least.groupBy("vector").agg(F.collect_list(F.struct("vec_id", "row")).alias("rows"), F.first("band").alias("band")), "points")
    dealt = bands_to_shards({r["band"]: r["count"] for r in points.groupBy("band").count().collect()}, shard_rows, graph_rows)
    if not dealt:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = max(first + n for first, n, _ in dealt.values())
    told = spark.createDataFrame([(b, *x) for b, x in dealt.items()], "band int, first int, n int, graphed boolean")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.arange(len(pdf))
        if not pdf["graphed"].iloc[0]:
            return pdf.assign(at=at, entry=False, near=b"")
        graph, entry = build_graph(_augmented(_vectors(pdf["vector"]), int(pdf["band"].iloc[0])))
        return pdf.assign(at=at, entry=at == entry, near=[x.astype("i4").tobytes() for x in graph])

    kept = "shard int, vector binary, rows array<struct<vec_id:bigint,row:string>>, band int, graphed boolean"
    shard = (F.col("first") + F.pmod(F.xxhash64("vector"), F.col("n"))).cast("int").alias("shard")
    sharded = points.join(F.broadcast(told), "band").select(shard, "vector", "rows", "band", "graphed")
    graphs = cut(sharded.repartitionByRange(shards, "shard").groupBy("shard").applyInPandas(build, f"{kept}, at int, entry boolean, near binary"), "graphs")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, graph = -1, [], None
        for pdf in batches:
            for (of, kind), own in pdf.groupby(["shard", "kind"]):
                if kind == 0:
                    if of != shard:
                        shard, held, graph = of, [], None
                    held.append(own)
                elif of == shard:  # else a shard without points
                    graph = graph or ShardGraph(pd.concat(held))
                    held = []
                    for a in range(0, len(own), QUERY_ROWS):
                        yield graph.answers(own.iloc[a : a + QUERY_ROWS], top)
        release_memory()

    left = graphs.select("shard", F.lit(0).alias("kind"), "at", "vector", "rows", "band", "entry", "near", F.lit("").alias("query"), F.lit(0).cast("long").alias("query_id"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.lit(0).alias("at"), "vector", F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    met = left.unionByName(right, allowMissingColumns=True).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "kind", "at")
    found = met.mapInPandas(search, "query string, query_id long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))
