"""Figures that the dashboard derives from the views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import aggregates as A

#: Archetypes of the closed vocabulary, and what an interaction weighs against a view.
ARCHETYPES = 19
INTERACTION_WEIGHT = 50


def showcase(overview: DataFrame, projects: DataFrame, dimensions: int = 14) -> DataFrame:
    """One row: hit rate in per cent, inferences, strategy space, paths between categories and signal flux."""
    kinds = projects.where(~P.blank(F.col("category"))).agg(F.count_distinct("category").alias("categories"))
    n = F.col("categories")
    return overview.crossJoin(kinds).select(
        F.when(F.col("notes") != 0, A.percent(F.col("hits_real"), F.col("notes"), 1)).otherwise(0.0).alias("hit_rate"),
        (F.col("notes") * dimensions).alias("inferences"),
        (F.col("levers") * F.col("audiences") * ARCHETYPES).alias("strategy_space"),
        F.greatest(F.lit(0), n * (n - 1)).alias("transfer_paths"),
        (F.col("impressions") + F.col("reads") + F.col("interactions") * INTERACTION_WEIGHT).alias("signal_flux"),
    )


def best_and_worst(rows: DataFrame, name: str, value: str, where: Column | None = None) -> DataFrame:
    """One row: the names with the greatest and least ``value`` (of equal ones the least name) and the whole quotient of the two."""
    own = (rows if where is None else rows.where(where)).where(F.col(value).isNotNull())
    best, worst = F.struct(-F.col(value), F.col(name)), F.struct(F.col(value), F.col(name))
    found = own.agg(F.min_by(name, best).alias("best"), F.min_by(name, worst).alias("worst"), F.max(value).alias("most"), F.min(value).alias("least"))
    return found.select("best", "worst", "most", "least", F.when(F.col("least") > 0, F.round(F.col("most") / F.col("least")).cast("bigint")).alias("ratio"))


def peaks(monthly: DataFrame) -> DataFrame:
    """One row: the first month with most impressions and that with most hits."""
    first = lambda c: F.max_by("ym", F.struct(F.col(c), -F.regexp_replace("ym", "-", "").cast("int")))
    return monthly.agg(first("impressions").alias("peak_impressions"), first("hits").alias("peak_hits"))


def weekday_totals(activity: DataFrame) -> DataFrame:
    """Notes of each ISO weekday, those without any too."""
    days = activity.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("dow"))
    return F.broadcast(days).join(activity.groupBy("dow").agg(F.sum("n").alias("n")), "dow", "left").fillna(0, ["n"])


def ranked_axes(matrix: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """axis, name, n and rank of each axis of a matrix of counts: its first names by their totals (ties by name)."""
    out = None
    for axis, k in limits.items():
        totals = matrix.groupBy(F.col(axis).alias("name")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(k)
        ranked = totals.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "name"))).alias("all"))  # k rows
        own = ranked.select(F.lit(axis).alias("axis"), F.posexplode("all").alias("at", "x")).select("axis", F.col("x.name").alias("name"), (-F.col("x.m")).alias("n"), (F.col("at") + 1).alias("rank"))
        out = own if out is None else out.unionByName(own)
    return out


def stacked_shares(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``share``, the per cent of the whole that each takes."""
    return rows.crossJoin(rows.agg(F.sum(value).alias("_whole"))).withColumn("share", A.percent(F.col(value), F.col("_whole"), 1)).drop("_whole")


def system_status(pulse: DataFrame) -> DataFrame:
    """name, state (live, wired or planned), count and time of each part of the system, from the pulse's row."""
    parts: Sequence[tuple[str, str | None, str | None]] = (
        ("source table", "source_n", "last_ingest"),
        ("annotation", "annotated_n", "annotated_last"),
        ("metric snapshots", "snaps_n", "snaps_last"),
        ("sample channel", "channel1_n", "channel1_last"),
        ("writing channel", "channel2_n", "channel2_last"),
        ("telemetry", "pipeline_runs_n", None),
        ("distribution", None, None),
    )
    of = lambda n: F.lit("planned") if n is None else F.when(F.col(n) > 0, "live").otherwise("wired")
    each = [
        F.struct(F.lit(name).alias("name"), of(n).alias("state"), (F.col(n) if n else F.lit(None)).cast("bigint").alias("n"), (F.col(at) if at else F.lit(None)).cast("timestamp").alias("at")) for name, n, at in parts
    ]
    return pulse.select(F.inline(F.array(*each)))
