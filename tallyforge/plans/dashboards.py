"""The dashboard's breakdowns, overviews and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import predicates as P
from ..operators import aggregates as A
from .views import borrowable

FUNNEL = (V.FLOP, V.PRE_HIT, V.HIT, V.MEGA_HIT)


def real_hits() -> Column:
    return A.count_where(P.real_hit(F.col("tier"), F.col("flags")))


def performance(notes: DataFrame, by: dict[str, str], least: int = 1, extra: list[Column] | None = None) -> DataFrame:
    """n, hits and hit rate in per cent of each combination of ``by`` (name: column) with ``least`` notes.

    ``extra`` adds aggregates; without it the mean interactions.
    """
    n = F.count(F.lit(1))
    more = [A.whole_mean(F.col("interactions")).alias("avg_inter")] if extra is None else extra
    grouped = notes.groupBy(*(F.col(c).alias(k) for k, c in by.items()))
    return grouped.agg(n.alias("n"), real_hits().alias("hits"), A.percent(real_hits(), n).alias("hit_rate"), *more).where(F.col("n") >= least)


def lever_performance(notes: DataFrame) -> DataFrame:
    return performance(notes.where(P.filled(F.col("lever"))), {"lever": "lever"}, 5)


def valence_matrix(notes: DataFrame) -> DataFrame:
    return performance(notes.where(F.col("valence").isNotNull() & F.col("intensity").isNotNull()), {"valence": "valence", "intensity": "intensity"})


def tag_performance(notes: DataFrame, tags: str, name: str, least: int) -> DataFrame:
    """Performance by element of an array column; notes without elements drop out."""
    return performance(notes.select("tier", "flags", "interactions", F.explode(tags).alias(name)), {name: name}, least)


def format_performance(notes: DataFrame) -> DataFrame:
    return performance(notes.where(P.filled(F.col("content_format"))), {"fmt": "content_format"}, 10)


def rates() -> list[Column]:
    return [F.round(F.avg("read_rate"), 4).alias("read_rate"), F.round(F.avg("interaction_rate"), 4).alias("inter_rate")]


def intent_performance(notes: DataFrame) -> DataFrame:
    return performance(notes.where(F.col("intent").isNotNull()), {"intent": "intent"}, extra=rates())


def _without_synthetic_hits(notes: DataFrame) -> DataFrame:
    return notes.where(~(P.hit(F.col("tier")) & P.synthetic(F.col("flags"))))


def tier_funnel(notes: DataFrame) -> DataFrame:
    """Means and maximum by tier; synthetic hits are left out."""
    kept = _without_synthetic_hits(notes.where(F.col("tier").isin(*FUNNEL)))
    return kept.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), A.whole_mean(F.col("impressions")).alias("avg_imp"), *rates(), A.whole_mean(F.col("interactions")).alias("avg_inter"), F.max("interactions").alias("max_inter")
    )


def project_performance(notes: DataFrame, projects: DataFrame) -> DataFrame:
    n = F.count("note_id")
    return notes.join(projects.select("project_id", "category", "platform"), "project_id").groupBy("project_id", "category", "platform").agg(
        n.alias("notes"),
        real_hits().alias("hits"),
        A.percent(real_hits(), n).alias("hit_rate"),
        A.whole_mean(F.col("impressions")).alias("avg_imp"),
        F.coalesce(F.sum("impressions"), F.lit(0)).alias("total_imp"),
        A.count_where(P.filled(F.col("lever"))).alias("essence"),
    )


def project_tiers(notes: DataFrame) -> DataFrame:
    return _without_synthetic_hits(notes.where(F.col("tier").isin(*FUNNEL, V.RISK))).groupBy("project_id", "tier").agg(F.count(F.lit(1)).alias("n"))


def levers(notes: DataFrame) -> DataFrame:
    return notes.where(P.filled(F.col("lever"))).groupBy("lever").agg(F.count(F.lit(1)).alias("n"))


def matrix(notes: DataFrame) -> DataFrame:
    """Notes by lever and audience."""
    rows = notes.where(P.filled(F.col("lever"))).select("lever", F.explode("target_audience").alias("audience"))
    return rows.where(P.filled(F.col("audience"))).groupBy("lever", "audience").agg(F.count(F.lit(1)).alias("n"))


def project_cards(notes: DataFrame, projects: DataFrame) -> DataFrame:
    """Counts of each project that has notes, and its number in the order of registration."""
    numbered = projects.select("project_id", "category", F.row_number().over(Window.orderBy("created_seq")).alias("seq"))  # a row for each project
    verified = P.verified_hit(F.col("tier"), F.col("tier_source"), F.col("flags"))
    counts = notes.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("notes"), A.count_where(verified).alias("verified_hits"), A.count_where(F.col("intent").isNotNull()).alias("essence"), F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions")
    )
    return counts.join(numbered, "project_id")


def top_hits(notes: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` verified hits with most interactions; equal ones by note_id."""
    rows = notes.where(P.verified_hit(F.col("tier"), F.col("tier_source"), F.col("flags")) & F.col("interactions").isNotNull())
    best = rows.select("note_id", "project_id", "lever", "tier", "interactions", "reads", "impressions").orderBy(F.desc_nulls_last("interactions"), "note_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("interactions"), "note_id")))  # k rows


def overview(notes: DataFrame, projects: DataFrame, lessons: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """All the dashboard's figures in one row: one scan and one aggregation of the notes, one count of each other table.

    A note is spread over its audiences, and what is counted by note counts at the first of
    them; levers and audiences come from small closed sets, of which each task keeps one.
    """
    tier = F.col("tier")
    spread = notes.select("tier", "tier_source", "flags", "intent", "publish_time", "audience_inferred_at", "impressions", "reads", "interactions", "lever", F.posexplode_outer("target_audience").alias("at", "audience"))
    head = F.coalesce(F.col("at"), F.lit(0)) == 0
    total = lambda c: F.coalesce(F.sum(F.when(head, F.col(c))), F.lit(0))
    kinds = lambda c: F.size(F.collect_set(F.when(P.filled(F.col(c)), F.col(c)))).cast("bigint")
    figures = spread.agg(
        F.count_if(head).alias("notes"),
        F.count_if(head & P.hit(tier)).alias("hits_all"),
        F.count_if(head & P.verified_hit(tier, F.col("tier_source"), F.col("flags"))).alias("hits_real"),
        F.count_if(head & borrowable()).alias("borrowable_cards"),
        F.count(F.when(head, F.col("intent"))).alias("essence_done"),
        F.count(F.when(head, F.col("audience_inferred_at"))).alias("audience_tracked"),
        total("impressions").alias("impressions"),
        total("reads").alias("reads"),
        total("interactions").alias("interactions"),
        F.coalesce(F.max("interactions"), F.lit(0)).alias("top_interactions"),
        kinds("lever").alias("levers"),
        kinds("audience").alias("audiences"),
    )
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return figures.crossJoin(one(projects, "projects")).crossJoin(one(lessons, "cards")).crossJoin(one(cache, "librarian")).withColumn("as_of", as_of)


def system_pulse(notes: DataFrame, projects: DataFrame, snapshots: DataFrame, audits: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Freshness of every table in one row, one aggregation a table."""
    own = notes.agg(
        F.count(F.lit(1)).alias("notes_total"),
        F.max("updated_at").alias("last_update"),
        F.max("ingested_at").alias("last_ingest"),
        F.count("record_id").alias("source_n"),
        F.count("annotated_at").alias("annotated_n"),
        F.max("annotated_at").alias("annotated_last"),
        F.count("synced_to_channel1_at").alias("channel1_n"),
        F.max("synced_to_channel1_at").alias("channel1_last"),
        F.count("synced_to_channel2_at").alias("channel2_n"),
        F.max("synced_to_channel2_at").alias("channel2_last"),
        F.count_distinct("account_id").alias("accounts_n"),
    )
    seen = lambda df, at, name: df.agg(F.count(F.lit(1)).alias(f"{name}_n"), *([F.max(at).alias(f"{name}_last")] if at else []))
    tables = (seen(snapshots, "collected_at", "snaps"), seen(audits, "occurred_at", "audit"), seen(projects, None, "projects"), seen(runs, None, "pipeline_runs"))
    for t in tables:
        own = own.crossJoin(t)
    return own.withColumn("server_now", as_of)


def monthly(notes: DataFrame) -> DataFrame:
    """Notes, impressions, hits and running impressions by month; the window sees months only."""
    month = F.date_trunc("month", "publish_time")
    sums = notes.where(F.col("publish_time").isNotNull()).groupBy(month.alias("mon")).agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions"), real_hits().alias("hits"))
    return sums.select(F.date_format("mon", "yyyy-MM").alias("ym"), "notes", "impressions", "hits", F.sum("impressions").over(Window.orderBy("mon")).alias("cum_impressions"))


def publishing_activity(notes: DataFrame) -> DataFrame:
    """Notes by month and ISO weekday (1 is Monday)."""
    at = F.col("publish_time")
    return notes.where(at.isNotNull()).groupBy(F.date_format(at, "yyyy-MM").alias("ym"), F.extract(F.lit("DAYOFWEEK_ISO"), at).cast("int").alias("dow")).agg(F.count(F.lit(1)).alias("n"))


def reach_concentration(notes: DataFrame, points: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Share of all impressions that the top 1, 5 and 10 of 100 equal parts of the notes take, and that hits take.

    Exact, without sorting all notes in one task: see :func:`~..operators.aggregates.value_ranks`.
    """
    seen = notes.where(F.col("impressions") > 0)
    real = P.real_hit(F.col("tier"), F.col("flags"))
    values = A.value_ranks(seen, "impressions", [A.count_where(real).alias("hits")])
    inside = lambda tile: F.greatest(F.lit(0), F.least(F.col("n"), A.ntile_end(F.col("total"), 100, tile) - F.col("before")))
    v = F.col("impressions")
    total = F.sum(v * F.col("n"))
    return values.agg(
        F.max("total").alias("total_notes"),
        total.alias("total_imp"),
        *(A.percent(F.sum(v * inside(p)), total).alias(f"top{p}_share") for p in points),
        A.percent(F.sum(v * F.col("hits")), total).alias("hit_reach_share"),
        A.percent(F.sum("hits"), F.max("total"), 2).alias("hit_note_pct"),
    )
