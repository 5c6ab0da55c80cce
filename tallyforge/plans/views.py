"""Summaries over projects, accounts, evaluators and prompts, and the candidate pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import predicates as P
from ..functions import scores as S
from ..operators import aggregates as A
from ..operators.ranking import top_per_group


def project_tier_summary(projects: DataFrame, notes: DataFrame) -> DataFrame:
    """Counts by tier of each project; projects without notes are kept."""
    tier = F.col("tier")
    counts = notes.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_notes"),
        A.count_where(tier == V.FLOP).alias("count_flop"),
        A.count_where(tier == V.HIT).alias("count_hit"),
        A.count_where(tier == V.MEGA_HIT).alias("count_mega"),
        F.count("tier").alias("count_labelled"),
        F.avg(F.when(tier == V.HIT, F.col("interactions"))).alias("avg_interactions_hit"),
    )
    zero = {c: 0 for c in ("total_notes", "count_flop", "count_hit", "count_mega", "count_labelled")}
    return projects.select("project_id", "brand", "category").join(counts, "project_id", "left").fillna(zero)


def data_health(projects: DataFrame, notes: DataFrame) -> DataFrame:
    """Coverage of metrics, tiers, levers and accounts (null for a project without notes), and sync counts."""
    n = F.count(F.lit(1))
    counts = notes.groupBy("project_id").agg(
        n.alias("total"),
        A.ratio(F.count("impressions"), n).alias("data_recovery_rate"),
        A.ratio(F.count("tier"), n).alias("tier_coverage_rate"),
        A.ratio(F.count("lever"), n).alias("essence_coverage_rate"),
        A.ratio(F.count("account_id"), n).alias("account_link_rate"),
        F.count("synced_to_channel1_at").alias("synced_to_channel1"),
        F.count("synced_to_channel2_at").alias("synced_to_channel2"),
    )
    return projects.select("project_id", "brand").join(counts, "project_id", "left").fillna(0, ["total", "synced_to_channel1", "synced_to_channel2"])


def account_rates(accounts: DataFrame, notes: DataFrame, least: int = 5) -> DataFrame:
    """Hits over labelled notes of accounts with ``least`` notes, and the projects they took part in."""
    hits = A.count_where(P.hit(F.col("tier")))
    counts = notes.where(F.col("account_id").isNotNull()).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_notes_count"),
        hits.alias("total_hits"),
        A.ratio(hits, F.count("tier")).alias("personal_rate"),
        A.sorted_set(F.col("project_id")).alias("projects_engaged"),
    )
    return accounts.select("account_id").join(counts.where(F.col("total_notes_count") >= least), "account_id")


def evaluator_calibration(evaluations: DataFrame) -> DataFrame:
    """Accuracy of each evaluator, and the hit rate of what it passed and rejected."""
    known = evaluations.where(F.col("was_correct").isNotNull())
    passed, rejected, hit = F.col("decision") == "pass", F.col("decision") == "reject", P.hit(F.col("actual_tier"))
    return known.groupBy("evaluator_type", "evaluator_id").agg(
        F.count(F.lit(1)).alias("total_evaluations"),
        A.count_where(F.col("was_correct")).alias("correct_predictions"),
        F.avg(F.when(F.col("was_correct"), 1.0).otherwise(0.0)).alias("accuracy_rate"),
        A.ratio(A.count_where(passed & hit), A.count_where(passed)).alias("pass_hit_rate"),
        A.ratio(A.count_where(rejected & hit), A.count_where(rejected)).alias("reject_hit_rate"),
    )


def _eligible(notes: DataFrame) -> DataFrame:
    return notes.where(P.one_of(F.col("tier"), V.BORROWABLE) & ~F.col("tier_source").eqNullSafe(V.INFERRED) & F.col("publish_time").isNotNull())


def borrowable() -> Column:
    """What makes a note a lesson card; see :func:`lesson_cards`."""
    worth = P.one_of(F.col("tier"), V.BORROWABLE) & ~F.col("tier_source").eqNullSafe(V.INFERRED) & F.col("publish_time").isNotNull()
    return worth & ~(P.synthetic(F.col("flags")) & P.hit(F.col("tier")))


def injection_candidates(notes: DataFrame, projects: DataFrame, rates: DataFrame, as_of: Column, recency: str = "half_life") -> DataFrame:
    """Notes of the last year that may be injected, with their score.

    ``recency`` is "half_life" (by trends) or the older "linear".
    """
    fresh = _eligible(notes).where((F.col("publish_time") > as_of - F.expr("INTERVAL 1 YEAR")) & ~P.synthetic(F.col("flags")))
    mapped = projects.where(F.col("channel2_project_id").isNotNull()).select("project_id", "brand", "category", "channel2_project_id")
    age = S.age_months(as_of, F.col("publish_time"))
    weight = S.decay(age, S.half_life(F.col("trends"))) if recency == "half_life" else S.linear_recency(as_of, F.col("publish_time"))
    scored = fresh.join(mapped, "project_id").withColumn("recency_weight", weight).join(rates.select("account_id", "personal_rate"), "account_id", "left")
    return scored.select(
        "note_id", "project_id", "raw_content", "tier", "tier_source", "lever", "target_audience", "publish_time", "synced_to_channel2_at", "account_id", "brand", "category", "channel2_project_id", "recency_weight",
        F.coalesce("personal_rate", F.lit(S.NO_RATE)).alias("account_rate"),
        S.rank_score(F.col("recency_weight"), F.col("tier"), F.col("tier_source"), F.col("personal_rate")).alias("injection_score"),
    )


def lesson_cards(notes: DataFrame, projects: DataFrame, rates: DataFrame, annotations: DataFrame, as_of: Column) -> DataFrame:
    """All notes worth borrowing from, however old, with the lessons curated for them."""
    synthetic = P.synthetic(F.col("flags"))
    kept = notes.where(borrowable()).withColumn("recency_weight", S.decay(S.age_months(as_of, F.col("publish_time")), 60.0))
    lessons = annotations.select(F.col("note_id").alias("lesson_of"), "hook_type", "curated_at")
    joined = kept.join(projects.select("project_id", "brand", "category"), "project_id").join(lessons, F.col("note_id") == F.col("lesson_of"), "left").join(rates.select("account_id", "personal_rate"), "account_id", "left")
    return joined.select(
        F.col("note_id").alias("source_note_id"), "project_id", "brand", "category", "tier", "tier_source", "publish_time", "lever", "target_audience", "content_format", "hook_type", "curated_at",
        F.col("lesson_of").isNotNull().alias("is_curated"),
        F.left("raw_content", F.lit(600)).alias("raw_excerpt"),
        "recency_weight",
        F.coalesce("personal_rate", F.lit(S.NO_RATE)).alias("account_rate"),
        S.rank_score(F.col("recency_weight"), F.col("tier"), F.col("tier_source"), F.col("personal_rate")).alias("rank_score"),
        synthetic.alias("synthetic"),
    )


def sync_status(projects: DataFrame, notes: DataFrame, candidates: DataFrame, as_of: Column) -> DataFrame:
    """What is synced and what is pending on both channels, hits and references apart."""
    hit, reference = P.hit(F.col("tier")), F.col("tier").eqNullSafe(V.REFERENCE)
    first, second = F.col("synced_to_channel1_at"), F.col("synced_to_channel2_at")
    # the first channel drops rows without a source or date on purpose
    due = F.coalesce((F.col("tier_source") != V.INFERRED) & (F.col("publish_time") >= as_of - F.expr("INTERVAL 1 YEAR")), F.lit(False)) & first.isNull()
    candidate = F.col("candidate").isNotNull() & second.isNull()
    rows = notes.join(candidates.select(F.col("note_id").alias("candidate")), F.col("note_id") == F.col("candidate"), "left")
    counts = {
        "total_hits": hit,
        "synced_to_channel1": hit & first.isNotNull(),
        "synced_to_channel2": hit & second.isNotNull(),
        "pending_channel1_sync": hit & due & ~P.synthetic(F.col("flags")),
        "pending_channel2_sync": hit & candidate,
        "total_reference": reference,
        "synced_reference_to_channel1": reference & first.isNotNull(),
        "pending_reference_channel1": reference & due,
        "synced_reference_to_channel2": reference & second.isNotNull(),
        "pending_reference_channel2": reference & candidate,
    }
    found = rows.groupBy("project_id").agg(
        *(A.count_where(c).alias(k) for k, c in counts.items()),
        F.max(F.when(hit, first)).alias("last_hit_sync_to_channel1_at"),
        F.max(F.when(hit, second)).alias("last_hit_sync_to_channel2_at"),
    )
    return projects.select("project_id", "brand").join(found, "project_id", "left").fillna(0, list(counts))


def tier_discrepancy(notes: DataFrame, projects: DataFrame) -> DataFrame:
    """Notes whose declared tier and interactions disagree under their project's thresholds."""
    threshold = lambda tier: F.get_json_object("tier_thresholds", f"$.{tier}").try_cast("double")
    limits = projects.select("project_id", threshold(V.HIT).alias("th_hit"), threshold(V.MEGA_HIT).alias("th_mega")).where(F.col("th_hit").isNotNull())
    declared = notes.where(P.one_of(F.col("tier_source"), V.HUMAN_SOURCES) & F.col("interactions").isNotNull())
    n, marked = F.col("interactions"), F.col("marked_tier")
    implied = F.when(n >= F.col("th_mega"), V.MEGA_HIT).when(n >= F.col("th_hit"), V.HIT).otherwise(V.FLOP)
    rows = declared.join(limits, "project_id").select("note_id", "project_id", F.col("tier").alias("marked_tier"), implied.alias("implied_tier"), "tier_source", "interactions", "th_hit", "th_mega", P.flag(F.col("flags"), "synthetic").alias("synthetic"))
    kind = (
        F.when(P.hit(marked) & (F.col("implied_tier") == V.FLOP), "over_marked")
        .when((marked == V.MEGA_HIT) & (F.col("implied_tier") == V.HIT), "over_marked_soft")
        .when((marked == V.FLOP) & P.hit(F.col("implied_tier")), "under_marked")
    )
    return rows.withColumn("discrepancy_type", kind).where(F.col("discrepancy_type").isNotNull())


def prompt_performance(outputs: DataFrame, runs: DataFrame, notes: DataFrame) -> DataFrame:
    """Hit rate of the notes that came of each output; the sums count joined rows, the rate's base different notes."""
    tier, different = F.col("tier"), F.count_distinct("note_id")
    joined = outputs.join(runs, "run_id", "left").join(notes.select("note_id", "tier", "output_id"), "output_id", "left")
    return joined.groupBy("output_id", "run_id", "version", "run_project").agg(
        different.alias("related_notes"),
        A.count_where(tier == V.HIT).alias("hit_count"),
        A.count_where(tier == V.MEGA_HIT).alias("mega_count"),
        A.ratio(A.count_where(P.hit(tier)), different).alias("hit_rate"),
    )


def model_comparison(versions: DataFrame, items: DataFrame, notes: DataFrame, without: str = "manual") -> DataFrame:
    """Use and hit rate of each engine in each project, but for the engine of copied-back versions."""
    n, tier = F.count(F.lit(1)), F.col("tier")
    used = versions.where(F.col("engine") != without).join(items.select("item_id"), "item_id")
    return used.join(notes.select("note_id", "project_id", "tier", "interactions"), F.col("item_id") == F.col("note_id")).groupBy("engine", "project_id").agg(
        n.alias("versions_used"),
        A.count_where(tier == V.HIT).alias("hit_count"),
        A.count_where(tier == V.MEGA_HIT).alias("mega_count"),
        F.avg("interactions").alias("avg_interactions"),
        A.ratio(A.count_where(P.hit(tier)), n).alias("hit_rate"),
    )


def pool_saturation(pool: DataFrame, by: str, kind: str, order: list[Column], size: int = 5) -> DataFrame:
    """How far one kind dominates the ``size`` newest rows of each group."""
    top = top_per_group(pool, [by], order, size).select(by, kind)
    largest = top.where(F.col(kind).isNotNull()).groupBy(by, kind).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.max("n").alias("top"))
    whole = top.groupBy(by).agg(F.count(F.lit(1)).cast("int").alias("active_count"), A.sorted_set(F.col(kind)).alias("kinds"))
    most = F.coalesce("top", F.lit(0)).cast("int")
    return whole.join(largest, by, "left").select(
        by, "active_count", "kinds", F.size("kinds").alias("distinct_count"), most.alias("top_count"), F.round(most / F.col("active_count"), 2).alias("dominant_ratio")
    )


def label_accuracy(inferred: DataFrame, actual: DataFrame, groups: DataFrame) -> DataFrame:
    """category, total, matches and accuracy of ``inferred`` labels against the ``lang`` that is so, by the category of their source."""
    right = F.col("inferred") == F.col("lang")
    joined = inferred.join(actual, "doc_id").join(groups, "source")
    return joined.groupBy("category").agg(F.count(F.lit(1)).alias("total"), A.count_where(right).alias("matches"), A.ratio(A.count_where(right), F.count(F.lit(1))).alias("accuracy"))


def ordered(view: DataFrame, by: list[Column]) -> DataFrame:
    """A view's rows in order; ``by`` must end with a key, so that ties have one order."""
    return view.orderBy(*by)
