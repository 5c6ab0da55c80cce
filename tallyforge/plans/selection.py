"""Selections: pools to push, negatives to learn from, thresholds and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import predicates as P
from ..operators import aggregates as A
from ..operators.ranking import diversity_pick, round_robin
from ..sources.scratch import materialised


def push_pool(candidates: DataFrame, per_project: int = 5, quota: int = 5, cap: int = 20, least: float = 0.5) -> DataFrame:
    """Unsynced candidates of ``least`` score: diverse by lever within a project, then projects in turn up to ``cap``."""
    due = candidates.where(F.col("synced_to_channel2_at").isNull() & (F.col("injection_score") >= least))
    diverse = diversity_pick(due, ["project_id"], "lever", [F.desc("injection_score"), F.asc("note_id")], per_project)
    return round_robin(diverse, "project_id", "injection_score", "note_id", quota, cap)


def retire_stale(items: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """``label`` cleared on items older than ``days``."""
    stale = F.col("created_at") < as_of - F.make_dt_interval(F.lit(days))
    return items.withColumn("label", F.when(~F.coalesce(stale, F.lit(False)), F.col("label")))


def selection_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each selected id once, with whether it is in both selections, only the old or only the new."""
    both = old.select(key).distinct().withColumn("o", F.lit(1)).join(new.select(key).distinct().withColumn("n", F.lit(1)), key, "full")
    return both.select(key, F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "old").otherwise("both").alias("side"))


def _first(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("version_num")))


def replaced_by_hand(versions: DataFrame) -> DataFrame:
    """Items whose first manual version has an earlier one that an engine wrote."""
    manual = F.col("engine") == "manual"
    return versions.groupBy("item_id").agg(_first(manual).alias("manual"), _first(~manual).alias("engine")).where(F.col("engine") < F.col("manual")).select("item_id")


def corrected(versions: DataFrame) -> DataFrame:
    """Items whose first engine version with real feedback has any earlier version."""
    told = (F.col("engine") != "manual") & ~P.blank(F.col("feedback"))
    return versions.groupBy("item_id").agg(_first(told).alias("told"), F.min("version_num").alias("first")).where(F.col("first") < F.col("told")).select("item_id")


def revised_in_good_batch(items: DataFrame) -> DataFrame:
    """Items that need revision in a batch that has an approved one."""
    approved = items.where(F.col("status") == "approved").select("batch_id").distinct()
    return items.where(F.col("status") == "needs_revision").join(approved, "batch_id", "left_semi").select("item_id")


def negatives(items: DataFrame, versions: DataFrame, seen: DataFrame) -> DataFrame:
    """item_id and source (A, B or C): each item under the first source that has it, without those seen before.

    A is :func:`replaced_by_hand` and B :func:`corrected`, found in one pass over the
    versions; C is :func:`revised_in_good_batch`.
    """
    manual = F.col("engine") == "manual"
    told = (F.col("engine") != "manual") & ~P.blank(F.col("feedback"))
    firsts = versions.groupBy("item_id").agg(_first(manual).alias("manual"), _first(~manual).alias("engine"), _first(told).alias("told"), F.min("version_num").alias("first"))
    source = F.when(F.col("engine") < F.col("manual"), "A").when(F.col("first") < F.col("told"), "B")
    union = firsts.select("item_id", source.alias("source")).where(F.col("source").isNotNull()).unionByName(revised_in_good_batch(items).withColumn("source", F.lit("C")))
    return union.groupBy("item_id").agg(F.min("source").alias("source")).join(seen.select("item_id"), "item_id", "left_anti")


def recommended_thresholds(notes: DataFrame, current_hit: float, current_mega: float) -> DataFrame:
    """P75 and P90 of each project's interactions as thresholds (halves to even), and their drift."""
    found = A.percentiles(notes.where(F.col("interactions").isNotNull()), ["project_id"], "interactions", [0.5, 0.75, 0.9, 0.95])
    hit, mega = F.bround("p75").cast("bigint"), F.bround("p90").cast("bigint")
    return found.select("project_id", "n", "p50", "p75", "p90", "p95", hit.alias("hit"), mega.alias("mega"), ((hit - current_hit) / current_hit).alias("hit_drift"), ((mega - current_mega) / current_mega).alias("mega_drift"))


def push_eligible(notes: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """Notes to push on the first channel; synthetic ones are only kept out as hits."""
    fresh = F.col("publish_time") >= as_of - F.make_dt_interval(F.lit(days))
    ok = P.one_of(F.col("tier"), V.BORROWABLE) & (F.col("tier_source") != V.INFERRED) & fresh & F.col("synced_to_channel1_at").isNull()
    return notes.where(ok & ~(P.synthetic(F.col("flags")) & P.hit(F.col("tier"))))


def to_retract(notes: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples pushed of notes that have since turned out synthetic hits.

    A sample names its note in ``note_id`` or, if it is old, only under note_id in the JSON
    of its ``lineage``; without such a column only the first counts.
    """
    fake = notes.where(P.synthetic(F.col("flags")) & P.hit(F.col("tier"))).select(F.col("note_id").cast("string").alias("_fake"))
    named = F.col("note_id").cast("string")
    if "lineage" in samples.columns:
        named = F.coalesce(named, F.get_json_object("lineage", "$.note_id"))
    return samples.join(fake, named == F.col("_fake"), "left_semi")


def undecided(items: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Approved and revised items as decisions, but for those that have a human evaluation."""
    decision = F.when(F.col("status") == "approved", "pass").when(F.col("status") == "needs_revision", "revise")
    done = evaluations.where(F.col("evaluator_type") == "human").select("item_id")
    return items.withColumn("decision", decision).where(F.col("decision").isNotNull()).join(done, "item_id", "left_anti").select("item_id", "decision")


#: The parts of a brief that its digest is taken of.
BRIEF_KEYS = (
    "brand", "project_name", "system_prompt", "system_prompt_tone", "system_prompt_exec", "tactics", "calibration_notes",
    "tactic", "key_messages", "target_audience", "tone", "extra_instructions", "draft_topic",
    "consumer", "project_id",
)


def brief_digest(brief: dict[str, Column]) -> Column:
    """First 32 hex digits of SHA-256 over a brief's JSON, its keys sorted and absent ones null.

    ``brief`` holds columns of texts, or of arrays of texts, by key; others are ignored.
    """
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, text), ", "), F.lit("]"))

    def value(key: str) -> Column:
        if key not in brief:
            return F.lit("null")
        c = brief[key]
        return F.coalesce(listed(c) if key in ARRAY_BRIEFS else text(c), F.lit("null"))

    parts = [x for k in sorted(BRIEF_KEYS) for x in (F.lit(f'{", " if k != min(BRIEF_KEYS) else ""}"{k}": '), value(k))]
    return F.left(F.sha2(F.encode(F.concat(F.lit("{"), *parts, F.lit("}")), "UTF-8"), 256), F.lit(32))


#: Parts of a brief that are arrays.
ARRAY_BRIEFS = ("key_messages",)


def library_version(cards: DataFrame, as_of: Column) -> DataFrame:
    """One row, ``version``: how many cards there are, when the last was curated, and the month."""
    last = F.coalesce(F.max("curated_at"), F.lit("none"))
    return cards.agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), last, F.date_format(as_of, "yyyy-MM")).alias("version"))


def cache_key(consumer: Column, project: Column, digest: Column, version: Column) -> Column:
    """Content address of a selection: SHA-256 over consumer, project, brief and library version."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.sha2(F.encode(F.concat_ws("|", text(consumer), text(project), digest, version), "UTF-8"), 256)


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (with ``cache_key``) with the ``selected`` of the cache, null where it has none."""
    return requests.join(cache.select("cache_key", "selected"), "cache_key", "left")


def best_cards(cards: DataFrame, cap: int = 50) -> DataFrame:
    """The ``cap`` curated cards of the highest rank_score (ties by note_id)."""
    return cards.where(F.coalesce("is_curated", F.lit(False))).orderBy(F.desc_nulls_last("rank_score"), "note_id").limit(cap)


def mixed_examples(items: DataFrame, native: int = 2, synced: int = 3, source: str = "library") -> DataFrame:
    """Each project's newest positives, ``native`` of its own before ``synced`` from the library: project_id, item_id, place."""
    own = F.col("external_source").eqNullSafe(source)
    newest = Window.partitionBy("project_id", "from_library").orderBy(F.desc("created_at"), F.desc("item_id"))
    ranked = items.where(F.col("example_label") == "positive").withColumn("from_library", own).withColumn("k", F.row_number().over(newest))
    kept = ranked.where(F.col("k") <= F.when(F.col("from_library"), synced).otherwise(native))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("from_library", "k"))
    return kept.select("project_id", "item_id", place.alias("place"))


def next_job(jobs: DataFrame) -> DataFrame:
    """The queued job that is due: the highest priority, then the oldest."""
    return jobs.where(F.col("status") == "queued").orderBy(F.desc("priority"), "created_at", "job_id").limit(1)


def any_of(df: DataFrame, conditions: list[Column], key: str) -> DataFrame:
    """Keys of the rows that meet any of ``conditions``, each once, in one scan."""
    wanted = F.lit(False)
    for c in conditions:
        wanted = wanted | F.coalesce(c, F.lit(False))
    return df.where(wanted).select(key).distinct()


def flagged(df: DataFrame, flags: str, severity: str) -> DataFrame:
    """Rows whose JSON array ``flags`` holds an object of that severity."""
    found = F.from_json(flags, "array<struct<severity:string>>")
    return df.where(F.exists(F.coalesce(found, F.array().cast("array<struct<severity:string>>")), lambda f: f["severity"].eqNullSafe(severity)))


def prunable(cache: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Cache rows last hit, or never hit and made, more than ``days`` ago."""
    return cache.where(F.coalesce("last_hit_at", "created_at") < as_of - F.make_dt_interval(F.lit(days)))


def reach_estimate(notes: DataFrame) -> DataFrame:
    """Impressions of each project; those without any are estimated by its hits times the mean of a hit."""
    hits = A.count_where(P.real_hit(F.col("tier"), F.col("flags")))
    own = notes.groupBy("project_id").agg(hits.alias("hits"), F.sum("impressions").alias("impressions"))
    per_hit = notes.where(P.real_hit(F.col("tier"), F.col("flags"))).agg(F.avg("impressions").alias("per_hit"))
    guessed = F.coalesce("impressions", F.lit(0)) == 0
    return own.crossJoin(per_hit).select("project_id", "hits", F.when(guessed, F.round(F.col("hits") * F.col("per_hit")).cast("bigint")).otherwise(F.col("impressions")).alias("reach"), guessed.alias("is_estimate"))


def with_project(notes: DataFrame, projects: DataFrame) -> DataFrame:
    """Notes with their project's brand and platform, null where it is unknown."""
    return notes.join(projects.select("project_id", "brand", "platform"), "project_id", "left")


def batch_item_counts(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Items of each wanted batch, in all and by status."""
    status = F.col("status")
    return items.join(batches.select("batch_id").distinct(), "batch_id", "left_semi").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), A.count_where(status == "approved").alias("approved"), A.count_where(status == "pending").alias("pending"), A.count_where(status == "needs_revision").alias("needs_revision")
    )


def queue_health(jobs: DataFrame, as_of: Column, stuck_minutes: int = 30) -> DataFrame:
    """By status: jobs, mean runtime in seconds, those stuck; and the failure rate of all."""
    n = F.count(F.lit(1))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    runtime = (micros("finished_at") - micros("started_at")) / 1e6
    stuck = (F.col("status") == "running") & (F.col("heartbeat_at") < as_of - F.make_dt_interval(mins=F.lit(stuck_minutes)))
    whole = jobs.agg(A.ratio(A.count_where(F.col("status") == "failed"), n).alias("failure_rate"))
    return jobs.groupBy("status").agg(n.alias("jobs"), F.round(F.avg(runtime), 3).alias("avg_runtime"), A.count_where(stuck).alias("stuck")).crossJoin(whole)


def daily_hit_rate(logs: DataFrame, hits: str, total: str) -> DataFrame:
    """By day, the JSON numbers under ``hits`` over those under ``total``, to three places."""
    day = logs.groupBy(F.to_date("created_at").alias("day")).agg(A.json_sum(F.col("output"), hits).alias("hits"), A.json_sum(F.col("output"), total).alias("total"))
    return day.withColumn("hit_rate", F.round(A.ratio(F.col("hits"), F.col("total")), 3))


def restrict(df: DataFrame, members: DataFrame, user: str, workspace: str = "workspace_id") -> DataFrame:
    """Rows of the workspaces that ``user`` belongs to."""
    return df.join(members.where(F.col("user_id") == user).select(workspace).distinct(), workspace, "left_semi")


def thread_errors(links: DataFrame, known: DataFrame) -> DataFrame:
    """child and error of a comment threading: unknown ids, repeated children, self loops and cycles.

    Cycles are found by doubling: after k steps each child knows its ancestor 2^k above; who
    still has one after as many steps as the longest thread can need, is on or under a cycle;
    it ends as soon as nobody has one.
    """
    ids = known.select(F.col("comment_id").alias("id"))
    missing = lambda c: links.where(F.col(c).isNotNull()).join(ids, F.col(c) == F.col("id"), "left_anti").select("child", F.lit(f"unknown {c}").alias("error"))
    repeated = links.groupBy("child").count().where("count > 1").select("child", F.lit("repeated").alias("error"))
    loops = links.where(F.col("child") == F.col("parent")).select("child", F.lit("self loop").alias("error"))
    up = links.where(F.col("parent").isNotNull() & (F.col("child") != F.col("parent"))).select("child", "parent").dropDuplicates(["child"])
    n, step = up.count(), 1
    while step <= n and not up.isEmpty():  # threads are short: most often a few steps leave none
        above = up.select(F.col("child").alias("c"), F.col("parent").alias("grand"))
        up = up.join(above, F.col("parent") == F.col("c")).select("child", F.col("grand").alias("parent"))
        up = materialised(up)
        step *= 2
    return missing("child").unionByName(missing("parent")).unionByName(repeated).unionByName(loops).unionByName(up.select("child", F.lit("cycle").alias("error")))


def top_comments(turns: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` comments of each thread, pinned (system) ones first, in one pass for all threads."""
    own = Window.partitionBy("conv_id").orderBy(F.desc(F.col("role") == "system"), "turn")
    return turns.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k).select("conv_id", "turn", "role", "place")
