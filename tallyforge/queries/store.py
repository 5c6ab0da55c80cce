"""Health, state, derived figures and passes on the bound tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import NOTES_SQL, Catalog
from ..functions import ids as I
from ..operators import aggregates as A
from ..operators import state as T
from ..plans import annotation as N
from ..plans import derived as E
from ..plans import health as H
from ..plans import selection as S
from ..plans import views as W
from .views import _CARDS, _RATES, AS_OF, ORACLES as VIEWS, QUERIES as VIEW_QUERIES, as_of, cards


def _store(c: Catalog) -> H.Store:
    """The store of the checks: lines are items' versions, suppliers own projects; some links are broken."""
    k = F.col("o_orderkey")
    notes = lambda: c.notes().select(
        "note_id", "tier", "synced_to_channel1_at", "synced_to_channel2_at", F.when(F.col("note_id") % 10 == 0, F.col("note_id") * 2).alias("source_item_id"), F.when(F.col("note_id") % 4 == 0, F.col("note_id")).alias("source_version_id"), F.when(F.col("note_id") % 9 == 0, F.lit(-1)).alias("source_output_id")
    )
    projects = lambda: c.projects().select(
        "project_id", F.when(F.col("project_id") != "HOUSEHOLD", F.col("created_seq") % 7).alias("channel2_project_id"), F.when(F.col("project_id") == "BUILDING", 999_999).alias("channel1_project_id"), F.lit("2001-01-02").alias("start_date"), F.when(F.col("project_id") == "MACHINERY", "2001-01-01").otherwise("2001-01-03").alias("end_date")
    )
    items = lambda: c.table("orders").select(
        k.alias("item_id"), F.col("o_custkey").alias("batch_id"), (F.col("o_custkey") % 10).alias("user_id"), F.when(k % 3 == 0, "library").alias("external_source"), F.when(k % 3 == 0, k % 1000).alias("external_source_id"), F.lit(None).cast("string").alias("example_label_proposal"),
        F.when(k % 8 == 0, "positive").alias("example_label"), F.col("o_orderdate").alias("created_at"),
    )
    batches = lambda: c.table("part").select(F.col("p_partkey").alias("batch_id"), (F.col("p_partkey") % 6).alias("project_id"), F.lit(1).alias("user_id"), F.when(F.col("p_partkey") % 20 == 0, "library_synced").alias("tactic"))
    owners = lambda: c.spark.range(6).select(F.col("id").alias("project_id"), F.when(F.col("id") != 3, F.col("id")).alias("owner_id"))
    samples = lambda: c.table("part").select(
        F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("post_title"), F.when(F.col("p_partkey") % 2 == 0, F.floor(F.col("p_partkey") / 4)).alias("source_note_id"), F.when(F.col("p_partkey") % 5 == 0, "library_sync").otherwise("pack").alias("source_type"), F.array(F.lit("library_sync"), F.lit(None)).alias("tags"),
        F.when(F.col("p_partkey") % 7 == 0, "xiaohongshu").when(F.col("p_partkey") % 7 != 1, "小红书").alias("platform"), F.when(F.col("p_partkey") % 11 == 0, " ").otherwise("x").alias("category"),
    )
    versions = lambda: c.table("lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("version_id"))
    return H.Store({"notes": notes, "projects": projects, "items": items, "batches": batches, "item_projects": owners, "samples": samples, "versions": versions})


def _verify(c: Catalog):
    store = _store(c)
    return H.verify(store, H.state_checks(store)).select("ord", "actual", "expected", "status")


def _audits(c: Catalog):
    return c.table("events").select(F.col("ts").alias("created_at"), F.when(F.col("event_id") % 50 == 0, "completed_warn").otherwise("completed").alias("status"), _hits(F.col("event_id")).alias("output"))


def _hits(k):
    """JSON of an audit whose numbers are sometimes missing or no numbers."""
    return F.concat(F.lit('{"db_sourced": '), F.when(k % 7 == 0, F.lit('"x"')).otherwise((k % 4).cast("string")), F.lit(', "static_sourced": 1, "total_vibe_cells": '), (k % 4 + 2).cast("string"), F.lit("}"))


def _verdict(c: Catalog):
    samples = _store(c)("samples")
    return H.verdict(samples, _audits(c), F.lit("2024-02-01 00:00:00").cast("timestamp"), 7).withColumns({"problems": F.array_join("problems", ";"), "advisories": F.array_join("advisories", ";"), "hit_rate": F.round("hit_rate", 6)})


def _briefs(c: Catalog):
    k = F.col("c_custkey")
    brief = {"brand": F.col("c_name"), "consumer": F.when(k % 2 == 0, F.lit("writer")), "project_id": F.col("c_mktsegment"), "key_messages": F.when(k % 3 == 0, F.array(F.lit("快"), F.lit('a"b'))), "tone": F.lit("x\ny")}
    keyed = c.table("customer").select("c_custkey", brief["consumer"].alias("consumer"), F.col("c_mktsegment").alias("project_id"), S.brief_digest(brief).alias("digest"))
    version = S.library_version(c.notes().select(F.date_format("publish_time", "yyyy-MM-dd").alias("curated_at")), as_of())
    return keyed.crossJoin(version).withColumn("cache_key", S.cache_key(F.col("consumer"), F.col("project_id"), F.col("digest"), F.col("version"))).select("c_custkey", "digest", "version", "cache_key")


def _cache_hits(c: Catalog):
    requests = c.table("customer").select("c_custkey", F.sha2(F.col("c_name"), 256).alias("cache_key"))
    cache = c.table("customer").where("c_custkey % 3 = 0").select(F.sha2(F.col("c_name"), 256).alias("cache_key"), F.lit("[]").alias("selected"))
    return S.cache_hits(requests, cache).select("c_custkey", "selected")


def _picks(c: Catalog):
    picks = c.table("lineitem").select(F.col("l_orderkey").alias("request"), (F.col("l_linenumber") - 1).alias("place"), F.when(F.col("l_linenumber") % 3 == 0, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey")).alias("note_id"))
    known = c.table("part").select(F.col("p_partkey").alias("note_id"), F.col("p_brand").alias("hook_type"))
    return N.picked_cards(picks, known, 3).select("request", "place", "note_id", "hook_type")


def _children(c: Catalog):
    return T.with_parents(c.table("lineitem").select("l_orderkey", "l_linenumber"), c.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


def _updated(c: Catalog):
    return T.update(c.table("supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("s_nationkey") < 5, {"s_name": F.upper("s_name"), "s_nationkey": F.lit(-1)})


def _owners(c: Catalog):
    """Orders without a customer get their batch's."""
    table = c.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("owner"))
    return T.update_from(table, c.table("orders").where("o_orderkey % 3 = 0").select("o_orderkey", (-F.col("o_custkey")).alias("owner")), "o_orderkey", ["owner"])


def _filled(c: Catalog):
    rows = c.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("w")).alias("workspace"), "o_orderstatus")
    return T.fill(rows, "workspace", F.lit("default"), F.col("o_orderstatus") == "F").select("o_orderkey", "workspace")


def _subs(c: Catalog):
    """Sub-directions of notes by lever, chosen by key; every third choice is not an allowed one."""
    allowed = c.spark.createDataFrame([("1-URGENT", "a", "story"), ("1-URGENT", "b", "list"), ("2-HIGH", "c", "review")], "direction string, name string, content_format string")
    notes = N.sub_directions(c.notes().select("note_id", F.col("lever").alias("direction")), allowed)
    chosen = notes.select("note_id", "direction", F.when(F.col("note_id") % 3 == 0, "made up").otherwise(F.element_at("names", (F.col("note_id") % F.size("names") + 1).cast("int"))).alias("name"))
    return N.lift_sub_direction(chosen, allowed, ["content_format"])


def _unthreaded(c: Catalog):
    notes = c.table("orders").select(F.col("o_orderkey").alias("note_id"), F.when(F.col("o_orderkey") % 4 != 0, "block").otherwise(" ").alias("comment_block"))
    comments = c.table("lineitem").select(F.col("l_orderkey").alias("note_id"), F.when(F.col("l_returnflag") == "R", F.lit("p")).alias("parent_comment_id"))
    return N.unthreaded(notes, comments).select("note_id")


def _mixed(c: Catalog):
    items = c.table("orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 4 != 0, "positive").alias("example_label"), F.when(F.col("o_orderkey") % 2 == 0, "library").alias("external_source"), F.col("o_orderdate").alias("created_at"))
    return S.mixed_examples(items)


def _embedded(c: Catalog):
    """Pushed notes with their project's brand and platform, where the project is known."""
    return S.with_project(c.notes().select("note_id", "project_id"), c.projects().where("project_id <> 'BUILDING'"))


def _copied(c: Catalog):
    both, counts = T.copy_missing(c.table("supplier").select("s_suppkey", "s_name"), c.table("supplier").where("s_suppkey % 4 <> 0").select("s_suppkey", F.upper("s_name").alias("s_name")), ["s_suppkey"])
    return both.withColumn("added", F.lit(counts["added"]))


def _quality_flags(c: Catalog):
    flags = F.when(F.col("event_id") % 3 == 0, F.lit('[{"type": "a", "severity": "low"}, {"severity": "high"}]')).when(F.col("event_id") % 3 == 1, F.lit('[{"severity": "medium"}]'))
    return S.flagged(c.table("events").select("event_id", flags.alias("flags")), "flags", "high").select("event_id")


QUERIES = {
    "v31_verify_state": _verify,
    "v36_owner_mismatches": lambda c: H.owner_mismatches(_store(c)("items"), _store(c)("batches"), _store(c)("item_projects"), "library").select("item_id", "user_id", "owner_id"),
    "v34_daily_hit_rate": lambda c: S.daily_hit_rate(_audits(c), "db_sourced", "total_vibe_cells").withColumn("day", F.date_format("day", "yyyy-MM-dd")),
    "r4_retire_stale": lambda c: S.retire_stale(c.table("orders").select("o_orderkey", F.lit("positive").alias("label"), F.col("o_orderdate").alias("created_at")), as_of(), 1800).select("o_orderkey", "label"),
    "r10_saturated_pools": lambda c: H.saturated(VIEW_QUERIES["v_pool_saturation"](c)),
    "r12_to_retract_by_lineage": lambda c: S.to_retract(c.notes(), c.notes().select(F.when(F.col("note_id") % 4 == 0, F.col("note_id")).alias("note_id"), F.concat(F.lit('{"note_id": "'), F.col("note_id").cast("string"), F.lit('"}')).alias("lineage"))).select("lineage"),
    "r13_verdict": _verdict,
    "r14_cache_keys": _briefs,
    "r14_cache_hits": _cache_hits,
    "r15_prunable": lambda c: S.prunable(c.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("last_hit_at"), F.expr("o_orderdate + INTERVAL 900 DAYS").alias("created_at")), as_of(), 400).select("o_orderkey"),
    "r16_distribution": lambda c: A.distribution(c.notes(), ["tier", "tier_source", "intent"], 3),
    "r18_picked_cards": _picks,
    "r19_showcase": lambda c: E.showcase(VIEW_QUERIES["v_dash_overview"](c), c.projects()),
    "r19_ranked_axes": lambda c: E.ranked_axes(VIEW_QUERIES["v_dash_matrix"](c), {"lever": 3, "audience": 4}),
    "r19_stacked_shares": lambda c: E.stacked_shares(VIEW_QUERIES["v_dash_levers"](c), "n"),
    "r19_weekdays": lambda c: E.weekday_totals(VIEW_QUERIES["v_dash_pub_activity"](c)),
    "s7_best_and_worst": lambda c: E.best_and_worst(VIEW_QUERIES["v_dash_project_perf"](c), "project_id", "hit_rate", F.col("notes") > 0),
    "s7_peaks": lambda c: E.peaks(VIEW_QUERIES["v_dash_monthly"](c)),
    "r21_system_status": lambda c: E.system_status(VIEW_QUERIES["v_dash_system_pulse"](c)),
    "r22_unannotated": lambda c: N.unannotated(c.notes()).select("note_id"),
    "r23_sub_directions": _subs,
    "r24_uncurated": lambda c: N.uncurated(cards(c).withColumn("note_id", F.col("source_note_id")), 15).select("note_id"),
    "r25_unthreaded": _unthreaded,
    "f_id_uuid5": lambda c: c.table("customer").select("c_custkey", I.uuid5(uuid.NAMESPACE_URL, F.when(F.col("c_custkey") % 9 != 0, F.col("c_name"))).alias("id")),
    "d3_with_parents": _children,
    "d4_update": _updated,
    "d10_pending": lambda c: H.pending_annotations(c.notes()),
    "d14_fill": _filled,
    "j14_with_project": _embedded,
    "j18_update_from": _owners,
    "io7_copy_missing": _copied,
    "p10_flagged": _quality_flags,
    "s1_ordered": lambda c: W.ordered(VIEW_QUERIES["v_account_rates"](c), [F.desc_nulls_last("personal_rate"), F.asc("account_id")]).select("account_id", "personal_rate"),
    "s3_best_cards": lambda c: S.best_cards(cards(c).withColumn("note_id", F.col("source_note_id"))).select("note_id"),
    "s5_mixed_examples": _mixed,
    "s6_next_job": lambda c: S.next_job(c.table("events").select(F.col("event_id").alias("job_id"), (F.col("user_id") % 5).alias("priority"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, "queued").otherwise("done").alias("status"))).select("job_id"),
    "u5_any_of": lambda c: S.any_of(c.notes(), [F.col("lever") == "1-URGENT", F.array_contains("trends", "节日")], "note_id"),
}


def _sql(body: str, *more: str) -> str:
    return f"WITH {NOTES_SQL}{''.join(', ' + m for m in more)} {body}"


_STORE = """
  k_notes AS (SELECT o_orderkey AS note_id, o_custkey FROM orders),
  i AS (SELECT o_orderkey AS item_id, o_custkey AS batch_id, o_custkey % 10 AS user_id, o_orderkey % 3 = 0 AS lib, o_orderkey % 8 = 0 AS pos FROM orders),
  b AS (SELECT p_partkey AS batch_id, p_partkey % 6 AS project_id FROM part),
  wrong AS (SELECT item_id, user_id, project_id AS owner_id FROM i JOIN b USING (batch_id) WHERE lib AND project_id <> 3 AND project_id <> user_id)"""
_TRUE = ("01", "02", "03", "11", "12", "13", "21", "22", "23", "24", "31", "32", "41", "42", "43")


def _state(ord_: str, actual: str, expected: str) -> str:
    return f"SELECT '{ord_}' AS ord, CAST({actual} AS VARCHAR) AS actual, '{expected}' AS expected"


_CHECKS = " UNION ALL ".join(
    [_state(x, "'true'", "true") for x in _TRUE]
    + [_state(x, "'N/A'", y) for x, y in (("71", "0"), ("82", "0"))]
    + [
        _state("14", "'false'", "true"),
        _state("15", "'false'", "true"),
        _state("25", "(SELECT count(*) > 0 FROM (SELECT o_orderkey % 1000 FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1 HAVING count(*) > 1))", "true"),
        _state("26", "(SELECT count(*) = 0 FROM (SELECT o_custkey % 10, o_orderkey % 1000 FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL HAVING count(*) > 1))", "true"),
        _state("44", "(SELECT count(*) = 0 FROM (SELECT p_partkey // 4 FROM part WHERE p_partkey % 2 = 0 GROUP BY 1 HAVING count(*) > 1))", "true"),
        _state("45", "(SELECT count(*) FROM (SELECT p_partkey // 4 FROM part WHERE p_partkey % 2 = 0 GROUP BY 1 HAVING count(*) > 1))", "0"),
        _state("51", "(SELECT count(*) FROM notes WHERE tier IN ('爆', '大爆'))", "> 0"),
        _state("52", "(SELECT count(synced_to_channel1_at) FROM notes)", "> 0"),
        _state("53", "(SELECT count(synced_to_channel2_at) FROM notes)", "> 0"),
        _state("54", "(SELECT count(*) FROM part WHERE p_partkey % 5 <> 0)", "own and synced ones"),
        _state("55", "(SELECT count(*) FROM part WHERE p_partkey % 5 = 0)", "0"),
        _state("56", "(SELECT count(*) FROM part WHERE p_partkey % 7 = 0)", "0"),
        _state("57", "(SELECT count(*) FROM i WHERE lib)", "> 0"),
        _state("58", "(SELECT count(*) FROM wrong)", "0"),
        _state("59", "(SELECT count(*) FROM part WHERE p_partkey % 20 = 0)", "as many as synced projects"),
        _state("60", "(SELECT count(*) FROM i WHERE pos)", "> 0"),
        _state("70", "(SELECT count(*) FROM projects WHERE project_id <> 'HOUSEHOLD' AND created_seq % 7 IN (3, 6))", "0"),
        _state("80", "(SELECT count(*) FROM k_notes WHERE note_id % 10 = 0 AND note_id * 2 NOT IN (SELECT item_id FROM i))", "0"),
        _state("81", "(SELECT count(*) FROM k_notes WHERE note_id % 4 = 0 AND note_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2))", "0"),
        _state("90", "(SELECT count(*) FROM projects WHERE project_id = 'MACHINERY')", "0"),
    ]
)
_VERIFY = f"""SELECT *, CASE WHEN actual = expected THEN 'pass' WHEN actual = 'N/A' THEN 'unknown' WHEN expected = '> 0' AND TRY_CAST(actual AS BIGINT) > 0 THEN 'pass'
  WHEN expected = '0' AND TRY_CAST(actual AS BIGINT) > 0 THEN 'backfill' WHEN actual = 'false' THEN 'fail' ELSE 'look' END AS status FROM ({_CHECKS})"""
_AUDITS = """audits AS (SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 4 END AS db, event_id % 4 + 2 AS cells, event_id % 50 = 0 AS warned FROM events)"""
_BRIEF = """'{"brand": "' || c_name || '", "calibration_notes": null, "consumer": ' || CASE WHEN c_custkey % 2 = 0 THEN '"writer"' ELSE 'null' END || ', "draft_topic": null, "extra_instructions": null, "key_messages": '
  || CASE WHEN c_custkey % 3 = 0 THEN '["快", "a\\"b"]' ELSE 'null' END || ', "project_id": "' || c_mktsegment || '", "project_name": null, "system_prompt": null, "system_prompt_exec": null, "system_prompt_tone": null, "tactic": null, "tactics": null, "target_audience": null, "tone": "x\\ny"}'"""
_OVERVIEW, _MATRIX, _ACTIVITY, _MONTHLY, _PERF, _LEVERS, _POOL, _PULSE, _ACCOUNTS = (
    VIEWS[f"v_{n}"] for n in ("dash_overview", "dash_matrix", "dash_pub_activity", "dash_monthly", "dash_project_perf", "dash_levers", "pool_saturation", "dash_system_pulse", "account_rates")
)
_AT = f"TIMESTAMP '{AS_OF}'"

ORACLES = {
    "v31_verify_state": _sql(_VERIFY, _STORE),
    "v36_owner_mismatches": f"WITH {_STORE} SELECT item_id, user_id, owner_id FROM wrong",
    "v34_daily_hit_rate": f"WITH {_AUDITS} SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(db) AS BIGINT) AS hits, CAST(sum(cells) AS BIGINT) AS total, round(CAST(sum(db) AS DOUBLE) / sum(cells), 3) AS hit_rate FROM audits GROUP BY 1",
    "r4_retire_stale": f"SELECT o_orderkey, CASE WHEN NOT o_orderdate < {_AT} - INTERVAL 1800 DAY THEN 'positive' END AS label FROM orders",
    "r10_saturated_pools": f"SELECT *, coalesce(dominant_ratio >= 0.6, false) AS saturated FROM ({_POOL})",
    "r12_to_retract_by_lineage": _sql("""SELECT '{"note_id": "' || note_id || '"}' AS lineage FROM notes WHERE synthetic AND tier IN ('爆', '大爆')"""),
    "r13_verdict": f"""WITH {_AUDITS}, a AS (SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') AS audit_rows, CAST(coalesce(sum(db) FILTER (WHERE ts >= TIMESTAMP '2024-01-25'), 0) AS BIGINT) AS db_sourced,
        count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') AS static_sourced, CAST(coalesce(sum(cells) FILTER (WHERE ts >= TIMESTAMP '2024-01-25'), 0) AS BIGINT) AS total_vibe_cells, count(*) FILTER (WHERE warned AND ts >= TIMESTAMP '2024-01-31') AS warnings FROM audits),
      s AS (SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey % 2 = 0) AS synced, count(*) FILTER (WHERE p_partkey % 2 = 0 AND (p_partkey % 7 = 1 OR p_partkey % 11 = 0)) AS unreachable FROM part),
      r AS (SELECT *, round(CAST(db_sourced AS DOUBLE) / nullif(total_vibe_cells, 0), 6) AS hit_rate FROM s, a)
      SELECT *, array_to_string(list_filter([CASE WHEN hit_rate < 0.3 THEN 'hit rate' END, CASE WHEN warnings > 0 THEN 'warnings' END, CASE WHEN unreachable > 0 THEN 'unreachable samples' END], lambda x: x IS NOT NULL), ';') AS problems,
        array_to_string(list_filter([CASE WHEN synced = 0 THEN 'nothing synced' END, CASE WHEN audit_rows = 0 THEN 'nothing audited' END], lambda x: x IS NOT NULL), ';') AS advisories, NOT (coalesce(hit_rate < 0.3, false) OR warnings > 0 OR unreachable > 0) AS healthy FROM r""",
    "r14_cache_keys": f"""WITH v AS (SELECT count(*) || ':' || coalesce(max(strftime(o_orderdate, '%Y-%m-%d')), 'none') || ':2001-08' AS version FROM orders), d AS (SELECT c_custkey, c_mktsegment, left(sha256({_BRIEF}), 32) AS digest FROM customer)
      SELECT c_custkey, digest, version, sha256(CASE WHEN c_custkey % 2 = 0 THEN 'writer' ELSE 'None' END || '|' || c_mktsegment || '|' || digest || '|' || version) AS cache_key FROM d, v""",
    "r14_cache_hits": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '[]' END AS selected FROM customer",
    "r15_prunable": f"SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 900 DAY END < {_AT} - INTERVAL 400 DAY",
    "r16_distribution": _sql(
        """SELECT "column", value, n, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k FROM (SELECT 'tier' AS "column", coalesce(tier, '') AS value, count(*) AS n FROM notes GROUP BY ALL
      UNION ALL SELECT 'tier_source', coalesce(tier_source, ''), count(*) FROM notes GROUP BY ALL UNION ALL SELECT 'intent', coalesce(intent, ''), count(*) FROM notes GROUP BY ALL)) WHERE k <= 3"""
    ),
    "r18_picked_cards": "SELECT l_orderkey AS request, l_linenumber - 1 AS place, l_partkey AS note_id, p_brand AS hook_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3 AND l_linenumber % 3 <> 0",
    "r19_showcase": f"""SELECT round(100.0 * hits_real / notes, 1) AS hit_rate, notes * 14 AS inferences, levers * audiences * 19 AS strategy_space, c * (c - 1) AS transfer_paths, impressions + reads + interactions * 50 AS signal_flux
      FROM ({_OVERVIEW}), (SELECT count(DISTINCT CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'home' ELSE 'trade' END) AS c FROM customer)""",
    "r19_ranked_axes": f"""WITH m AS ({_MATRIX}), t AS (SELECT 'lever' AS axis, lever AS name, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY ALL UNION ALL SELECT 'audience', audience, CAST(sum(n) AS BIGINT) FROM m GROUP BY ALL)
      SELECT axis, name, n, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY n DESC, name) AS k FROM t) WHERE k <= CASE axis WHEN 'lever' THEN 3 ELSE 4 END""",
    "r19_stacked_shares": f"SELECT lever, n, round(100.0 * n / sum(n) OVER (), 1) AS share FROM ({_LEVERS})",
    "r19_weekdays": f"SELECT CAST(d AS INTEGER) AS dow, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM range(1, 8) r(d) LEFT JOIN ({_ACTIVITY}) a ON a.dow = d GROUP BY d",
    "s7_best_and_worst": f"WITH p AS ({_PERF}) SELECT (SELECT project_id FROM p ORDER BY hit_rate DESC, project_id LIMIT 1) AS best, (SELECT project_id FROM p ORDER BY hit_rate, project_id LIMIT 1) AS worst, max(hit_rate) AS most, min(hit_rate) AS least, CASE WHEN min(hit_rate) > 0 THEN CAST(round(max(hit_rate) / min(hit_rate)) AS BIGINT) END AS ratio FROM p",
    "s7_peaks": f"WITH m AS ({_MONTHLY}) SELECT (SELECT ym FROM m ORDER BY impressions DESC, ym LIMIT 1) AS peak_impressions, (SELECT ym FROM m ORDER BY hits DESC, ym LIMIT 1) AS peak_hits",
    "r21_system_status": f"""WITH p AS ({_PULSE}), s AS (SELECT unnest([
        {{'name': 'source table', 'n': source_n, 'at': last_ingest::TIMESTAMP}}, {{'name': 'annotation', 'n': annotated_n, 'at': annotated_last::TIMESTAMP}}, {{'name': 'metric snapshots', 'n': snaps_n, 'at': snaps_last::TIMESTAMP}},
        {{'name': 'sample channel', 'n': channel1_n, 'at': channel1_last::TIMESTAMP}}, {{'name': 'writing channel', 'n': channel2_n, 'at': channel2_last::TIMESTAMP}}, {{'name': 'telemetry', 'n': pipeline_runs_n, 'at': NULL::TIMESTAMP}}, {{'name': 'distribution', 'n': NULL, 'at': NULL::TIMESTAMP}}], recursive := true) FROM p)
      SELECT name, CASE WHEN n IS NULL THEN 'planned' WHEN n > 0 THEN 'live' ELSE 'wired' END AS state, n, "at" FROM s""",
    "r22_unannotated": _sql("SELECT note_id FROM notes WHERE note_id % 5 = 4"),
    "r23_sub_directions": _sql("""SELECT note_id, direction_subtype, CASE direction_subtype WHEN 'a' THEN 'story' WHEN 'b' THEN 'list' ELSE 'review' END AS content_format FROM (
      SELECT note_id, CASE lever WHEN '1-URGENT' THEN ['a', 'b'][note_id % 2 + 1] ELSE 'c' END AS direction_subtype FROM notes WHERE lever IN ('1-URGENT', '2-HIGH') AND note_id % 3 <> 0)"""),
    "r24_uncurated": _sql("SELECT source_note_id AS note_id FROM cards WHERE NOT is_curated ORDER BY rank_score DESC, source_note_id LIMIT 15", _RATES, _CARDS),
    "r25_unthreaded": "SELECT l_orderkey AS note_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 4 <> 0 GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') = 0",
    "f_id_uuid5": """SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN left(h, 8) || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(instr('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] END AS id
      FROM (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)""",
    "d3_with_parents": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "d4_update": "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN upper(s_name) ELSE s_name END AS s_name, CASE WHEN s_nationkey < 5 THEN -1 ELSE s_nationkey END AS s_nationkey FROM supplier",
    "d10_pending": _sql("SELECT project_id, count(*) AS notes, count(*) FILTER (WHERE annotated_at IS NULL) AS pending FROM notes GROUP BY project_id"),
    "d14_fill": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'w' WHEN o_orderstatus = 'F' THEN 'default' END AS workspace FROM orders",
    "j14_with_project": _sql("SELECT note_id, notes.project_id, brand, platform FROM notes LEFT JOIN (SELECT * FROM projects WHERE project_id <> 'BUILDING') p ON notes.project_id = p.project_id"),
    "j18_update_from": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey WHEN o_orderkey % 3 = 0 THEN -o_custkey END AS owner FROM orders",
    "io7_copy_missing": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE upper(s_name) END AS s_name, CAST((SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 0) AS INTEGER) AS added FROM supplier",
    "p10_flagged": "SELECT event_id FROM events WHERE event_id % 3 = 0",
    "s1_ordered": f"SELECT account_id, personal_rate FROM ({_ACCOUNTS}) ORDER BY personal_rate DESC NULLS LAST, account_id",
    "s3_best_cards": _sql("SELECT source_note_id AS note_id FROM cards WHERE is_curated ORDER BY rank_score DESC, source_note_id LIMIT 50", _RATES, _CARDS),
    "s5_mixed_examples": """SELECT project_id, item_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY lib, k) AS INTEGER) AS place FROM (SELECT o_custkey AS project_id, o_orderkey AS item_id, o_orderkey % 2 = 0 AS lib,
      row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderkey % 4 <> 0) WHERE k <= CASE WHEN lib THEN 3 ELSE 2 END""",
    "s6_next_job": "SELECT event_id AS job_id FROM events WHERE event_id % 3 = 0 ORDER BY user_id % 5 DESC, ts, event_id LIMIT 1",
    "u5_any_of": _sql("SELECT note_id FROM notes WHERE lever = '1-URGENT' OR list_contains(trends, '节日')"),
}
