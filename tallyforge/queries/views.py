"""The views and dashboards on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import NOTES_SQL, Catalog
from ..plans import dashboards as D
from ..plans import views as W

AS_OF = "2001-08-02 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def annotations(c: Catalog):
    """Every seventh note is curated."""
    return c.notes().where(F.col("note_id") % 7 == 0).select("note_id", F.concat(F.lit("hook "), "lever").alias("hook_type"), F.col("publish_time").alias("curated_at"))


def rates(c: Catalog):
    return W.account_rates(c.accounts(), c.notes())


def candidates(c: Catalog, recency: str = "half_life"):
    return W.injection_candidates(c.notes(), c.projects(), rates(c), as_of(), recency)


def cards(c: Catalog):
    return W.lesson_cards(c.notes(), c.projects(), rates(c), annotations(c), as_of())


def overview(c: Catalog):
    """The annotations are the lessons, and every ninth event a cached selection."""
    return D.overview(c.notes(), c.projects(), annotations(c), c.table("events").where("event_id % 9 = 0"), as_of())


def pulse(c: Catalog):
    events = c.table("events")
    return D.system_pulse(c.notes(), c.projects(), events.select(F.col("ts").alias("collected_at")), events.where("event_id % 5 = 0").select(F.col("ts").alias("occurred_at")), events.where("event_id % 8 = 0"), as_of())


def prompts(c: Catalog):
    outputs = c.table("orders").where(F.col("o_orderkey") % 2 == 0).select((F.col("o_orderkey") % 500).alias("output_id")).distinct().select("output_id", (F.col("output_id") % 20).alias("run_id"), (F.col("output_id") % 3).alias("version"))
    runs = c.projects().select(F.col("created_seq").alias("run_id"), F.col("project_id").alias("run_project"))
    notes = c.notes().select("note_id", "tier", (F.col("note_id") % 600).alias("output_id"))
    return W.prompt_performance(outputs, runs, notes)


QUERIES = {
    "v_project_tier_summary": lambda c: W.project_tier_summary(c.projects(), c.notes()),
    "v_data_health": lambda c: W.data_health(c.projects(), c.notes()),
    "v_account_rates": rates,
    "v_evaluator_calibration": lambda c: W.evaluator_calibration(c.evaluations()),
    "v_sync_status": lambda c: W.sync_status(c.projects(), c.notes(), candidates(c), as_of()),
    "v_injection_candidates": candidates,
    "v_injection_candidates_linear": lambda c: candidates(c, "linear").select("note_id", "recency_weight", "injection_score"),
    "v_lesson_cards": cards,
    "v_tier_discrepancy": lambda c: W.tier_discrepancy(c.notes(), c.projects()),
    "v_prompt_performance": prompts,
    "v_model_comparison": lambda c: W.model_comparison(c.versions(), c.items(), c.notes()),
    "v_pool_saturation": lambda c: W.pool_saturation(c.notes().where(F.col("tier_source") == "状态字段").withColumn("kind", F.when(F.col("note_id") % 3 != 0, F.col("lever"))), "project_id", "kind", [F.desc("publish_time"), F.desc("note_id")]),
    "v_dash_overview": lambda c: overview(c),
    "v_dash_levers": lambda c: D.levers(c.notes()),
    "v_dash_projects": lambda c: D.project_cards(c.notes(), c.projects()),
    "v_dash_matrix": lambda c: D.matrix(c.notes()),
    "v_dash_top_hits": lambda c: D.top_hits(c.notes()),
    "v_dash_lever_perf": lambda c: D.lever_performance(c.notes()),
    "v_dash_valence_matrix": lambda c: D.valence_matrix(c.notes()),
    "v_dash_archetype_perf": lambda c: D.tag_performance(c.notes(), "archetypes", "archetype", 5),
    "v_dash_intent_perf": lambda c: D.intent_performance(c.notes()),
    "v_dash_tier_funnel": lambda c: D.tier_funnel(c.notes()),
    "v_dash_project_perf": lambda c: D.project_performance(c.notes(), c.projects()),
    "v_dash_project_tier": lambda c: D.project_tiers(c.notes()),
    "v_dash_audience_perf": lambda c: D.tag_performance(c.notes(), "target_audience", "audience", 10),
    "v_dash_format_perf": lambda c: D.format_performance(c.notes()),
    "v_dash_reach_concentration": lambda c: D.reach_concentration(c.notes()),
    "v_dash_system_pulse": lambda c: pulse(c),
    "v_dash_monthly": lambda c: D.monthly(c.notes()),
    "v_dash_pub_activity": lambda c: D.publishing_activity(c.notes()),
}

_REAL = "(tier IN ('爆', '大爆') AND NOT synthetic)"
_RATE = f"count(*) FILTER (WHERE {_REAL}) AS hits, round(100.0 * count(*) FILTER (WHERE {_REAL}) / count(*), 1) AS hit_rate"
_INTER = "CAST(round(avg(interactions)) AS INTEGER) AS avg_inter"
_AVG = "round(avg(read_rate), 4) AS read_rate, round(avg(interaction_rate), 4) AS inter_rate"
_VERIFIED = f"({_REAL} AND tier_source = '状态字段')"
_AS_OF = f"TIMESTAMP '{AS_OF}'"
_AGE = f"((epoch_us({_AS_OF}) - epoch_us(publish_time)) / 2592000000000.0)"
_SHORT = "list_has_any(coalesce(trends, []), ['特定平台事件', '特定IP引用', '时事热点', '季节性事件', '节日', '当代流行词'])"
_HALF = f"CASE WHEN coalesce(list_contains(trends, '通用'), false) THEN 60.0 WHEN coalesce(list_contains(trends, '时代语言范式'), false) AND NOT {_SHORT} THEN 30.0 WHEN {_SHORT} THEN 9.0 ELSE 12.0 END"
_BONUS = "CASE tier WHEN '大爆' THEN 0.5 WHEN '爆' THEN 0.3 WHEN '参考' THEN 0.15 ELSE 0 END + CASE WHEN tier_source IN ('状态字段', '备注字段', '人工补录') THEN 0.2 ELSE 0 END + 0.3 * coalesce(personal_rate, 0.3)"
_RATES = """rates AS (
  SELECT account_id, count(*) AS total_notes_count, count(*) FILTER (WHERE tier IN ('爆', '大爆')) AS total_hits,
    CAST(count(*) FILTER (WHERE tier IN ('爆', '大爆')) AS DOUBLE) / nullif(count(tier), 0) AS personal_rate, list_sort(list(DISTINCT project_id)) AS projects_engaged
  FROM notes GROUP BY account_id HAVING count(*) >= 5)"""
_WEIGHTED = {"half_life": f"power(0.5, {_AGE} / ({_HALF}))", "linear": f"greatest(0.0, 1 - {_AGE} * 30 / 365)"}


def _candidates(recency: str) -> str:
    return f"""candidates AS (
  SELECT note_id, project_id, raw_content, tier, tier_source, lever, target_audience, publish_time, synced_to_channel2_at, account_id, brand, category, channel2_project_id,
    {_WEIGHTED[recency]} AS recency_weight, coalesce(personal_rate, 0.3) AS account_rate, {_WEIGHTED[recency]} + {_BONUS} AS injection_score
  FROM notes JOIN projects USING (project_id) LEFT JOIN (SELECT account_id, personal_rate FROM rates) USING (account_id)
  WHERE tier IN ('爆', '大爆', '参考') AND tier_source IS DISTINCT FROM '数值推断' AND publish_time > {_AS_OF} - INTERVAL 1 YEAR AND channel2_project_id IS NOT NULL AND NOT synthetic)"""


_CARDS = f"""cards AS (
  SELECT note_id AS source_note_id, project_id, brand, category, tier, tier_source, publish_time, lever, target_audience, content_format,
    CASE WHEN note_id % 7 = 0 THEN 'hook ' || lever END AS hook_type, CASE WHEN note_id % 7 = 0 THEN publish_time END AS curated_at, note_id % 7 = 0 AS is_curated,
    left(raw_content, 600) AS raw_excerpt, power(0.5, {_AGE} / 60) AS recency_weight, coalesce(personal_rate, 0.3) AS account_rate, power(0.5, {_AGE} / 60) + {_BONUS} AS rank_score, synthetic
  FROM notes JOIN projects USING (project_id) LEFT JOIN (SELECT account_id, personal_rate FROM rates) USING (account_id)
  WHERE tier IN ('爆', '大爆', '参考') AND tier_source IS DISTINCT FROM '数值推断' AND NOT (synthetic AND tier <> '参考'))"""
_IMPLIED = "CASE WHEN interactions >= th_mega THEN '大爆' WHEN interactions >= th_hit THEN '爆' ELSE '趴' END"
_DUE = f"synced_to_channel1_at IS NULL AND tier_source <> '数值推断' AND publish_time >= {_AS_OF} - INTERVAL 1 YEAR"


def _sql(body: str, *more: str) -> str:
    return f"WITH {NOTES_SQL}{''.join(', ' + m for m in more)} {body}"


ORACLES = {
    "v_project_tier_summary": _sql("""SELECT p.project_id, any_value(brand) AS brand, any_value(category) AS category, count(note_id) AS total_notes, count(*) FILTER (WHERE tier = '趴') AS count_flop,
      count(*) FILTER (WHERE tier = '爆') AS count_hit, count(*) FILTER (WHERE tier = '大爆') AS count_mega, count(tier) AS count_labelled, avg(interactions) FILTER (WHERE tier = '爆') AS avg_interactions_hit
      FROM projects p LEFT JOIN notes n ON n.project_id = p.project_id GROUP BY p.project_id"""),
    "v_data_health": _sql("""SELECT p.project_id, any_value(brand) AS brand, count(note_id) AS total, count(impressions) / nullif(count(note_id), 0) AS data_recovery_rate, count(tier) / nullif(count(note_id), 0) AS tier_coverage_rate,
      count(lever) / nullif(count(note_id), 0) AS essence_coverage_rate, count(account_id) / nullif(count(note_id), 0) AS account_link_rate, count(synced_to_channel1_at) AS synced_to_channel1, count(synced_to_channel2_at) AS synced_to_channel2
      FROM projects p LEFT JOIN notes n ON n.project_id = p.project_id GROUP BY p.project_id"""),
    "v_account_rates": _sql("SELECT * FROM rates", _RATES),
    "v_evaluator_calibration": _sql("""SELECT evaluator_type, evaluator_id, count(*) AS total_evaluations, count(*) FILTER (WHERE was_correct) AS correct_predictions, avg(CASE WHEN was_correct THEN 1.0 ELSE 0.0 END) AS accuracy_rate,
      count(*) FILTER (WHERE decision = 'pass' AND actual_tier IN ('爆', '大爆')) / nullif(count(*) FILTER (WHERE decision = 'pass'), 0) AS pass_hit_rate,
      count(*) FILTER (WHERE decision = 'reject' AND actual_tier IN ('爆', '大爆')) / nullif(count(*) FILTER (WHERE decision = 'reject'), 0) AS reject_hit_rate
      FROM evaluations WHERE was_correct IS NOT NULL GROUP BY ALL"""),
    "v_sync_status": _sql(f"""SELECT p.project_id, any_value(p.brand) AS brand, count(*) FILTER (WHERE n.tier IN ('爆', '大爆')) AS total_hits,
      count(*) FILTER (WHERE n.tier IN ('爆', '大爆') AND synced_to_channel1_at IS NOT NULL) AS synced_to_channel1, count(*) FILTER (WHERE n.tier IN ('爆', '大爆') AND n.synced_to_channel2_at IS NOT NULL) AS synced_to_channel2,
      count(*) FILTER (WHERE n.tier IN ('爆', '大爆') AND NOT synthetic AND {_DUE}) AS pending_channel1_sync,
      count(*) FILTER (WHERE n.tier IN ('爆', '大爆') AND i.note_id IS NOT NULL AND n.synced_to_channel2_at IS NULL) AS pending_channel2_sync,
      max(synced_to_channel1_at) FILTER (WHERE n.tier IN ('爆', '大爆')) AS last_hit_sync_to_channel1_at, max(n.synced_to_channel2_at) FILTER (WHERE n.tier IN ('爆', '大爆')) AS last_hit_sync_to_channel2_at,
      count(*) FILTER (WHERE n.tier = '参考') AS total_reference, count(*) FILTER (WHERE n.tier = '参考' AND synced_to_channel1_at IS NOT NULL) AS synced_reference_to_channel1,
      count(*) FILTER (WHERE n.tier = '参考' AND {_DUE}) AS pending_reference_channel1, count(*) FILTER (WHERE n.tier = '参考' AND n.synced_to_channel2_at IS NOT NULL) AS synced_reference_to_channel2,
      count(*) FILTER (WHERE n.tier = '参考' AND i.note_id IS NOT NULL AND n.synced_to_channel2_at IS NULL) AS pending_reference_channel2
      FROM projects p LEFT JOIN notes n ON n.project_id = p.project_id LEFT JOIN (SELECT note_id FROM candidates) i ON i.note_id = n.note_id GROUP BY p.project_id""".replace("AND tier_source", "AND n.tier_source").replace("AND publish_time", "AND n.publish_time"), _RATES, _candidates("half_life")),
    "v_injection_candidates": _sql("SELECT * FROM candidates", _RATES, _candidates("half_life")),
    "v_injection_candidates_linear": _sql("SELECT note_id, recency_weight, injection_score FROM candidates", _RATES, _candidates("linear")),
    "v_lesson_cards": _sql("SELECT * FROM cards", _RATES, _CARDS),
    "v_tier_discrepancy": _sql(f"""SELECT note_id, project_id, tier AS marked_tier, {_IMPLIED} AS implied_tier, tier_source, interactions, CAST(th_hit AS DOUBLE) AS th_hit, CAST(th_mega AS DOUBLE) AS th_mega,
      CASE WHEN synthetic THEN 'true' ELSE 'false' END AS synthetic,
      CASE WHEN tier IN ('爆', '大爆') AND {_IMPLIED} = '趴' THEN 'over_marked' WHEN tier = '大爆' AND {_IMPLIED} = '爆' THEN 'over_marked_soft' WHEN tier = '趴' AND {_IMPLIED} IN ('爆', '大爆') THEN 'under_marked' END AS discrepancy_type
      FROM notes JOIN projects USING (project_id) WHERE tier_source IN ('状态字段', '备注字段') AND th_hit IS NOT NULL AND discrepancy_type IS NOT NULL"""),
    "v_prompt_performance": _sql("""SELECT output_id, run_id, version, run_project, count(DISTINCT note_id) AS related_notes, count(*) FILTER (WHERE tier = '爆') AS hit_count, count(*) FILTER (WHERE tier = '大爆') AS mega_count,
      count(*) FILTER (WHERE tier IN ('爆', '大爆')) / nullif(count(DISTINCT note_id), 0) AS hit_rate
      FROM (SELECT DISTINCT o_orderkey % 500 AS output_id, o_orderkey % 500 % 20 AS run_id, o_orderkey % 500 % 3 AS version FROM orders WHERE o_orderkey % 2 = 0)
      LEFT JOIN (SELECT created_seq AS run_id, project_id AS run_project FROM projects) USING (run_id) LEFT JOIN (SELECT note_id, tier, note_id % 600 AS output_id FROM notes) USING (output_id) GROUP BY ALL"""),
    "v_model_comparison": _sql("""SELECT engine, project_id, count(*) AS versions_used, count(*) FILTER (WHERE tier = '爆') AS hit_count, count(*) FILTER (WHERE tier = '大爆') AS mega_count, avg(interactions) AS avg_interactions,
      count(*) FILTER (WHERE tier IN ('爆', '大爆')) / count(*) AS hit_rate FROM versions JOIN items USING (item_id) JOIN notes ON note_id = item_id WHERE engine <> 'manual' GROUP BY engine, project_id"""),
    "v_pool_saturation": _sql("""SELECT project_id, CAST(count(*) AS INTEGER) AS active_count, list_sort(coalesce(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL), [])) AS kinds, CAST(count(DISTINCT kind) AS INTEGER) AS distinct_count,
      CAST(coalesce(max(n) FILTER (WHERE kind IS NOT NULL), 0) AS INTEGER) AS top_count, round(coalesce(max(n) FILTER (WHERE kind IS NOT NULL), 0) / count(*), 2) AS dominant_ratio
      FROM (SELECT *, count(*) OVER (PARTITION BY project_id, kind) AS n FROM top5) GROUP BY project_id""", """top5 AS (SELECT * FROM (SELECT project_id, CASE WHEN note_id % 3 <> 0 THEN lever END AS kind,
      row_number() OVER (PARTITION BY project_id ORDER BY publish_time DESC, note_id DESC) AS rn FROM notes WHERE tier_source = '状态字段') WHERE rn <= 5)"""),
    "v_dash_overview": _sql(f"""SELECT (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM notes WHERE tier IN ('爆', '大爆')) AS hits_all,
      (SELECT count(*) FROM notes WHERE {_VERIFIED}) AS hits_real, (SELECT count(*) FROM cards) AS borrowable_cards, (SELECT count(*) FROM notes WHERE note_id % 7 = 0) AS cards, (SELECT count(*) FROM events WHERE event_id % 9 = 0) AS librarian, (SELECT count(audience_inferred_at) FROM notes) AS audience_tracked, {_AS_OF} AS as_of, (SELECT count(intent) FROM notes) AS essence_done, (SELECT CAST(sum(impressions) AS BIGINT) FROM notes) AS impressions,
      (SELECT CAST(sum(reads) AS BIGINT) FROM notes) AS reads, (SELECT CAST(sum(interactions) AS BIGINT) FROM notes) AS interactions, (SELECT max(interactions) FROM notes) AS top_interactions,
      (SELECT count(DISTINCT lever) FROM notes WHERE lever <> '') AS levers, (SELECT count(DISTINCT a) FROM (SELECT unnest(target_audience) AS a FROM notes) WHERE a <> '') AS audiences""", _RATES, _CARDS),
    "v_dash_levers": _sql("SELECT lever, count(*) AS n FROM notes WHERE lever <> '' GROUP BY lever"),
    "v_dash_projects": _sql(f"""SELECT project_id, count(*) AS notes, count(*) FILTER (WHERE {_VERIFIED}) AS verified_hits, count(intent) AS essence, CAST(sum(impressions) AS BIGINT) AS impressions, any_value(category) AS category, any_value(seq) AS seq
      FROM notes JOIN (SELECT project_id, category, CAST(row_number() OVER (ORDER BY created_seq) AS INTEGER) AS seq FROM projects) USING (project_id) GROUP BY project_id"""),
    "v_dash_matrix": _sql("SELECT lever, audience, count(*) AS n FROM (SELECT lever, unnest(target_audience) AS audience FROM notes WHERE lever <> '') WHERE audience <> '' GROUP BY ALL"),
    "v_dash_top_hits": _sql(f"SELECT CAST(row_number() OVER (ORDER BY interactions DESC NULLS LAST, note_id) AS INTEGER) AS rank, note_id, project_id, lever, tier, interactions, reads, impressions FROM notes WHERE {_VERIFIED} ORDER BY interactions DESC NULLS LAST, note_id LIMIT 8"),
    "v_dash_lever_perf": _sql(f"SELECT lever, count(*) AS n, {_RATE}, {_INTER} FROM notes WHERE lever <> '' GROUP BY lever HAVING count(*) >= 5"),
    "v_dash_valence_matrix": _sql(f"SELECT valence, intensity, count(*) AS n, {_RATE}, {_INTER} FROM notes WHERE valence IS NOT NULL AND intensity IS NOT NULL GROUP BY ALL"),
    "v_dash_archetype_perf": _sql(f"SELECT archetype, count(*) AS n, {_RATE}, {_INTER} FROM (SELECT *, unnest(archetypes) AS archetype FROM notes) GROUP BY archetype HAVING count(*) >= 5"),
    "v_dash_intent_perf": _sql(f"SELECT intent, count(*) AS n, {_RATE}, {_AVG} FROM notes WHERE intent IS NOT NULL GROUP BY intent"),
    "v_dash_tier_funnel": _sql(f"SELECT tier, count(*) AS n, CAST(round(avg(impressions)) AS INTEGER) AS avg_imp, {_AVG}, {_INTER}, max(interactions) AS max_inter FROM notes WHERE tier IN ('趴', '预备', '爆', '大爆') AND NOT (tier IN ('爆', '大爆') AND synthetic) GROUP BY tier"),
    "v_dash_project_perf": _sql(f"SELECT project_id, category, platform, count(note_id) AS notes, {_RATE}, CAST(round(avg(impressions)) AS INTEGER) AS avg_imp, CAST(sum(impressions) AS BIGINT) AS total_imp, count(*) FILTER (WHERE lever <> '') AS essence FROM notes JOIN projects USING (project_id) GROUP BY ALL"),
    "v_dash_project_tier": _sql("SELECT project_id, tier, count(*) AS n FROM notes WHERE tier IN ('趴', '预备', '爆', '大爆', '风控') AND NOT (tier IN ('爆', '大爆') AND synthetic) GROUP BY ALL"),
    "v_dash_audience_perf": _sql(f"SELECT audience, count(*) AS n, {_RATE}, {_INTER} FROM (SELECT *, unnest(target_audience) AS audience FROM notes) GROUP BY audience HAVING count(*) >= 10"),
    "v_dash_format_perf": _sql(f"SELECT content_format AS fmt, count(*) AS n, {_RATE}, {_INTER} FROM notes WHERE content_format <> '' GROUP BY content_format HAVING count(*) >= 10"),
    "v_dash_reach_concentration": _sql(f"""SELECT max(cnt) AS total_notes, CAST(max(total) AS BIGINT) AS total_imp, round(100.0 * sum(impressions) FILTER (WHERE pct <= 1) / max(total), 1) AS top1_share, round(100.0 * sum(impressions) FILTER (WHERE pct <= 5) / max(total), 1) AS top5_share,
      round(100.0 * sum(impressions) FILTER (WHERE pct <= 10) / max(total), 1) AS top10_share, round(100.0 * sum(impressions) FILTER (WHERE {_REAL}) / max(total), 1) AS hit_reach_share, round(100.0 * count(*) FILTER (WHERE {_REAL}) / max(cnt), 2) AS hit_note_pct
      FROM (SELECT impressions, tier, synthetic, ntile(100) OVER (ORDER BY impressions DESC) AS pct, sum(impressions) OVER () AS total, count(*) OVER () AS cnt FROM notes WHERE impressions > 0)"""),
    "v_dash_system_pulse": _sql("""SELECT (SELECT count(*) FROM notes) AS notes_total, (SELECT max(updated_at) FROM notes) AS last_update, (SELECT max(ingested_at) FROM notes) AS last_ingest, (SELECT count(record_id) FROM notes) AS source_n, (SELECT count(annotated_at) FROM notes) AS annotated_n, (SELECT max(annotated_at) FROM notes) AS annotated_last, (SELECT count(synced_to_channel1_at) FROM notes) AS channel1_n,
      (SELECT max(synced_to_channel1_at) FROM notes) AS channel1_last, (SELECT count(synced_to_channel2_at) FROM notes) AS channel2_n, (SELECT max(synced_to_channel2_at) FROM notes) AS channel2_last, (SELECT count(DISTINCT account_id) FROM notes) AS accounts_n,
      (SELECT count(*) FROM events) AS snaps_n, (SELECT max(ts) FROM events) AS snaps_last, (SELECT count(*) FROM events WHERE event_id % 5 = 0) AS audit_n, (SELECT max(ts) FROM events WHERE event_id % 5 = 0) AS audit_last,
      (SELECT count(*) FROM events WHERE event_id % 8 = 0) AS pipeline_runs_n, TIMESTAMP '2001-08-02 00:00:00' AS server_now, (SELECT count(*) FROM projects) AS projects_n"""),
    "v_dash_monthly": _sql(f"""SELECT strftime(mon, '%Y-%m') AS ym, notes, impressions, hits, CAST(sum(impressions) OVER (ORDER BY mon) AS BIGINT) AS cum_impressions FROM (
      SELECT date_trunc('month', publish_time) AS mon, count(*) AS notes, CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions, count(*) FILTER (WHERE {_REAL}) AS hits FROM notes GROUP BY 1)"""),
    "v_dash_pub_activity": _sql("SELECT strftime(publish_time, '%Y-%m') AS ym, CAST(isodow(publish_time) AS INTEGER) AS dow, count(*) AS n FROM notes GROUP BY ALL"),
}
