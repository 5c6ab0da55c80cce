"""Selections, state, integrity, cleansing and other operators on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocabulary as V
from ..catalog import NOTES_SQL, Catalog
from ..functions import cleanse as C
from ..functions import rules as R
from ..operators import aggregates as A
from ..operators import ranking as K
from ..operators import state as T
from ..plans import selection as S
from .views import _RATES, _candidates, as_of, candidates


def _pushed(c: Catalog):
    return S.push_pool(candidates(c)).select("note_id", "project_id", "lever", "pick", "wave")


def _upsert(c: Catalog):
    """Accounts balances raised for every third customer, and two new customers."""
    old = c.table("customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    more = new.sparkSession.range(1_000_000, 1_000_002).select(F.col("id").alias("c_custkey"), F.lit(5.0).alias("c_acctbal"))
    return T.upsert(old, new.unionByName(more), ["c_custkey"])


def _insert(c: Catalog):
    old = c.table("customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return T.insert_missing(old, c.table("customer").select("c_custkey", F.upper("c_name").alias("c_name")), ["c_custkey"])


def _audit(c: Catalog):
    old = c.table("supplier").where("s_suppkey % 5 <> 0").select("s_suppkey", "s_name", "s_nationkey")
    new = c.table("supplier").where("s_suppkey % 7 <> 0").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 == 0, -1).otherwise(F.col("s_nationkey")).alias("s_nationkey"))
    return T.audit_diff(old, new, "s_suppkey").select(F.col("row_id").alias("s_suppkey"), "operation", F.nullif(F.get_json_object("changed", "$.s_nationkey[0]"), F.lit("null")).alias("old_nation"), F.nullif(F.get_json_object("changed", "$.s_nationkey[1]"), F.lit("null")).alias("new_nation"))


def _violations(c: Catalog):
    notes = c.notes().select("note_id", "tier", "intent", "project_id", "account_id")
    return T.violations(notes, "note_id", {"tier": (V.FLOP, V.HIT, V.MEGA_HIT, V.PRE_HIT)}, ["intent"], [["project_id", "account_id"]]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _jobs(c: Catalog):
    at = F.col("ts")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return c.table("events").select(status.alias("status"), at.alias("started_at"), (at + F.expr("INTERVAL 90 SECONDS")).alias("finished_at"), (at + F.expr("INTERVAL 1 SECOND") * (F.col("event_id") % 600)).alias("heartbeat_at"))


def _pointers(c: Catalog):
    """Orders whose pointed-to line may not exist."""
    orders = c.table("orders").select("o_orderkey", (F.col("o_orderkey") % 9).cast("int").alias("best"))
    return T.reconcile_pointers(orders, c.table("lineitem").select("l_orderkey", "l_linenumber").distinct(), "o_orderkey", "best", "l_orderkey", "l_linenumber")


def _snapshots(c: Catalog):
    """Events of sign-up dates a week apart, by label of their age."""
    rows = c.table("events").select(R.window_label(F.date_trunc("week", "ts"), F.col("ts")).alias("window_label"))
    return rows.groupBy("window_label").agg(F.count(F.lit(1)).alias("n"))


def _cosine(c: Catalog, k: int = 5):
    """The ``k`` nearest vectors by cosine of every hundredth vector; each task keeps k a query before any shuffle."""
    v = c.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return K.nearest_by_cosine(v, v.where("vec_id % 100 = 0"), "vec_id", "x", k)


def _parsed(c: Catalog):
    """Numbers, arrays and dates from cells made of order keys."""
    k = F.col("o_orderkey")
    cell = F.when(k % 5 == 0, '"/"').when(k % 5 == 1, F.concat(F.lit('"'), F.format_number(k, 0), F.lit('"'))).when(k % 5 == 2, k.cast("string")).when(k % 5 == 3, "true").otherwise(F.concat(F.lit('"a, b、'), k.cast("string"), F.lit('/d"')))
    return c.table("orders").select("o_orderkey", C.parse_numeric(cell).alias("number"), F.array_join(C.parse_array(cell), "|").alias("parts"))


QUERIES = {
    "r1_r3_push_pool": _pushed,
    "r5_selection_diff": lambda c: S.selection_diff(c.notes().where("interactions >= 300"), c.notes().where("impressions >= 200000"), "note_id").groupBy("side").agg(F.count(F.lit(1)).alias("n")),
    "r6_replaced_by_hand": lambda c: S.replaced_by_hand(c.versions()),
    "r7_corrected": lambda c: S.corrected(c.versions()),
    "r8_revised_in_good_batch": lambda c: S.revised_in_good_batch(c.items()),
    "u2_negatives": lambda c: S.negatives(c.items(), c.versions(), c.items().where("item_id % 10 = 0")),
    "r9_thresholds": lambda c: S.recommended_thresholds(c.notes(), 250.0, 400.0),
    "r11_push_eligible": lambda c: S.push_eligible(c.notes(), as_of()).select("note_id"),
    "r12_to_retract": lambda c: S.to_retract(c.notes(), c.notes().select("note_id")),
    "r20_reach_estimate": lambda c: S.reach_estimate(c.notes().withColumn("impressions", F.when(F.col("project_id") != "HOUSEHOLD", F.col("impressions")))),
    "v30_batch_item_counts": lambda c: S.batch_item_counts(c.items(), c.items()),
    "v32_duplicate_keys": lambda c: K.duplicates(c.table("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]),
    "v33_queue_health": lambda c: S.queue_health(_jobs(c), F.lit("2024-02-01 00:00:00").cast("timestamp")),
    "v37_newest_per_key": lambda c: K.newest(c.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey"], [F.desc("l_shipdate"), F.desc("l_linenumber")]),
    "s4_top_comments": lambda c: S.top_comments(c.table("conversations")),
    "a12_percentiles": lambda c: A.percentiles(c.table("orders"), ["o_orderpriority"], "o_totalprice", [0.5, 0.75, 0.9, 0.95]),
    "a13_distribution": lambda c: A.distribution(c.table("orders"), ["o_orderstatus", "o_orderpriority"]),
    "a15_upper_median": lambda c: A.upper_median(c.table("orders"), ["o_orderpriority"], "o_totalprice"),
    "a17_json_sum": lambda c: c.table("events").groupBy("event_type").agg(A.json_sum(F.col("props"), "k").alias("k")),
    "j9_orphans": lambda c: T.orphans(c.table("orders"), c.table("customer").where("c_custkey % 4 <> 0"), "o_custkey", "c_custkey").select("o_orderkey"),
    "p16_restricted": lambda c: S.restrict(c.table("customer").select("c_custkey", F.col("c_nationkey").alias("workspace_id")), c.table("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("workspace_id")), 7),
    "c1_c2_cells": _parsed,
    "c19_window_labels": _snapshots,
    "d1_upsert": _upsert,
    "d2_insert_missing": _insert,
    "d5_set_null": lambda c: T.delete_set_null(c.table("orders").select("o_orderkey", "o_custkey"), c.table("customer").where("c_custkey % 10 = 0"), "o_custkey", "c_custkey"),
    "d5_cascade": lambda c: T.delete_cascade(c.table("orders").select("o_orderkey", "o_custkey"), c.table("customer").where("c_custkey % 10 = 0"), "o_custkey", "c_custkey"),
    "d6_violations": _violations,
    "d7_audit_diff": _audit,
    "d9_date_range": lambda c: T.date_range(c.notes(), "project_id", "publish_time"),
    "d11_pointers": _pointers,
    "d12_undecided": lambda c: S.undecided(c.items(), c.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id"), F.lit("human").alias("evaluator_type"))),
    "cosine_top_k": _cosine,
}


def _sql(body: str, *more: str) -> str:
    return f"WITH {NOTES_SQL}{''.join(', ' + m for m in more)} {body}"


_A = "SELECT item_id FROM (SELECT item_id, min(version_num) FILTER (WHERE engine = 'manual') AS m, min(version_num) FILTER (WHERE engine <> 'manual') AS e FROM versions GROUP BY item_id) WHERE e < m"
_B = "SELECT item_id FROM (SELECT item_id, min(version_num) FILTER (WHERE engine <> 'manual' AND trim(feedback) <> '') AS t, min(version_num) AS f FROM versions GROUP BY item_id) WHERE f < t"
_C = "SELECT item_id FROM items WHERE status = 'needs_revision' AND batch_id IN (SELECT batch_id FROM items WHERE status = 'approved')"
_Q = "quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.9) AS p90, quantile_cont({c}, 0.95) AS p95"

ORACLES = {
    "r1_r3_push_pool": _sql(
        """SELECT note_id, project_id, lever, pick, wave FROM (SELECT *, max(injection_score) OVER (PARTITION BY project_id) AS best,
      CAST(row_number() OVER (PARTITION BY project_id ORDER BY injection_score DESC, note_id) AS INTEGER) AS wave FROM picked WHERE pick <= 5) WHERE wave <= 5 ORDER BY wave, best DESC, project_id, note_id LIMIT 20""",
        _RATES, _candidates("half_life"),
        """picked AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY NOT (coalesce(lever, '') = '' OR k = 1), injection_score DESC, note_id) AS INTEGER) AS pick
      FROM (SELECT *, row_number() OVER (PARTITION BY project_id, lever ORDER BY injection_score DESC, note_id) AS k FROM candidates WHERE synced_to_channel2_at IS NULL AND injection_score >= 0.5))""",
    ),
    "r5_selection_diff": _sql("""SELECT side, count(*) AS n FROM (SELECT CASE WHEN interactions >= 300 AND impressions >= 200000 THEN 'both' WHEN interactions >= 300 THEN 'old' WHEN impressions >= 200000 THEN 'new' END AS side FROM notes) WHERE side IS NOT NULL GROUP BY side"""),
    "r6_replaced_by_hand": _sql(_A),
    "r7_corrected": _sql(_B),
    "r8_revised_in_good_batch": _sql(_C),
    "u2_negatives": _sql(f"SELECT item_id, min(source) AS source FROM (SELECT item_id, 'A' AS source FROM ({_A}) UNION ALL SELECT item_id, 'B' FROM ({_B}) UNION ALL SELECT item_id, 'C' FROM ({_C})) WHERE item_id NOT IN (SELECT item_id FROM items WHERE item_id % 10 = 0) GROUP BY item_id"),
    "r9_thresholds": _sql(f"SELECT *, (hit - 250.0::DOUBLE) / 250.0::DOUBLE AS hit_drift, (mega - 400.0::DOUBLE) / 400.0::DOUBLE AS mega_drift FROM (SELECT *, CAST(round_even(p75, 0) AS BIGINT) AS hit, CAST(round_even(p90, 0) AS BIGINT) AS mega FROM (SELECT project_id, count(interactions) AS n, {_Q.format(c='interactions::DOUBLE')} FROM notes GROUP BY project_id))"),
    "r11_push_eligible": _sql("SELECT note_id FROM notes WHERE tier IN ('爆', '大爆', '参考') AND tier_source <> '数值推断' AND publish_time >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY AND synced_to_channel1_at IS NULL AND NOT (synthetic AND tier <> '参考')"),
    "r12_to_retract": _sql("SELECT note_id FROM notes WHERE synthetic AND tier IN ('爆', '大爆')"),
    "r20_reach_estimate": _sql("""SELECT project_id, hits, CASE WHEN coalesce(imp, 0) = 0 THEN CAST(round(hits * per_hit) AS BIGINT) ELSE imp END AS reach, coalesce(imp, 0) = 0 AS is_estimate
      FROM (SELECT project_id, count(*) FILTER (WHERE tier IN ('爆', '大爆') AND NOT synthetic) AS hits, CAST(sum(CASE WHEN project_id <> 'HOUSEHOLD' THEN impressions END) AS BIGINT) AS imp FROM notes GROUP BY project_id),
      (SELECT avg(impressions) AS per_hit FROM notes WHERE tier IN ('爆', '大爆') AND NOT synthetic AND project_id <> 'HOUSEHOLD')"""),
    "v30_batch_item_counts": _sql("SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'needs_revision') AS needs_revision FROM items GROUP BY batch_id"),
    "v32_duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "v33_queue_health": """WITH j AS (SELECT ['queued', 'running', 'done', 'failed'][event_id % 4 + 1] AS status, ts + to_seconds(event_id % 600) AS heartbeat_at FROM events)
      SELECT status, count(*) AS jobs, 90.0::DOUBLE AS avg_runtime, count(*) FILTER (WHERE status = 'running' AND heartbeat_at < TIMESTAMP '2024-02-01' - INTERVAL 30 MINUTE) AS stuck, (SELECT count(*) FILTER (WHERE status = 'failed') / count(*) FROM j) AS failure_rate FROM j GROUP BY status""",
    "v37_newest_per_key": "SELECT l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1",
    "s4_top_comments": "SELECT conv_id, turn, role, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'system') DESC, turn) AS INTEGER) AS place FROM conversations) WHERE place <= 5",
    "a12_percentiles": f"SELECT o_orderpriority, count(o_totalprice) AS n, {_Q.format(c='o_totalprice')} FROM orders GROUP BY o_orderpriority",
    "a13_distribution": """SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM (
      SELECT 'o_orderstatus' AS "column", coalesce(o_orderstatus, '') AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', coalesce(o_orderpriority, ''), count(*) FROM orders GROUP BY ALL)""",
    "a15_upper_median": "SELECT o_orderpriority, o_totalprice AS median FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE k = n // 2 + 1",
    "a17_json_sum": "SELECT event_type, CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS k FROM events GROUP BY event_type",
    "j9_orphans": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)",
    "p16_restricted": "SELECT c_custkey, c_nationkey AS workspace_id FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 7)",
    "c1_c2_cells": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 IN (1, 2) THEN o_orderkey END AS DOUBLE) AS number, CASE o_orderkey % 5 WHEN 1 THEN replace(format('{:,}', o_orderkey), ',', '|') WHEN 2 THEN CAST(o_orderkey AS VARCHAR) WHEN 3 THEN 'True' WHEN 4 THEN 'a|b|' || o_orderkey || '|d' END AS parts FROM orders",
    "c19_window_labels": """SELECT CASE WHEN h < 0 THEN 'ad_hoc' WHEN h < 3 THEN '2h' WHEN h < 36 THEN '24h' WHEN h < 120 THEN '72h' WHEN h < 240 THEN '7d' WHEN h < 504 THEN '14d' WHEN h < 1080 THEN '30d' WHEN h < 8760 THEN 'final' ELSE 'ad_hoc' END AS window_label, count(*) AS n
      FROM (SELECT floor((epoch_us(ts) - epoch_us(date_trunc('week', ts)::TIMESTAMP)) / 3600000000.0) AS h FROM events) GROUP BY 1""",
    "d1_upsert": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT CAST(1000000 + i AS BIGINT), NULL, 5.0 FROM range(2) t(i)",
    "d2_insert_missing": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END AS c_name FROM customer",
    "d5_set_null": "SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS o_custkey FROM orders",
    "d5_cascade": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 <> 0",
    "d6_violations": _sql("""SELECT rule, count(*) AS n FROM (SELECT 'tier: closed set' AS rule FROM notes WHERE tier NOT IN ('趴', '爆', '大爆', '预备') UNION ALL SELECT 'intent: required' FROM notes WHERE intent IS NULL UNION ALL
      SELECT 'project_id, account_id: unique' FROM (SELECT project_id, account_id FROM notes GROUP BY ALL HAVING count(*) > 1)) GROUP BY rule"""),
    "d7_audit_diff": """SELECT s_suppkey, operation, CAST(old_n AS VARCHAR) AS old_nation, CAST(new_n AS VARCHAR) AS new_nation FROM (
      SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'INSERT' WHEN s_suppkey % 7 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS operation, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey END AS old_n,
        CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN -1 ELSE s_nationkey END AS new_n FROM supplier WHERE NOT (s_suppkey % 5 = 0 AND s_suppkey % 7 = 0)) WHERE operation <> 'UPDATE' OR old_n <> new_n""",
    "d9_date_range": _sql("SELECT project_id, min(publish_time) AS start_date, max(publish_time) AS end_date FROM notes GROUP BY project_id"),
    "d11_pointers": """SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 9) THEN CAST(o_orderkey % 9 AS INTEGER) ELSE (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) END AS best FROM orders""",
    "d12_undecided": _sql("SELECT item_id, CASE status WHEN 'approved' THEN 'pass' ELSE 'revise' END AS decision FROM items WHERE status <> 'pending' AND item_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "cosine_top_k": """SELECT query_id, vec_id, CAST(k AS INTEGER) AS rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS k FROM (
      SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)) WHERE k <= 5""",
}
