"""Many projects in one plan, sketches, functions in SQL text and patterns on the given tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..catalog import NOTES_SQL, Catalog
from ..functions import predicates as P
from ..functions import sql as L
from ..operators import state as T
from ..plans.reach import DailySketches
from ..plans.views import label_accuracy
from ..sources import records as Q
from ..sources.projects import transform_all
from ..sources.scratch import fresh_path

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _mapping(i: int, project: str) -> Q.Mapping_:
    """Each project names its columns in its own way; it has thresholds, an excluded direction and a vocabulary of its own."""
    config = {
        "project_id": project,
        "field_mapping": {f"text{i}": "raw_content", f"n{i}": "interactions", "seen": "impressions", f"state{i}": "_status_raw", "kind": "_intent_raw", "way": "_direction_raw"},
        "tier_extraction": {"source": V.BY_STATUS, "rules": [{"match_contains": f"{i + 1}-", "tier": V.HIT}, {"match_contains": ["URGENT", "HIGH"], "tier": V.FLOP}]},
        "intent_mapping": {"F": "traffic", "O": "conversion" if i < 3 else "educational"},
        "excluded_directions": [f"d{i}"],
        "tier_thresholds": {V.HIT: 100_000 * (i + 1), V.MEGA_HIT: 400_000},
    }
    return Q.load_mapping(config, project)


def _many(c: Catalog) -> DataFrame:
    """Orders as records of their customers' segments, ingested under a mapping for each."""
    quoted = lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    i = (F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1).cast("string")
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    cells = [
        entry(F.concat(F.lit("text"), i), quoted(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))),
        entry(F.concat(F.lit("n"), i), quoted(F.format_number("o_totalprice", 2))),
        entry(F.lit("seen"), F.col("o_custkey").cast("string")),
        entry(F.concat(F.lit("state"), i), F.when(F.col("o_orderkey") % 4 != 0, F.to_json(F.array("o_orderpriority")))),
        entry(F.lit("kind"), quoted(F.col("o_orderstatus"))),
        entry(F.lit("way"), quoted(F.concat(F.lit("d"), (F.col("o_orderkey") % 7).cast("string")))),
        entry(F.lit("odd"), F.when(F.col("o_orderkey") % 9 == 0, F.lit("1"))),
    ]
    fields = F.map_from_entries(F.filter(F.array(*cells), lambda e: e["value"].isNotNull()))
    customers = c.table("customer").select("c_custkey", "c_mktsegment")
    records = c.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("project_id"), F.col("o_orderkey").cast("string").alias("record_id"), fields.alias("fields"))
    done = transform_all(records, [_mapping(i, p) for i, p in enumerate(SEGMENTS)])
    return done.select(F.col("record_id").cast("bigint").alias("o_orderkey"), "project_id", "raw_content", "interactions", "impressions", "tier", "tier_source", "intent", F.array_join("undeclared", ";").alias("undeclared"))


def _approximate(c: Catalog) -> DataFrame:
    """Customers of each priority by month: an estimate from daily sketches, made in two rounds, and whether it is within 2 % of the exact number."""
    rows = c.table("orders").select(F.col("o_orderpriority").alias("priority"), "o_orderdate", "o_custkey")
    sketches = DailySketches(c.spark, fresh_path(c.spark), "priority", "o_orderdate", "o_custkey")
    for until in (datetime.date(1997, 6, 30), datetime.date(2100, 1, 1)):
        sketches.refresh(rows, until)
    month = lambda d: F.date_format(d, "yyyy-MM")
    exact = rows.groupBy("priority", month(F.col("o_orderdate")).alias("month")).agg(F.count_distinct("o_custkey").alias("exact"))
    guess = sketches.counts(month(F.col("day"))).withColumnRenamed("period", "month")
    close = F.abs(F.col("estimate") - F.col("exact")) <= 0.02 * F.col("exact")
    return exact.join(guess, ["priority", "month"], "left").select("priority", "month", "exact", F.coalesce(close, F.lit(False)).alias("close"))


def _registered(c: Catalog, user: int) -> None:
    roles = F.when(F.col("s_suppkey") % 3 == 0, "owner").when(F.col("s_suppkey") % 3 == 1, "admin").otherwise("member")
    users = c.table("supplier").select((F.col("s_suppkey") % 10).alias("user_id"), F.col("s_nationkey").cast("bigint").alias("workspace_id"), roles.alias("role"))
    L.register(c.spark, {"workspace_users": users, "items": c.items(), "customers": c.table("customer")}, user)


def _workspaces(c: Catalog) -> DataFrame:
    _registered(c, 7)
    return c.spark.sql("SELECT c_custkey, c_nationkey, is_workspace_admin(c_nationkey) AS admin FROM customers WHERE c_nationkey IN (SELECT workspace_id FROM current_workspace_ids())")


def _batches(c: Catalog) -> DataFrame:
    _registered(c, 7)
    return c.spark.sql("SELECT b.*, c_name FROM batch_item_counts(NULL) b JOIN customers ON batch_id = c_custkey")


def _labels(c: Catalog) -> DataFrame:
    """The quality that labellers gave against a rule of length, by source."""
    docs = c.table("documents").select("doc_id", "source", "n_chars")
    rule = docs.select("doc_id", F.when(F.col("n_chars") >= 1500, "1").otherwise("0").alias("inferred"))
    given = c.table("labels").join(docs, "doc_id").select("doc_id", "source", F.col("quality").cast("string").alias("lang"))
    return label_accuracy(rule, given, docs.select("source").distinct().select("source", F.upper("source").alias("category")))


def _columns(c: Catalog) -> DataFrame:
    """Columns that the events' properties hold or a declaration names, and in how many rows."""
    return T.field_difference(c.table("events").select(F.from_json("props", "map<string,string>").alias("fields")), ["gone"])


def _patterns(c: Catalog) -> DataFrame:
    """Names, brands and types by forms, LIKE patterns and regular expressions, over all parts."""
    parts = c.table("part")
    return parts.select(
        "p_partkey",
        P.matches(F.col("p_partkey").cast("string"), r"^\d+$").alias("number"),
        P.matches(F.col("p_brand"), r"^Brand#[1-3]\d$").alias("low_brand"),
        P.matches(F.col("p_type"), "%s%", like=True).alias("with_s"),
        P.matches(F.when(F.col("p_size") > 20, F.col("p_name")), r"(?i)^[a-m]").alias("early"),
    )


QUERIES = {
    "c10_many_projects": _many,
    "a2_approximate": _approximate,
    "udf_workspaces": _workspaces,
    "udf_batch_item_counts": _batches,
    "v35_label_accuracy": _labels,
    "u4_missing_columns": _columns,
    "p13_patterns": _patterns,
}

_PROJECT = "CASE c_mktsegment " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(SEGMENTS)) + " END"
ORACLES = {
    "c10_many_projects": f"""WITH r AS (SELECT o_orderkey, c_mktsegment AS project_id, o_custkey, o_orderstatus, {_PROJECT} AS i, round(o_totalprice, 2) AS n, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS state FROM orders JOIN customer ON o_custkey = c_custkey),
      t AS (SELECT *, CASE WHEN state IS NULL THEN NULL WHEN starts_with(state, (i + 1) || '-') THEN '爆' WHEN state LIKE '%URGENT%' OR state LIKE '%HIGH%' THEN '趴' END AS told, o_orderkey % 7 = i AS excluded FROM r),
      u AS (SELECT *, CASE WHEN excluded THEN '数据异常' ELSE told END AS told2, CASE WHEN excluded THEN '数据异常' WHEN state IS NOT NULL THEN '状态字段' END AS source FROM t),
      v AS (SELECT *, CASE WHEN told2 IS NULL THEN CASE WHEN n >= 400000 THEN '大爆' WHEN n >= 100000 * (i + 1) THEN '爆' END END AS implied FROM u)
      SELECT o_orderkey, project_id, 'order ' || o_orderkey AS raw_content, n AS interactions, CAST(o_custkey AS DOUBLE) AS impressions, coalesce(implied, told2) AS tier, CASE WHEN implied IS NOT NULL THEN '数值推断' ELSE source END AS tier_source,
        CASE o_orderstatus WHEN 'F' THEN 'traffic' WHEN 'O' THEN CASE WHEN i < 3 THEN 'conversion' ELSE 'educational' END ELSE 'other' END AS intent, CASE WHEN o_orderkey % 9 = 0 THEN 'odd' ELSE '' END AS undeclared FROM v""",
    "a2_approximate": "SELECT o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS exact, true AS close FROM orders GROUP BY 1, 2",
    "udf_workspaces": """WITH w AS (SELECT s_nationkey AS workspace_id, bool_or(s_suppkey % 3 < 2) AS admin FROM supplier WHERE s_suppkey % 10 = 7 GROUP BY 1) SELECT c_custkey, c_nationkey, admin FROM customer JOIN w ON c_nationkey = workspace_id""",
    "udf_batch_item_counts": f"""WITH {NOTES_SQL} SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'needs_revision') AS needs_revision, any_value(c_name) AS c_name
      FROM items JOIN customer ON batch_id = c_custkey GROUP BY batch_id""",
    "v35_label_accuracy": """SELECT upper(source) AS category, count(*) AS total, count(*) FILTER (WHERE quality = CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END) AS matches, count(*) FILTER (WHERE quality = CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END) / count(*) AS accuracy
      FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1""",
    "u4_missing_columns": """WITH k AS (SELECT unnest(json_keys(props)) AS "column" FROM events), n AS (SELECT "column", count(*) AS rows FROM k GROUP BY 1)
      SELECT "column", 'undeclared' AS side, rows FROM n WHERE "column" <> 'gone' UNION ALL SELECT 'gone', 'missing', 0 WHERE NOT EXISTS (FROM n WHERE "column" = 'gone')""",
    "p13_patterns": """SELECT p_partkey, regexp_matches(CAST(p_partkey AS VARCHAR), '^\\d+$') AS number, regexp_matches(p_brand, '^Brand#[1-3]\\d$') AS low_brand, p_type LIKE '%s%' AS with_s, regexp_matches(CASE WHEN p_size > 20 THEN p_name END, '(?i)^[a-m]') AS early FROM part""",
}
