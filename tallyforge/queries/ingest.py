"""Sources, configs, dead letters and reports on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..catalog import Catalog
from ..plans import health as H
from ..plans import selection as S
from ..sources import onboarding as O
from ..sources import records as Q
from ..sources.scratch import fresh_path


def _configs(c: Catalog) -> DataFrame:
    """A config for each order: its lines are directions, of which those shipped have a sub-direction."""
    form = F.struct(F.col("l_returnflag").alias("content_format"), F.array(F.col("l_linestatus"), F.col("l_returnflag")).alias("target_audience"))
    way = F.when(F.col("l_linestatus") == "F", F.struct(F.lit("ignored").alias("content_format"), F.lit(None).cast("array<string>").alias("target_audience"), F.array(form).alias("sub_directions"))).otherwise(
        F.struct(form["content_format"].alias("content_format"), form["target_audience"].alias("target_audience"), F.lit(None).cast(f"array<{form_type}>").alias("sub_directions"))
    )
    lines = c.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))
    lines = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("line/"), "l_linenumber").alias("key"), way.alias("value")))).alias("ways"))
    intents = F.create_map(F.lit("traffic"), F.when(F.col("o_orderstatus") == "P", O.PENDING).otherwise("traffic"))
    source = F.when(F.col("o_orderstatus") == "O", V.BY_STATUS).otherwise(F.col("o_orderstatus"))
    config = F.struct(
        F.col("o_orderpriority").alias("category"), intents.alias("intent_mapping"), F.struct(source.alias("source")).alias("tier_extraction"), F.create_map("o_orderpriority", F.lit("raw_content")).alias("field_mapping"), F.col("ways").alias("direction_decomposition")
    )
    return c.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("config_id"), F.to_json(config).alias("config"))


form_type = "struct<content_format:string,target_audience:array<string>>"


def _validated(c: Catalog) -> DataFrame:
    columns = c.table("orders").select(F.col("o_orderkey").alias("config_id"), F.explode(F.array(F.lit("1-URGENT"), F.lit("_record_id"))).alias("column"))
    found = O.validated(_configs(c), {"category": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "content_format": ["A", "N"], "target_audience": ["O", "A", "N", "R"]}, columns)
    return found.select(F.col("config_id").cast("bigint").alias("o_orderkey"), "kind", "path", "value")


def _compared(c: Catalog) -> DataFrame:
    """Each customer's first order against the last: a column for each priority, a direction for each day of the week."""
    priority, day = F.col("o_orderpriority"), F.concat(F.lit("d"), F.dayofweek("o_orderdate").cast("string"))
    config = F.to_json(F.struct(F.col("o_orderstatus").alias("schema_family"), F.create_map(priority, F.lit("raw_content")).alias("field_mapping"), F.create_map(day, F.struct(F.lit("x").alias("content_format"))).alias("direction_decomposition"), F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("t"), F.lit(1))).alias("tier_thresholds")))
    rows = c.table("orders").withColumn("config", config)
    ends = rows.groupBy(F.col("o_custkey").alias("config_id")).agg(F.min_by("config", "o_orderkey").alias("made"), F.max_by("config", "o_orderkey").alias("wanted"))
    found = O.compared(ends.select("config_id", F.col("made").alias("config")), ends.select("config_id", F.col("wanted").alias("config")))
    return found.select(F.col("config_id").cast("bigint").alias("o_custkey"), "part", "side", "item")


def _records(c: Catalog, by: str) -> DataFrame:
    """Orders as records, whose source is the order's ``by``."""
    text = lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    cells = F.map_from_entries(F.array(F.struct(F.lit("body"), text(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))), F.struct(F.lit("state"), text(F.col("o_orderpriority"))), F.struct(F.lit("price"), F.col("o_totalprice").cast("string"))))
    more = F.when(F.col("o_orderkey") % 2 == 0, F.map_concat(cells, F.create_map(F.lit("kind"), text(F.when(F.col("o_orderkey") % 4 == 0, "traffic").otherwise("other kind"))))).otherwise(cells)
    return c.table("orders").select(F.col(by).alias("config_id"), F.col("o_orderkey").cast("string").alias("record_id"), more.alias("fields"))


def _drafted(c: Catalog) -> DataFrame:
    made = O.drafted(_records(c, "o_orderstatus"), {"body": "raw_content", "state": "_status_raw", "kind": "_intent_raw"}, cap=10)
    return O.leaves(made)


def _sampled(c: Catalog) -> DataFrame:
    """The columns that the records of each source hold, and in how many."""
    return Q.fields(_records(c, "o_orderstatus")).select("column", "records", F.array_join("kinds", ";").alias("kinds"))


def _union(c: Catalog) -> DataFrame:
    """Two files of records, of JSON lines and of CSV, as one source."""
    records, lines, table = _records(c, "o_orderstatus"), fresh_path(c.spark), fresh_path(c.spark)
    as_json = F.concat(F.lit('{"record_id": '), F.to_json(F.array("record_id")).substr(F.lit(2), F.length("record_id") + 2), F.lit(', "fields": {'), F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}}"))
    records.where("config_id = 'O'").select(as_json).write.text(lines)
    plain = c.table("orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('", twice')).alias("state"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("account"))
    plain.write.option("header", True).option("escape", '"').csv(table)
    both = Q.union(Q.read_json_lines(c.spark, lines), Q.read_csv(c.spark, "id", table))
    cell = lambda k: F.try_element_at("fields", F.lit(k))
    return both.select(F.col("record_id").cast("bigint").alias("o_orderkey"), F.get_json_object(F.concat(F.lit('{"v":'), cell("state"), F.lit("}")), "$.v").alias("state"), F.regexp_replace(cell("account"), '"', "").cast("bigint").alias("account"))


def _dead(c: Catalog) -> DataFrame:
    """Orders without a known customer, written as dead letters in two batches, the first of which is tried twice."""
    path = fresh_path(c.spark)
    failed = c.table("orders").where("o_custkey % 10 = 0").select("o_orderkey", F.lit("no customer").alias("error"))
    for batch, part in (("even", 0), ("odd", 1), ("even", 0)):
        Q.write_dead_letters(failed.where(F.col("o_orderkey") % 2 == part), path, batch)
    return c.spark.read.schema("o_orderkey long, error string, batch string").json(path)


def _report(c: Catalog) -> DataFrame:
    """A report's lines: how many orders there are of each status."""
    rows = c.table("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy("o_orderstatus")
    lines = H.report(rows, "Orders").split("\n")
    return c.spark.createDataFrame(list(enumerate(lines)), "line int, text string")


def _exit_codes(c: Catalog) -> DataFrame:
    """The exit code of each customer's pass over its orders."""
    outcome = F.when(F.col("o_orderstatus") == "P", "hygiene").when(F.col("o_orderkey") % 5 == 0, "ok").when(F.col("o_orderkey") % 3 == 0, "content").otherwise("systemic")
    return H.exit_codes(c.table("orders").select("o_custkey", outcome.alias("outcome")), ["o_custkey"])


def _due(c: Catalog) -> DataFrame:
    """Which customers a scheduled run takes."""
    interval = F.when(F.col("c_custkey") % 3 == 0, "on_demand").when(F.col("c_custkey") % 3 == 1, "daily")
    return c.table("customer").select("c_custkey", interval.alias("sync_interval")).where(Q.due(F.col("sync_interval"), F.lit(True))).select("c_custkey")


def _threads(c: Catalog) -> DataFrame:
    """Lines as comments that answer their order's first; some answer themselves, each other or none that is there."""
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    child = (key * 10 + n).alias("child")
    first = key * 10 + 1
    parent = F.when(n == 1, F.when(key % 11 == 0, key * 10 + 2)).when((n == 3) & (key % 7 == 0), key * 10 + n).when((n == 4) & (key % 5 == 0), -first).otherwise(first)
    lines = c.table("lineitem").select("l_orderkey", "l_linenumber").distinct().select(child, parent.alias("parent"))
    return S.thread_errors(lines, lines.select(F.col("child").alias("comment_id")))


QUERIES = {
    "c31_validated": _validated,
    "c33_compared": _compared,
    "r26_drafted": _drafted,
    "io5_columns": _sampled,
    "io3_union": _union,
    "io11_dead_letters": _dead,
    "io12_report": _report,
    "r17_exit_codes": _exit_codes,
    "r27_due": _due,
    "c30_threads": _threads,
}

_WAY = "'/direction_decomposition/line~1' || l_linenumber || CASE WHEN l_linestatus = 'F' THEN '/sub_directions/0' ELSE '' END"
ORACLES = {
    "c31_validated": f"""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)
      SELECT o_orderkey, 'error' AS kind, '/category' AS path, o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
      UNION ALL SELECT o_orderkey, 'pending', '/intent_mapping/traffic', '[待确认]' FROM orders WHERE o_orderstatus = 'P'
      UNION ALL SELECT o_orderkey, 'error', '/tier_extraction/source', o_orderstatus FROM orders WHERE o_orderstatus <> 'O'
      UNION ALL SELECT l_orderkey, 'error', {_WAY} || '/content_format', l_returnflag FROM l WHERE l_returnflag NOT IN ('A', 'N')
      UNION ALL SELECT l_orderkey, 'error', {_WAY} || '/target_audience/0', l_linestatus FROM l WHERE l_linestatus NOT IN ('O', 'A', 'N', 'R')
      UNION ALL SELECT o_orderkey, 'uncovered', '', '1-URGENT' FROM orders WHERE o_orderpriority <> '1-URGENT'""",
    "c33_compared": """WITH e AS (SELECT o_custkey, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY o_custkey),
      p AS (SELECT o_orderkey, unnest(['family', 'columns', 'directions']) AS part, unnest([o_orderstatus, o_orderpriority, 'd' || (dayofweek(o_orderdate) + 1)]) AS item FROM orders),
      m AS (SELECT o_custkey, part, item FROM e JOIN p ON o_orderkey = a), w AS (SELECT o_custkey, part, item FROM e JOIN p ON o_orderkey = b)
      SELECT o_custkey, part, 'extra' AS side, item FROM (FROM m EXCEPT FROM w) UNION ALL SELECT o_custkey, part, 'missing', item FROM (FROM w EXCEPT FROM m)
      UNION ALL SELECT o_custkey, 'thresholds', 'missing', NULL FROM e WHERE a % 2 = 1""",
    "r26_drafted": """WITH s AS (SELECT config_id, v, row_number() OVER (PARTITION BY config_id ORDER BY n DESC, v) - 1 AS k FROM (SELECT o_orderstatus AS config_id, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2)),
      c AS (SELECT DISTINCT o_orderstatus AS config_id, o_orderkey % 2 = 0 AS even, o_orderkey % 4 = 0 AS four FROM orders)
      SELECT config_id, '/project_id' AS path, config_id AS value FROM c GROUP BY ALL UNION ALL SELECT config_id, '/field_mapping/body', 'raw_content' FROM c GROUP BY ALL UNION ALL SELECT config_id, '/field_mapping/state', '_status_raw' FROM c GROUP BY ALL
      UNION ALL SELECT config_id, '/field_mapping/kind', '_intent_raw' FROM c WHERE even GROUP BY ALL UNION ALL SELECT config_id, '/project_specific_fields_to_raw_extra/0', 'price' FROM c GROUP BY ALL
      UNION ALL SELECT config_id, CASE WHEN four THEN '/intent_mapping/traffic' ELSE '/intent_mapping/other kind' END, CASE WHEN four THEN 'traffic' ELSE '[待确认]' END FROM c WHERE even GROUP BY ALL
      UNION ALL SELECT config_id, '/tier_extraction/source', '状态字段' FROM c GROUP BY ALL UNION ALL SELECT config_id, '/tier_extraction/rules/' || k || '/match_contains/0', v FROM s
      UNION ALL SELECT config_id, '/tier_extraction/rules/' || k || '/tier', '[待确认]' FROM s UNION ALL SELECT config_id, '/sync_interval', 'on_demand' FROM c GROUP BY ALL""",
    "io5_columns": """SELECT * FROM (SELECT 'body' AS "column", count(*) AS records, 'string' AS kinds FROM orders UNION ALL SELECT 'state', count(*), 'string' FROM orders UNION ALL SELECT 'price', count(*), 'number' FROM orders
      UNION ALL SELECT 'kind', count(*), 'string' FROM orders WHERE o_orderkey % 2 = 0) WHERE records > 0""",
    "io3_union": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'say "' || o_orderpriority || '", twice' END AS state, CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 3 = 0 THEN o_custkey END AS account FROM orders""",
    "io11_dead_letters": "SELECT o_orderkey, 'no customer' AS error, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM orders WHERE o_custkey % 10 = 0",
    "io12_report": """WITH n AS (SELECT o_orderstatus, count(*) AS n, row_number() OVER (ORDER BY o_orderstatus) AS k FROM orders GROUP BY o_orderstatus)
      SELECT 0 AS line, '# Orders' AS text UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| o_orderstatus | n |' UNION ALL SELECT 3, '| --- | --- |' UNION ALL SELECT CAST(3 + k AS INTEGER), '| ' || o_orderstatus || ' | ' || n || ' |' FROM n""",
    "r17_exit_codes": """WITH o AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'hygiene' WHEN o_orderkey % 5 = 0 THEN 'ok' WHEN o_orderkey % 3 = 0 THEN 'content' ELSE 'systemic' END AS outcome FROM orders)
      SELECT o_custkey, CASE WHEN bool_or(outcome = 'hygiene') OR (bool_or(outcome = 'systemic') AND NOT bool_or(outcome = 'ok')) THEN 1 ELSE 0 END AS exit_code FROM o GROUP BY o_custkey""",
    "r27_due": "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0",
    "c30_threads": """WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_orderkey * 10 + l_linenumber AS child FROM lineitem),
      p AS (SELECT child, k, n, CASE WHEN n = 1 THEN CASE WHEN k % 11 = 0 THEN k * 10 + 2 END WHEN n = 3 AND k % 7 = 0 THEN child WHEN n = 4 AND k % 5 = 0 THEN -(k * 10 + 1) ELSE k * 10 + 1 END AS parent FROM l),
      c AS (SELECT k FROM l WHERE k % 11 = 0 GROUP BY k HAVING bool_or(n = 1) AND bool_or(n = 2))
      SELECT child, 'unknown parent' AS error FROM p WHERE parent IS NOT NULL AND parent NOT IN (SELECT child FROM l) UNION ALL SELECT child, 'self loop' FROM p WHERE child = parent
      UNION ALL SELECT child, 'cycle' FROM p JOIN c USING (k) WHERE n = 1 OR parent = k * 10 + 1""",
}
