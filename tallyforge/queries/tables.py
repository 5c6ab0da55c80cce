"""Keyed tables, unique indexes, paged sources and copies of table sets on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators.keyed import KeyedTable, UniqueIndex
from ..plans.copying import CopiedTable, Copy
from ..sources import paged
from ..sources.scratch import fresh_path


def _keyed(c: Catalog):
    """Customers as a keyed table: loaded, balances of every tenth raised in a batch that comes twice, two new ones, names filled once, some deleted."""
    own = c.table("customer").select("c_custkey", "c_name", "c_acctbal")
    table = KeyedTable(c.spark, fresh_path(c.spark), ["c_custkey"], own.schema, buckets=16)
    table.merge(own.withColumn("c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name"))), writer="load", number=0)
    more = c.spark.range(1_000_000, 1_000_002).select(F.col("id").alias("c_custkey"), F.lit(5.0).alias("c_acctbal"))
    raised = own.where("c_custkey % 10 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal")).unionByName(more)
    for _ in range(2):
        table.merge(raised, writer="load", number=1)
    table.merge(own.select("c_custkey", F.upper("c_name").alias("c_name")), write_once=["c_name"], writer="load", number=2)
    table.delete(own.where("c_custkey % 11 = 0"), writer="load", number=3)
    return table.read()


def _unique(c: Catalog):
    """One open order a customer and priority: what of the odd orders breaks that, once the even ones are in."""
    orders = c.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    index = UniqueIndex(c.spark, fresh_path(c.spark), "o_orderkey", ["o_custkey", "o_orderpriority"], "o_orderstatus = 'O'", buckets=16)
    index.add(orders.where("o_orderkey % 2 = 0"), "orders", 0)
    return index.violations(orders.where("o_orderkey % 2 = 1")).select(F.col("row").cast("bigint").alias("o_orderkey"), F.col("holder").cast("bigint").alias("holder"))


def _pages(c: Catalog):
    """Orders as records of source tables, one for each status."""
    return c.table("orders").select(F.lower("o_orderstatus").alias("table"), F.format_string("%012d", "o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("account"))


def _paged(c: Catalog):
    path = fresh_path(c.spark)
    paged.write_pages(_pages(c), path)
    records = paged.read(c.spark, path)
    return records.select("table", "page", F.col("record_id").cast("bigint").alias("o_orderkey"), F.expr("fields['account']").cast("bigint").alias("account"), F.expr("substr(fields['priority'], 2, length(fields['priority']) - 2)").alias("priority"))


def _paged_stream(c: Catalog):
    """The same pages as a stream that is stopped after the first source table and goes on when the others are there."""
    path, out, state = fresh_path(c.spark), fresh_path(c.spark), fresh_path(c.spark)
    for tables in (["f"], ["o", "p"]):
        paged.write_pages(_pages(c).where(F.col("table").isin(tables)), path)
        query = paged.stream(c.spark, path).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()
    return c.spark.read.schema(paged.SCHEMA).parquet(out).groupBy("table", "page").agg(F.count(F.lit(1)).alias("records"), F.min(F.col("record_id").cast("bigint")).alias("first"))


TABLES = [CopiedTable("lineitem", ["l_orderkey", "l_linenumber"], {"l_orderkey": "orders"}, 16), CopiedTable("orders", ["o_orderkey"], {"o_custkey": "customer"}, 16), CopiedTable("customer", ["c_custkey"], buckets=16)]


class _Stop(Exception):
    pass


def _copy(c: Catalog) -> Copy:
    """Three tables, of which every tenth customer is missing; the copy is stopped in its second table and run again."""
    columns = {"customer": ["c_custkey", "c_name"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_quantity"]}
    source = lambda name: c.table(name).where("c_custkey % 10 <> 0" if name == "customer" else "true").select(*columns[name])
    path = fresh_path(c.spark)

    def stop(table: str, k: int) -> None:
        if (table, k) == ("orders", 1):
            raise _Stop

    try:
        Copy(c.spark, "move", source, path, TABLES, ranges=3).run(stop)
    except _Stop:
        pass
    copy = Copy(c.spark, "move", source, path, TABLES, ranges=3)
    copy.run()
    return copy


QUERIES = {
    "d1_keyed_table": _keyed,
    "d6_partial_unique": _unique,
    "io1_paged": _paged,
    "io1_paged_stream": _paged_stream,
    "io7_copied_tables": lambda c: _copy(c).reconciled(),
    "io7_quarantined": lambda c: _copy(c).quarantined(),
}

_PAGE = "CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 100 AS INTEGER)"
_LOST = "SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0"

ORACLES = {
    "d1_keyed_table": """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE upper(c_name) END AS c_name, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 11 <> 0
      UNION ALL SELECT CAST(1000000 + i AS BIGINT), NULL, 5.0 FROM range(2) t(i)""",
    "d6_partial_unique": """WITH open AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL),
      held AS (SELECT o_custkey, o_orderpriority, CAST(o_orderkey AS VARCHAR) AS k, o_orderkey % 2 AS odd FROM open),
      h AS (SELECT o_custkey, o_orderpriority, coalesce(min(k) FILTER (WHERE odd = 0), min(k)) AS holder FROM held GROUP BY ALL)
      SELECT o_orderkey, CAST(holder AS BIGINT) AS holder FROM open JOIN h USING (o_custkey, o_orderpriority) WHERE o_orderkey % 2 = 1 AND holder <> CAST(o_orderkey AS VARCHAR)""",
    "io1_paged": f"""SELECT lower(o_orderstatus) AS "table", {_PAGE} AS page, o_orderkey, o_custkey AS account, o_orderpriority AS priority FROM orders""",
    "io1_paged_stream": f"""SELECT "table", page, count(*) AS records, min(o_orderkey) AS first FROM (SELECT lower(o_orderstatus) AS "table", {_PAGE} AS page, o_orderkey FROM orders) GROUP BY ALL""",
    "io7_copied_tables": f"""SELECT 'customer' AS "table", count(*) AS "read", count(*) AS present, CAST(0 AS BIGINT) AS quarantined, CAST(0 AS BIGINT) AS lost FROM customer WHERE c_custkey % 10 <> 0
      UNION ALL SELECT 'orders', count(*), count(*) FILTER (WHERE o_custkey % 10 <> 0), count(*) FILTER (WHERE o_custkey % 10 = 0), 0 FROM orders
      UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (WHERE l_orderkey NOT IN ({_LOST})), count(*) FILTER (WHERE l_orderkey IN ({_LOST})), 0 FROM lineitem""",
    "io7_quarantined": f"""SELECT 'orders' AS "table", '["' || o_orderkey || '"]' AS key, 'no customer' AS reason FROM orders WHERE o_custkey % 10 = 0
      UNION ALL SELECT 'lineitem', '["' || l_orderkey || '","' || l_linenumber || '"]', 'no orders' FROM lineitem WHERE l_orderkey IN ({_LOST})""",
}
