"""Tables by name, and the canonical frames of the data model bound onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocabulary as V


class Catalog:
    """Frames of one folder of Parquet tables; all are lazy and narrow to what a query uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def lines(self) -> DataFrame:
        """Sums and sorted distinct attributes of each order's lines; cents are added up as whole numbers."""
        items = self.table("lineitem").select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.col("l_quantity").cast("bigint").alias("quantity"))
        parts = self.table("part").select("p_partkey", "p_brand", "p_type")
        return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(
            F.sum("cents").alias("cents"),
            F.sum("quantity").alias("quantity"),
            F.sort_array(F.collect_set("p_brand")).alias("brands"),
            F.sort_array(F.collect_set("p_type")).alias("types"),
        )

    def notes(self) -> DataFrame:
        """One row per post."""
        k, price = F.col("o_orderkey"), F.col("o_totalprice")
        pick = lambda n, *values: F.element_at(F.array(*(F.lit(x) for x in values)), (k % n + 1).cast("int"))
        impressions = F.expr("cents div 100")
        reads = F.col("quantity") * 10
        interactions = F.floor(price / 1000).cast("bigint")
        tier = F.when(k % 11 == 0, None).when(k % 13 == 0, V.REFERENCE).when(price >= 400000, V.MEGA_HIT).when(price >= 250000, V.HIT).when(price >= 100000, V.PRE_HIT).otherwise(V.FLOP)
        source = F.when(k % 19 == 0, None).when(F.col("o_orderstatus") == "O", V.BY_STATUS).when(F.col("o_orderstatus") == "F", V.BY_REMARK).otherwise(V.INFERRED)
        trends = (
            F.when(k % 6 == 0, F.array(F.lit(V.ANY_TREND)))
            .when(k % 6 == 1, F.array(F.lit(V.ERA_LANGUAGE)))
            .when(k % 6 == 2, F.array(F.lit("节日"), F.lit(V.ERA_LANGUAGE)))
            .when(k % 6 == 3, F.array(F.lit("行业事件"), F.lit(None).cast("string")))
            .when(k % 6 == 5, F.array(F.lit("时事热点")))
        )
        customers = self.table("customer").select("c_custkey", "c_mktsegment")
        orders = self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
        return orders.join(self.lines(), k == F.col("l_orderkey"), "left").select(
            k.alias("note_id"),
            F.col("o_custkey").alias("account_id"),
            F.col("c_mktsegment").alias("project_id"),
            F.col("o_orderpriority").alias("lever"),
            pick(3, "positive", "negative", "neutral").alias("valence"),
            pick(4, "low", "medium", "high", None).alias("intensity"),
            pick(5, "traffic", "conversion", "educational", "mixed", None).alias("intent"),
            pick(7, "story", "list", "review", "", "guide", "compare", None).alias("content_format"),
            F.col("o_orderdate").alias("publish_time"),
            impressions.alias("impressions"),
            reads.alias("reads"),
            interactions.alias("interactions"),
            F.when(impressions > 0, reads / impressions).alias("read_rate"),
            F.when(reads > 0, interactions / reads).alias("interaction_rate"),
            tier.alias("tier"),
            source.alias("tier_source"),
            F.concat(F.lit('{"synthetic": '), F.when(k % 17 == 0, "true").otherwise("false"), F.lit("}")).alias("flags"),
            F.coalesce("brands", F.array().cast("array<string>")).alias("target_audience"),
            F.col("types").alias("archetypes"),
            trends.alias("trends"),
            F.when(k % 4 == 0, F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("synced_to_channel1_at"),
            F.when(k % 5 == 0, F.col("o_orderdate") + F.expr("INTERVAL 9 DAYS")).alias("synced_to_channel2_at"),
            F.concat(F.lit("note "), k.cast("string")).alias("raw_content"),
            F.when(k % 23 != 0, F.concat(F.lit("rec"), k.cast("string"))).alias("record_id"),
            (F.col("o_orderdate") + F.expr("INTERVAL 1 DAYS")).alias("ingested_at"),
            (F.col("o_orderdate") + F.expr("INTERVAL 11 DAYS")).alias("updated_at"),
            F.when(k % 5 != 4, F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("annotated_at"),
            F.when(k % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("audience_inferred_at"),
        )

    def projects(self) -> DataFrame:
        """One row per market segment, registered in the order of its first customer."""
        name = F.col("c_mktsegment")
        found = self.table("customer").groupBy(name.alias("project_id")).agg(F.min("c_custkey").alias("created_seq"))
        p = F.col("project_id")
        return found.select(
            "project_id",
            F.concat(F.lit("brand "), p).alias("brand"),
            F.when(p.isin("HOUSEHOLD", "FURNITURE"), "home").otherwise("trade").alias("category"),
            F.lit("xiaohongshu").alias("platform"),
            "created_seq",
            F.when(p != "FURNITURE", F.lit('{"爆": 270, "大爆": 380}')).alias("tier_thresholds"),
            F.when(p != "HOUSEHOLD", F.md5(F.encode(p, "UTF-8"))).alias("channel2_project_id"),
        )

    def accounts(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"))

    def items(self) -> DataFrame:
        """One row per order, in a batch by customer; F was approved, P needs revision."""
        status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "needs_revision").otherwise("pending")
        return self.table("orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("batch_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))

    def versions(self) -> DataFrame:
        """One row per order line; returned lines were written by hand."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("item_id"),
            F.col("l_linenumber").alias("version_num"),
            F.when(F.col("l_returnflag") == "R", "manual").when(F.col("l_returnflag") == "A", "engine_a").otherwise("engine_n").alias("engine"),
            F.when(F.col("l_linestatus") == "F", F.lit(" change this ")).otherwise(F.lit(" ")).alias("feedback"),
        )

    def evaluations(self) -> DataFrame:
        """Line-level verdicts (by flag and supplier group) with the tier that the note later had."""
        lines = self.table("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_suppkey")
        tiers = self.notes().select("note_id", "tier")
        decision = F.when(F.col("l_returnflag") == "R", "reject").when(F.col("l_returnflag") == "A", "pass").otherwise("revise")
        predicted = F.when(F.col("l_linestatus") == "O", V.HIT).otherwise(V.FLOP)
        joined = lines.join(tiers, F.col("l_orderkey") == F.col("note_id"))
        return joined.select(
            F.when(F.col("l_linestatus") == "O", "model").otherwise("human").alias("evaluator_type"),
            (F.col("l_suppkey") % 7).cast("bigint").alias("evaluator_id"),
            decision.alias("decision"),
            F.col("tier").alias("actual_tier"),
            F.when(F.col("tier").isNotNull(), predicted == F.col("tier")).alias("was_correct"),
        )


#: The same frames in the oracle's SQL; a query's text follows after "WITH".
NOTES_SQL = f"""
lines AS (
  SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
    list_sort(list(DISTINCT p_brand)) AS brands, list_sort(list(DISTINCT p_type)) AS types
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
notes AS (
  SELECT o_orderkey AS note_id, o_custkey AS account_id, c_mktsegment AS project_id, o_orderpriority AS lever,
    ['positive', 'negative', 'neutral'][o_orderkey % 3 + 1] AS valence,
    ['low', 'medium', 'high', NULL][o_orderkey % 4 + 1] AS intensity,
    ['traffic', 'conversion', 'educational', 'mixed', NULL][o_orderkey % 5 + 1] AS intent,
    ['story', 'list', 'review', '', 'guide', 'compare', NULL][o_orderkey % 7 + 1] AS content_format,
    o_orderdate AS publish_time, cents // 100 AS impressions, quantity * 10 AS reads,
    CAST(floor(o_totalprice / 1000) AS BIGINT) AS interactions,
    CASE WHEN cents // 100 > 0 THEN quantity * 10 / (cents // 100) END AS read_rate,
    CASE WHEN quantity > 0 THEN floor(o_totalprice / 1000) / (quantity * 10) END AS interaction_rate,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '参考' WHEN o_totalprice >= 400000 THEN '大爆'
      WHEN o_totalprice >= 250000 THEN '爆' WHEN o_totalprice >= 100000 THEN '预备' ELSE '趴' END AS tier,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN '状态字段' WHEN o_orderstatus = 'F' THEN '备注字段' ELSE '数值推断' END AS tier_source,
    o_orderkey % 17 = 0 AS synthetic,
    coalesce(brands, []) AS target_audience, types AS archetypes,
    CASE o_orderkey % 6 WHEN 0 THEN ['通用'] WHEN 1 THEN ['时代语言范式'] WHEN 2 THEN ['节日', '时代语言范式'] WHEN 3 THEN ['行业事件', NULL] WHEN 5 THEN ['时事热点'] END AS trends,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 7 DAY END AS synced_to_channel1_at,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 9 DAY END AS synced_to_channel2_at,
    'note ' || o_orderkey AS raw_content, CASE WHEN o_orderkey % 23 <> 0 THEN 'rec' || o_orderkey END AS record_id,
    o_orderdate + INTERVAL 1 DAY AS ingested_at, o_orderdate + INTERVAL 11 DAY AS updated_at,
    CASE WHEN o_orderkey % 5 <> 4 THEN o_orderdate + INTERVAL 3 DAY END AS annotated_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 5 DAY END AS audience_inferred_at
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lines ON l_orderkey = o_orderkey),
projects AS (
  SELECT c_mktsegment AS project_id, 'brand ' || c_mktsegment AS brand,
    CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'home' ELSE 'trade' END AS category, 'xiaohongshu' AS platform,
    min(c_custkey) AS created_seq, CASE WHEN c_mktsegment <> 'FURNITURE' THEN 270 END AS th_hit, CASE WHEN c_mktsegment <> 'FURNITURE' THEN 380 END AS th_mega,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN md5(c_mktsegment) END AS channel2_project_id
  FROM customer GROUP BY c_mktsegment),
items AS (
  SELECT o_orderkey AS item_id, o_custkey AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'needs_revision' ELSE 'pending' END AS status, o_orderdate AS created_at FROM orders),
versions AS (
  SELECT l_orderkey AS item_id, l_linenumber AS version_num, CASE l_returnflag WHEN 'R' THEN 'manual' WHEN 'A' THEN 'engine_a' ELSE 'engine_n' END AS engine,
    CASE WHEN l_linestatus = 'F' THEN ' change this ' ELSE ' ' END AS feedback FROM lineitem),
evaluations AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'model' ELSE 'human' END AS evaluator_type, CAST(l_suppkey % 7 AS BIGINT) AS evaluator_id,
    CASE l_returnflag WHEN 'R' THEN 'reject' WHEN 'A' THEN 'pass' ELSE 'revise' END AS decision, tier AS actual_tier,
    CASE WHEN tier IS NOT NULL THEN CASE WHEN l_linestatus = 'O' THEN '爆' ELSE '趴' END = tier END AS was_correct
  FROM lineitem JOIN notes ON l_orderkey = note_id)
"""
