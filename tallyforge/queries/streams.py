"""Streams over files of the events table: each runs twice on one checkpoint, the second time from where the first stopped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators.keyed import KeyedTable
from ..sources.scratch import fresh_path
from ..streaming import cache
from ..streaming import windows as W

#: Where the files are parted in two: those of the second half come after the first run.
HALF = "2024-01-15 12:00:00"


def _twice(c: Catalog, plan: Callable[..., DataFrame], put: Callable[[DataFrame, str], object], columns: Sequence[str], more: Callable[[DataFrame], DataFrame] = lambda d: d, streams: int = 1, settings: Sequence[tuple[str, str]] = ()) -> None:
    """Start ``plan`` of file streams of the events' ``columns`` on the first half, and again when the second is there."""
    spark, folder, state = c.spark, fresh_path(c.spark), fresh_path(c.spark)
    events = more(c.table("events").withColumn("ts", F.col("ts").cast("timestamp")).select(*columns))
    for half in (F.col("ts") < F.lit(HALF).cast("timestamp"), F.col("ts") >= F.lit(HALF).cast("timestamp")):
        events.where(half).repartition(3).write.mode("append").parquet(folder)
        running = plan(*(spark.readStream.schema(events.schema).parquet(folder) for _ in range(streams)))
        query = _started(spark, put(running, state), settings)
        query.awaitTermination()


def _started(spark: SparkSession, writer, settings: Sequence[tuple[str, str]]):
    """A query keeps the settings of the moment it starts; the session's are put back."""
    before = {k: spark.conf.get(k, None) for k, _ in settings}
    try:
        for k, v in settings:
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _to_files(c: Catalog, plan: Callable[..., DataFrame], columns: Sequence[str], schema: str, **how) -> DataFrame:
    out = fresh_path(c.spark)
    put = lambda d, state: d.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
    _twice(c, plan, put, columns, **how)
    return _zoneless(c.spark.read.schema(schema).parquet(out))


def _zoneless(df: DataFrame) -> DataFrame:
    """Moments as the table has them, without a zone."""
    return df.select(*(F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else f.name for f in df.schema.fields))


def _windows(c: Catalog) -> DataFrame:
    n = [F.count(F.lit(1)).alias("n"), F.max("value").alias("most")]
    return _to_files(c, lambda e: W.windowed(e, "ts", ["event_type"], n, "1 hour"), ["ts", "event_type", "value"], "window_start timestamp, window_end timestamp, event_type string, n long, most double")


def _sessions(c: Catalog) -> DataFrame:
    n = [F.count(F.lit(1)).alias("n")]
    return _to_files(c, lambda e: W.sessions(e, "ts", ["user_id"], "2 hours", n), ["ts", "user_id"], "session_start timestamp, session_end timestamp, user_id long, n long")


def _dedup(c: Catalog) -> DataFrame:
    """Every event is sent twice."""
    twice = lambda d: d.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return _to_files(c, lambda e: W.deduplicated(e, "ts", ["event_id"]), ["ts", "event_id", "user_id"], "ts timestamp, event_id long, user_id long", more=twice).select("event_id", "user_id")


def _joined(c: Catalog) -> DataFrame:
    def plan(a: DataFrame, b: DataFrame) -> DataFrame:
        views = a.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("viewed_at"))
        bought = b.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("bought_at"))
        return W.interval_join(views, bought, "viewed_at", "bought_at", F.col("viewer") == F.col("user_id"), "1 day").select("view_id", "purchase_id", "user_id")

    return _to_files(c, plan, ["ts", "event_id", "user_id", "event_type"], "view_id long, purchase_id long, user_id long", streams=2)


def _requests(e: DataFrame) -> DataFrame:
    return e.select(F.concat_ws(":", "user_id", "event_type").alias("cache_key"), F.col("ts").alias("at"))


TTL = 2 * 86_400


def _cached(c: Catalog) -> DataFrame:
    found = _to_files(c, lambda e: cache.cached_requests(_requests(e), TTL), ["ts", "user_id", "event_type"], cache.OUTCOMES, settings=[cache.ROCKS])
    return found.select("cache_key", F.col("at").alias("moment"), "outcome", "hits")


def _written_back(c: Catalog) -> DataFrame:
    """The cache's entries after all requests, as each batch has written them back."""
    table = KeyedTable(c.spark, fresh_path(c.spark), ["cache_key"], "cache_key string, created_at timestamp, last_hit_at timestamp, hits long", buckets=8)

    def put(d: DataFrame, state: str):
        newest = [F.desc("at")]
        return W.upserting(d.where("outcome <> 'expiry'"), table, newest, ["cache_key", "created_at", "last_hit_at", "hits"]).option("checkpointLocation", state).trigger(availableNow=True)

    _twice(c, lambda e: cache.cached_requests(_requests(e), TTL), put, ["ts", "user_id", "event_type"], settings=[cache.ROCKS])
    return _zoneless(table.read())


def _upserted(c: Catalog) -> DataFrame:
    """Each user's newest event, merged batch by batch."""
    table = KeyedTable(c.spark, fresh_path(c.spark), ["user_id"], "user_id long, event_id long, event_type string", buckets=8)
    put = lambda d, state: W.upserting(d, table, [F.desc("ts"), F.desc("event_id")]).option("checkpointLocation", state).trigger(availableNow=True)
    _twice(c, lambda e: e, put, ["ts", "user_id", "event_id", "event_type"])
    return table.read()


QUERIES = {
    "stream_windows": _windows,
    "stream_sessions": _sessions,
    "stream_dedup": _dedup,
    "stream_interval_join": _joined,
    "stream_upserts": _upserted,
    "r14_cache_stream": _cached,
    "r14_cache_written_back": _written_back,
}

_LAST = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"  # the watermark at the end
_CACHE = f"""
  r AS (SELECT user_id || ':' || event_type AS cache_key, ts AS moment FROM events),
  g AS (SELECT *, lag(moment) OVER w AS earlier, lead(moment) OVER w AS later FROM r WINDOW w AS (PARTITION BY cache_key ORDER BY moment)),
  s AS (SELECT *, earlier IS NULL OR moment > earlier + INTERVAL {TTL} SECOND AS fresh FROM g),
  e AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY cache_key ORDER BY moment) AS entry FROM s),
  h AS (SELECT *, row_number() OVER (PARTITION BY cache_key, entry ORDER BY moment) - 1 AS hits, min(moment) OVER (PARTITION BY cache_key, entry) AS created_at FROM e)"""

ORACLES = {
    "stream_windows": f"""SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, n, most FROM (
      SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 HOUR <= {_LAST}""",
    "stream_sessions": f"""SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, user_id, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
      GROUP BY user_id, s HAVING session_end <= {_LAST}""",
    "stream_dedup": "SELECT event_id, user_id FROM events",
    "stream_interval_join": """SELECT a.event_id AS view_id, b.event_id AS purchase_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id
      WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY""",
    "stream_upserts": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "r14_cache_stream": f"""WITH {_CACHE} SELECT cache_key, moment, CASE WHEN fresh THEN 'miss' ELSE 'hit' END AS outcome, hits FROM h
      UNION ALL SELECT cache_key, moment + INTERVAL {TTL} SECOND, 'expiry', hits FROM h WHERE later > moment + INTERVAL {TTL} SECOND OR (later IS NULL AND moment + INTERVAL {TTL} SECOND <= {_LAST})""",
    "r14_cache_written_back": f"WITH {_CACHE} SELECT cache_key, created_at, CASE WHEN hits > 0 THEN moment END AS last_hit_at, hits FROM h WHERE later IS NULL",
}
