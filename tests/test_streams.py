import datetime

from pyspark.sql import functions as F

from tallyforge.operators.keyed import KeyedTable
from tallyforge.queries.streams import _started
from tallyforge.streaming import cache
from tallyforge.streaming import windows as W


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_a_cache_keeps_its_entries_over_a_restart(spark, tmp_path):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    before = spark.conf.get(cache.ROCKS[0], None)

    def run(*requests):
        spark.createDataFrame([(k, at(m)) for k, m in requests], "cache_key string, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("cache_key string, at timestamp").parquet(source)
        writer = cache.cached_requests(stream, 3600).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
        _started(spark, writer, [cache.ROCKS]).awaitTermination()
        return sorted((r["cache_key"], int((r["at"] - at(0)).total_seconds() // 60), r["outcome"], r["hits"]) for r in spark.read.schema(cache.OUTCOMES).parquet(out).collect())

    first = run(("a", 0), ("a", 30), ("a", 60), ("b", 0))
    assert first == [("a", 0, "miss", 0), ("a", 30, "hit", 1), ("a", 60, "hit", 2), ("b", 0, "miss", 0)]
    second = run(("a", 100), ("a", 200), ("c", 300))  # the last lets the watermark pass what expired
    assert [x for x in second if x not in first] == [("a", 100, "hit", 3), ("a", 160, "expiry", 3), ("a", 200, "miss", 0), ("a", 260, "expiry", 0), ("b", 60, "expiry", 0), ("c", 300, "miss", 0)]
    assert spark.conf.get(cache.ROCKS[0], None) == before


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], "k int, x string", buckets=4)
    done = {}

    class Writer:  # hands out the function that Spark calls with each batch
        def foreachBatch(self, merge):
            done["merge"] = merge
            return self

    class Events:
        writeStream = Writer()

    W.upserting(Events(), table, [F.desc("x")])
    one, two = (spark.createDataFrame(rows, "k int, x string") for rows in ([(1, "a"), (1, "b")], [(1, "c"), (2, "d")]))
    for batch, epoch in ((one, 0), (two, 1), (one, 0)):
        done["merge"](batch, epoch)
    assert sorted(map(tuple, table.read().collect())) == [(1, "c"), (2, "d")] and len(table.versions()) == 3


def test_an_interval_join_meets_what_comes_within_the_time(spark, tmp_path):
    left = spark.createDataFrame([(1, "u", at(0)), (2, "v", at(0))], "a int, u string, t timestamp")
    right = spark.createDataFrame([(10, "u", at(0)), (11, "u", at(60)), (12, "u", at(61)), (13, "v", at(-1))], "b int, w string, s timestamp")
    left.coalesce(1).write.parquet(f"{tmp_path}/l")
    right.coalesce(1).write.parquet(f"{tmp_path}/r")
    l, r = (spark.readStream.schema(x.schema).parquet(f"{tmp_path}/{n}") for x, n in ((left, "l"), (right, "r")))
    query = W.interval_join(l, r, "t", "s", F.col("u") == F.col("w"), "1 hour").writeStream.format("memory").queryName("joined").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((x["a"], x["b"]) for x in spark.table("joined").collect()) == [(1, 10), (1, 11)]


def test_keys_of_one_shard_keep_entries_of_their_own(spark, tmp_path):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for requests in ([("a", 0), ("b", 50), (None, 55)], [("b", 100), ("c", 131)], [("c", 400)]):
        spark.createDataFrame([(k, at(m)) for k, m in requests], "cache_key string, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("cache_key string, at timestamp").parquet(source)
        writer = cache.cached_requests(stream, 3600, shards=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
        _started(spark, writer, [cache.ROCKS]).awaitTermination()
    found = sorted((r["cache_key"] or "", int((r["at"] - at(0)).total_seconds() // 60), r["outcome"], r["hits"]) for r in spark.read.schema(cache.OUTCOMES).parquet(out).collect())
    assert found == [("", 55, "miss", 0), ("", 115, "expiry", 0), ("a", 0, "miss", 0), ("a", 60, "expiry", 0), ("b", 50, "miss", 0), ("b", 100, "hit", 1), ("b", 160, "expiry", 1), ("c", 131, "miss", 0), ("c", 191, "expiry", 0), ("c", 400, "miss", 0)]
