import pytest
from pyspark.sql import functions as F

from tallyforge.operators.keyed import KeyedTable, UniqueIndex

SCHEMA = "id long, name string, n int"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def table(spark, tmp_path, **how):
    return KeyedTable(spark, f"file://{tmp_path}/t", ["id"], SCHEMA, **({"buckets": 16} | how))


def test_merge_preserves_and_replaces(spark, tmp_path):
    t = table(spark, tmp_path)
    assert rows(t.read()) == []
    t.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "x", 0)], SCHEMA))
    done = t.merge(spark.createDataFrame([(2, 5), (3, 6), (None, 7)], "id long, n int"))
    assert (done["rows"], done["refused"]) == (2, 1)
    assert rows(t.read()) == [(1, "a", 1), (2, "b", 5), (3, None, 6)]
    t.merge(spark.createDataFrame([(2, "no"), (3, "c")], "id long, name string"), write_once=["name"])
    assert rows(t.read()) == [(1, "a", 1), (2, "b", 5), (3, "c", 6)]
    assert rows(t.read(1)) == [(1, "a", 1), (2, "b", 2)]  # an older version
    t.delete(spark.createDataFrame([(1,), (9,)], "id long"))
    assert rows(KeyedTable(spark, t.path, ["id"]).read()) == [(2, "b", 5), (3, "c", 6)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path, buckets=100)
    t.merge(spark.range(20_000).select("id", F.lit("x").alias("name"), F.lit(0).alias("n")))
    before = t.state()["buckets"]
    batch = spark.range(200).select((F.col("id") * 100).alias("id"), F.lit(1).alias("n"))  # 1 % of the keys
    few = batch.where("id < 1000")
    done = t.merge(few)
    after = t.state()["buckets"]
    assert 1 <= len(done["buckets"]) <= 10
    assert {b for b in after if after[b] != before[b]} == {str(b) for b in done["buckets"]}
    assert t.read().where("n = 1").count() == 10 and t.read().count() == 20_000
    read = t.touched(few).inputFiles()
    assert len({f.split("_bucket=")[1].split("/")[0] for f in read}) == len(done["buckets"])


def test_a_job_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA))

    def die(state):
        raise RuntimeError("killed")

    monkeypatch.setattr(t, "_commit", die)
    with pytest.raises(RuntimeError):
        t.merge(spark.createDataFrame([(1, "z", 9)], SCHEMA), writer="w", number=1)
    again = KeyedTable(spark, t.path, ["id"])
    assert rows(again.read()) == [(1, "a", 1)]
    again.merge(spark.createDataFrame([(1, "z", 9)], SCHEMA), writer="w", number=1)
    again.merge(spark.createDataFrame([(1, "y", 8)], SCHEMA), writer="w", number=2)
    again.merge(spark.createDataFrame([(1, "z", 9)], SCHEMA), writer="w", number=1)  # replayed
    assert rows(again.read()) == [(1, "y", 8)]
    again.clean()
    assert rows(again.read()) == [(1, "y", 8)] and len(again.versions()) == 1
    assert len(again.files.names(f"{t.path}/data")) == 1


def test_two_writers_of_one_version(spark, tmp_path):
    t = table(spark, tmp_path)
    old = t.state()
    t.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    with pytest.raises(Exception, match="(?i)exist"):
        t._replace(old, [], t.read(), {}, None, None)
    assert rows(t.read()) == [(1, "a", 1)]


def test_rows_of_one_key_and_unknown_columns(spark, tmp_path):
    t = table(spark, tmp_path)
    twice = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], SCHEMA)
    with pytest.raises(ValueError):
        t.merge(twice)
    t.merge(twice, order=[F.desc("n")])
    assert rows(t.read()) == [(1, "b", 2)]
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(1, 2)], "id long, other int"))
    assert t.merge(spark.createDataFrame([], SCHEMA))["buckets"] == []


def test_partial_unique_keys(spark, tmp_path):
    schema = "id int, a string, b string, active boolean"
    index = UniqueIndex(spark, f"file://{tmp_path}/u", "id", ["a", "b"], "active", buckets=8)
    first = spark.createDataFrame([(1, "x", "y", True), (2, "x", "y", False), (3, None, "y", True), (4, None, "y", True), (5, "p", "q", True), (6, "p", "q", True)], schema)
    assert [(r["row"], r["holder"]) for r in index.add(first, "w", 1).collect()] == [("6", "5")]
    second = spark.createDataFrame([(7, "x", "y", True), (8, "x", "y", False), (1, "x", "y", True), (9, "new", "y", True)], schema)
    assert [(r["row"], r["holder"]) for r in index.add(second, "w", 2).collect()] == [("7", "1")]
    assert index.table.read().count() == 3
    same = UniqueIndex(spark, f"file://{tmp_path}/v", "id", ["a", "b"], "active", nulls_distinct=False, buckets=8)
    assert sorted((r["row"], r["holder"]) for r in same.add(first).collect()) == [("4", "3"), ("6", "5")]
