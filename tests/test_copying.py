import pytest
from pyspark.sql import functions as F

from tallyforge.plans.copying import CopiedTable, Copy, in_order

A, B, C = CopiedTable("a", ["id"], buckets=8), CopiedTable("b", ["id"], {"a_id": "a", "of": "b"}, buckets=8), CopiedTable("c", ["b_id", "n"], {"b_id": "b"}, buckets=8)


def source(spark):
    frames = {
        "a": spark.range(20).select("id", F.lit("x").alias("name")),
        "b": spark.range(40).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 25).alias("a_id"), F.lit(None).cast("long").alias("of")),
        "c": spark.range(90).select((F.col("id") % 45).alias("b_id"), (F.col("id") % 2).alias("n")),
    }
    return frames.__getitem__


def test_parents_come_first():
    assert [t.name for t in in_order([C, B, A])] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        in_order([CopiedTable("p", ["id"], {"q": "q"}), CopiedTable("q", ["id"], {"p": "p"})])


def test_a_stopped_copy_goes_on(spark, tmp_path):
    seen = []

    def stop(table, k):
        seen.append((table, k))
        if (table, k) == ("b", 1):
            raise RuntimeError("stopped")

    path = f"file://{tmp_path}/copy"
    with pytest.raises(RuntimeError):
        Copy(spark, "one", source(spark), path, [C, B, A], ranges=4).run(stop)
    copy = Copy(spark, "one", source(spark), path, [C, B, A], ranges=4)
    copy.run(lambda table, k: seen.append((table, k)))
    assert sorted(seen) == [(t, k) for t in "abc" for k in range(4)]  # each range once
    copy.run(lambda table, k: seen.append(None))
    assert None not in seen
    bad = {i for i in range(40) if i % 10 and i % 25 >= 20}
    lost = [i for i in range(90) if i % 45 >= 40 or i % 45 in bad]
    report = {r["table"]: tuple(r)[1:] for r in copy.reconciled().collect()}
    assert report == {"a": (20, 20, 0, 0), "b": (40, 40 - len(bad), len(bad), 0), "c": (90, 90 - len(lost), len(lost), 0)}
    assert {(r["table"], r["reason"]) for r in copy.quarantined().collect()} == {("b", "no a"), ("c", "no b")}


def test_what_is_there_stays_and_keyless_rows_are_held_back(spark, tmp_path):
    path = f"file://{tmp_path}/copy"
    Copy(spark, "first", lambda _: spark.createDataFrame([(1, "old")], "id long, name string"), path, [A]).run()
    copy = Copy(spark, "second", lambda _: spark.createDataFrame([(1, "new"), (2, "new"), (None, "lost")], "id long, name string"), path, [A])
    copy.run()
    assert sorted(map(tuple, copy.target(A).read().collect())) == [(1, "old"), (2, "new")]
    assert [tuple(r) for r in copy.quarantined().collect()] == [("a", "[null]", "no key")]
