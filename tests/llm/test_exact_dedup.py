import hashlib

import pytest

from tallyforge.llm.exact_dedup import DigestIndex, exact_dedup

SCHEMA = "doc_id long, text string, digest string"


def sha(x):
    return hashlib.sha256((x or "").encode()).hexdigest()


def test_one_batch(spark, tmp_path):
    rows = [(1, "a", None), (9, "a", "x"), (5, "a", None), (2, None, None), (3, "", None), (4, "A", None), (None, "é" * 50_000, None), (7, "t", None), (7, "t", None), (None, "a", None)]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), DigestIndex(spark, f"file://{tmp_path}/i", 4)).collect()
    assert len(got) == len(rows)
    kept = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got if r["kept"]]
    want = [(9, 9, 4, sha("a")), (3, 3, 2, sha("")), (4, 4, 1, sha("A")), (None, None, 1, sha("é" * 50_000)), (7, 7, 2, sha("t"))]
    assert sorted(kept, key=str) == sorted(want, key=str)
    assert {r["keep_id"] for r in got if r["text_sha256"] == sha("a")} == {9}


def test_later_batches_meet_the_index(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    first = exact_dedup(spark.createDataFrame([(1, "a", ""), (2, "b", "")], SCHEMA), DigestIndex(spark, path, 4)).collect()
    assert all(r["kept"] for r in first)
    again = {r["doc_id"]: r for r in exact_dedup(spark.createDataFrame([(8, "a", ""), (9, "c", "")], SCHEMA), DigestIndex(spark, path, 4)).collect()}
    assert (again[8]["kept"], again[8]["keep_id"], again[8]["group_size"]) == (False, 1, 2)
    assert again[9]["kept"]
    third = {r["doc_id"]: r for r in exact_dedup(spark.createDataFrame([(20, "a", ""), (21, "a", ""), (22, "c", ""), (23, "d", "")], SCHEMA), DigestIndex(spark, path, 4)).collect()}
    assert [(third[i]["kept"], third[i]["keep_id"], third[i]["group_size"]) for i in (20, 21, 22, 23)] == [(False, 1, 4), (False, 1, 4), (False, 9, 2), (True, 23, 1)]
    fourth = exact_dedup(spark.createDataFrame([(30, "a", "")], SCHEMA), DigestIndex(spark, path, 4)).first()
    assert (fourth["keep_id"], fourth["group_size"]) == (1, 5)


def test_a_batch_that_is_offered_again_gets_its_result_again(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    offer = lambda rows, name: sorted(map(tuple, exact_dedup(spark.createDataFrame(rows, SCHEMA), DigestIndex(spark, path, 4), name).collect()), key=str)
    one, two = [(1, "a", ""), (2, "b", ""), (3, "a", "")], [(4, "a", ""), (5, "c", ""), (6, None, "")]
    first = offer(one, "one")
    assert [x[3] for x in first] == [False, True, True]

    def die(self, batch, number, append=DigestIndex.append):
        append(self, batch.where("digest > '8'"), number)  # part of the rows
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(DigestIndex, "append", die)
        with pytest.raises(RuntimeError):
            offer(two, "two")
    second = offer(two, "two")  # the job is run again
    assert [(x[0], x[1], x[2], x[3]) for x in second] == [(4, 3, 3, False), (5, 5, 1, True), (6, 6, 1, True)]
    assert (offer(one, "one"), offer(two, "two")) == (first, second)  # also after a later batch
    assert DigestIndex(spark, path, 4).table().count() == 5
    assert [x[3] for x in offer(one, None)] == [False, False, False]


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = DigestIndex(spark, f"file://{tmp_path}/i", 4)
    exact_dedup(spark.createDataFrame([(i, str(i), "") for i in range(9)], SCHEMA), index)
    batch = spark.createDataFrame([("x",)], "digest string")
    for found in (index.unseen(batch), index.known(batch)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("hashpartitioning") == 1  # the batch's digests alone
    index.forget()
    assert not spark.catalog.tableExists(index.name)
    assert DigestIndex(spark, f"file://{tmp_path}/i", 4).table().count() == 9


def test_a_text_of_very_many_rows_is_dealt_out(spark, tmp_path):
    rows = [(i, "same", "") for i in range(1500)] + [(5000 + i, f"own {i}", "") for i in range(100)]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), DigestIndex(spark, f"file://{tmp_path}/i", 4)).collect()
    assert len(got) == 1600 and [r["doc_id"] for r in got if r["kept"] and r["group_size"] > 1] == [1499]
    assert {r["group_size"] for r in got} == {1500, 1}


def test_empty_table(spark, tmp_path):
    assert exact_dedup(spark.createDataFrame([], SCHEMA), DigestIndex(spark, f"file://{tmp_path}/i", 4)).collect() == []
