import datetime

from pyspark.sql import functions as F

from tallyforge.functions import sql as L
from tallyforge.plans.reach import DailySketches


def test_a_refresh_reads_new_days_only_and_is_within_two_percent(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("IF(id % 3 = 0, 'a', 'b') AS g", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(id % 20, 3) AS at", "id * 31 % 20011 AS who")
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    kept = DailySketches(spark, f"file://{tmp_path}/s", "g", "at", "who", buckets=4)
    first, last = datetime.date(2024, 1, 12), datetime.date(2024, 2, 1)
    kept.refresh(rows, first)
    assert kept.done() == first and kept.table.read().agg(F.max("day")).first()[0] == first
    plan = kept.new_rows(rows, last)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(at,2024-01-13" in plan
    assert kept.refresh(rows, last)["rows"] == 16  # two groups on eight further days
    assert kept.refresh(rows, last)["rows"] == 0 and kept.refresh(rows, first)["rows"] == 0
    got = {r["g"]: r["estimate"] for r in kept.counts(F.lit("all")).collect()}
    for r in rows.groupBy("g").agg(F.count_distinct("who").alias("n")).collect():
        assert abs(got[r["g"]] - r["n"]) <= 0.02 * r["n"]


def test_functions_in_sql_text(spark):
    users = spark.createDataFrame([(1, 10, "owner"), (1, 11, "member"), (2, 10, "admin"), (3, None, "owner")], "user_id long, workspace_id long, role string")
    items = spark.createDataFrame([(1, 5, "approved"), (2, 5, "pending"), (3, 6, None), (4, None, "pending")], "item_id long, batch_id long, status string")
    told = lambda text: sorted(tuple(r) for r in spark.sql(text).collect())
    for user, ids, admin in ((1, [10, 11], [True, False, False]), (2, [10], [True, False, False]), (None, [], [False] * 3)):
        L.register(spark, {"workspace_users": users, "items": items}, user)
        assert told("SELECT * FROM current_workspace_ids()") == [(i,) for i in ids]
        assert told("SELECT w, is_workspace_admin(w) FROM VALUES (10L), (11L), (12L) AS t(w)") == list(zip((10, 11, 12), admin, strict=True))
    assert told("SELECT * FROM batch_item_counts(array(5L, 7L))") == [(5, 2, 1, 1, 0)]
    assert told("SELECT batch_id, total FROM batch_item_counts(NULL) WHERE batch_id IS NOT NULL") == [(5, 2), (6, 1)]


def test_checks_of_a_table_take_one_scan_and_no_job_beforehand(spark, tmp_path):
    from tallyforge.plans import health as H

    spark.range(50).selectExpr("id AS k", "id % 7 AS u", "IF(id % 2 = 0, 'x', NULL) AS t").write.parquet(f"{tmp_path}/one")
    store = H.Store({"one": lambda: spark.read.parquet(f"{tmp_path}/one")})
    rules = [H.Where("one", "k > 9"), H.Where("one", F.col("t").isNull()), H.Where("one"), H.Where("one", "gone > 1"), H.Once("one", ["k"]), H.Once("one", ["u"]), H.Once("one", ["u"], wanted=False), H.Repeats("one", ["u", "t"]), H.Once("one", ["gone"]), H.Repeats("two", ["k"]), H.There("two"), H.There("one", "t")]
    store("one").schema  # noqa: B018
    spark.sparkContext.setJobGroup("planning", "planning")
    found = H.verify(store, [H.Check(str(i), "s", "n", r, "true") for i, r in enumerate(rules)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert plan.count("Scan parquet") == 2  # one for its rows' checks, one for its keys'
    assert len(jobs) == 0
    got = {int(r["ord"]): r["actual"] for r in found.collect()}
    assert got == {0: "40", 1: "25", 2: "50", 3: "N/A", 4: "true", 5: "false", 6: "true", 7: "7", 8: "false", 9: "N/A", 10: "false", 11: "true"}


def test_every_pool_is_told_whether_it_is_saturated(spark):
    from tallyforge.plans import health as H

    pools = spark.createDataFrame([("a", 0.6), ("b", 0.59), ("c", None)], "project_id string, dominant_ratio double")
    assert {r["project_id"]: r["saturated"] for r in H.saturated(pools).collect()} == {"a": True, "b": False, "c": False}
