import json
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import ids as I
from tallyforge.functions import predicates as P
from tallyforge.operators import aggregates as A
from tallyforge.operators import ranking as K
from tallyforge.operators import state as T
from tallyforge.operators.keyed import KeyedTable
from tallyforge.plans import annotation as N
from tallyforge.plans import health as H
from tallyforge.plans import selection as S
from tallyforge.sources import onboarding as O
from tallyforge.sources import records as Q
from tallyforge.streaming import windows as W


def two_passes(rows, n):
    out, seen = [], set()
    for i, kind in rows:
        if not kind or kind not in seen:
            out.append(i)
            seen.add(kind)
    return (out + [i for i, _ in rows if i not in set(out)])[:n]


def test_diversity_pick_equals_two_passes(spark):
    r = random.Random(1)
    groups = {g: [(i, r.choice(["a", "b", "c", "", None])) for i in range(r.randint(0, 9))] for g in range(60)}
    rows = [(g, i, k) for g, own in groups.items() for i, k in own]
    got = {}
    for x in K.diversity_pick(spark.createDataFrame(rows, "g int, i int, kind string"), ["g"], "kind", [F.asc("i")], 4).orderBy("g", "pick").collect():
        got.setdefault(x["g"], []).append(x["i"])
    assert got == {g: two_passes(own, 4) for g, own in groups.items() if own}


def test_round_robin(spark):
    rows = [("p", 1, 0.9), ("p", 2, 0.8), ("p", 3, 0.7), ("q", 4, 0.95), ("r", 5, 0.1)]
    got = K.round_robin(spark.createDataFrame(rows, "g string, i int, s double"), "g", "s", "i", 2, 4).orderBy("wave", F.desc("s")).collect()
    assert [x["i"] for x in got] == [4, 1, 5, 2]


def test_percentiles_equal_numpy(spark):
    r = np.random.default_rng(1)
    own = r.integers(0, 50, 101).tolist()
    got = A.percentiles(spark.createDataFrame([("a", x) for x in own] + [("b", None), ("c", 4)], "g string, x int"), ["g"], "x", [0.5, 0.9]).collect()
    by = {x["g"]: x for x in got}
    assert (by["a"]["p50"], by["a"]["p90"]) == (np.percentile(own, 50), np.percentile(own, 90))
    assert by["b"]["p50"] is None and by["c"]["p90"] == 4


def test_value_ranks_equal_a_sort(spark):
    r = random.Random(2)
    own = [int(10 ** r.uniform(0, 6)) for _ in range(500)] + [7] * 50
    got = A.value_ranks(spark.createDataFrame([(x,) for x in own], "v long"), "v").collect()
    for x in got:
        assert x["before"] == sum(y > x["v"] for y in own) and x["n"] == own.count(x["v"]) and x["total"] == len(own)


def test_null_logic_of_tags(spark):
    rows = spark.createDataFrame([(["a", None],), ([None],), ([],), (None,)], "t array<string>")
    got = rows.select(P.has(F.col("t"), "a").alias("x"), P.has_any(F.col("t"), ["b", "a"]).alias("y"), P.has(F.col("t"), "z").alias("z")).collect()
    assert [tuple(x) for x in got] == [(True, True, False)] + 3 * [(False, False, False)]


def test_upsert_is_idempotent_and_keeps_absent_columns(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "k int, x string, y int")
    new = spark.createDataFrame([(2, "b"), (3, None)], "k int, x string")
    once = T.upsert(old, new, ["k"])
    twice = T.upsert(once, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 5), (2, "b", 6), (3, None, None)]
    kept = T.upsert(old, spark.createDataFrame([(1, "z"), (2, "w")], "k int, x string"), ["k"], ["x"])
    assert sorted((r["k"], r["x"]) for r in kept.collect()) == [(1, "a"), (2, "w")]


def test_audit_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, x string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (3, None)], "k int, x string")
    got = {(r["row_id"], r["operation"]): json.loads(r["changed"]) for r in T.audit_diff(old, new, "k").collect()}
    assert got == {(2, "UPDATE"): {"x": ["b", "c"]}, (4, "INSERT"): {"x": [None, "d"]}}


def test_violations_and_null_keys(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "z", 1), (3, None, None), (4, "a", None)], "k int, x string, u int")
    got = sorted(map(tuple, T.violations(rows, "k", {"x": ["a"]}, ["x"], [["u"]]).collect()))
    assert got == [("1", "u: unique"), ("2", "x: closed set"), ("3", "x: required")]


def test_threads(spark):
    known = spark.createDataFrame([(i,) for i in range(9)], "comment_id int")
    links = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 4), (4, 5), (5, 3), (6, 6), (7, 99), (8, 3), (1, 2)], "child int, parent int")
    got = {tuple(r) for r in S.thread_errors(links.where("NOT (child = 1 AND parent = 2)"), known).collect()}
    assert got == {(3, "cycle"), (4, "cycle"), (5, "cycle"), (8, "cycle"), (6, "self loop"), (7, "unknown parent")}
    assert (1, "repeated") in {tuple(r) for r in S.thread_errors(links, known).collect()}


CONFIG = {
    "project_id": "p",
    "field_mapping": {"正文": "raw_content", "互动": "interactions", "曝光": "impressions", "发布": "publish_time", "状态": "_status_raw", "类型": "_intent_raw"},
    "tier_extraction": {"rules": [{"match_contains": ["爆贴"], "tier": "爆"}]},
    "intent_mapping": {"流量帖": "traffic"},
    "tier_thresholds": {"爆": 100, "大爆": 1000},
    "project_specific_fields_to_raw_extra": ["备注"],
}


def test_ingest(spark, tmp_path):
    rows = [
        {"record_id": "r1", "fields": {"正文": "text", "互动": "1,200", "状态": ["爆贴"], "类型": "流量帖", "备注": "x", "发布": 1704067200000}},
        {"record_id": "r2", "fields": {"正文": "text", "互动": 150, "曝光": "/"}},
        {"record_id": "r3", "fields": {"正文": "text", "odd": 1}},
        {"record_id": "r4", "fields": {"互动": 3}},
        {"record_id": "r5", "fields": {}},
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    mapping = Q.load_mapping(CONFIG, "p")
    records = Q.read_json_lines(spark, f"file://{tmp_path}/r.jsonl")
    parts = Q.route(Q.transform(records, mapping))
    got = {r["note_id"]: r for r in parts["accepted"].collect()}
    assert {k: (r["interactions"], r["tier"], r["tier_source"], r["intent"]) for k, r in got.items()} == {"p_r1": (1200, "爆", "状态字段", "traffic"), "p_r2": (150, "爆", "数值推断", None)}
    assert json.loads(got["p_r1"]["raw_extra"]) == {"备注": '"x"', "_tier_source_raw": '["爆贴"]'}
    assert sorted((r["record_id"], r["reason"]) for r in parts["quarantine"].collect()) == [("r3", "undeclared fields"), ("r4", "missing raw_content")]
    assert [r["record_id"] for r in parts["placeholders"].collect()] == ["r5"]
    taken = Q.metric_rows(parts["accepted"], F.lit("2024-01-02 00:00:00").cast("timestamp")).collect()
    assert {r["note_id"]: (r["window_label"], r["hours_since_publish"]) for r in taken} == {"p_r1": ("24h", 24), "p_r2": ("ad_hoc", None)}
    some, columns = Q.sample(records, 2)
    assert len(some) == 2 and set(columns) <= {"正文", "互动", "状态", "类型", "备注", "发布", "曝光", "odd"}
    assert Q.union(records, records.limit(1)).count() == 6
    for batch in ("1", "2", "1"):  # the first is tried again
        Q.write_dead_letters(parts["quarantine"], f"file://{tmp_path}/dead", batch)
    assert spark.read.json(f"file://{tmp_path}/dead").count() == 4


def test_csv_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,正文,互动\nr1,"a, ""b""",7\nr2,,\n')
    got = {r["record_id"]: r["fields"] for r in Q.read_csv(spark, "id", f"file://{tmp_path}/r.csv").collect()}
    assert {k: json.loads(v) for k, v in got["r1"].items()} == {"正文": 'a, "b"', "互动": "7"} and got["r2"] == {}


@pytest.mark.parametrize("change", [{"project_id": "q"}, {"field_mapping": {}}, {"tier_extraction": {"source": "状态"}}, {"tier_extraction": {"rules": [{"match_contains": ["x"], "tier": "好"}]}}, {"intent_mapping": {"x": "y"}}, {"tier_thresholds": {"好": 1}}, {"field_mapping": {"a": {"target": "b", "type": "blob"}}}])
def test_wrong_mappings_are_refused(change):
    with pytest.raises(ValueError):
        Q.load_mapping(CONFIG | change, "p")


def test_cron_gate(spark):
    rows = spark.createDataFrame([("on_demand", True), ("on_demand", False), ("daily", True), (None, True)], "i string, s boolean")
    assert [r[0] for r in rows.select(Q.due(F.col("i"), F.col("s"))).collect()] == [False, True, True, True]


def told(frame):
    return sorted(tuple("" if x is None else x for x in r) for r in frame.collect())


def test_drafts_are_validated(spark):
    fields = lambda **kw: {k: json.dumps(v, ensure_ascii=False) for k, v in kw.items()}
    rows = [("p", str(i), fields(正文=f"text {i}", 状态="爆贴" if i % 2 else "趴", 类型=["traffic", "流量帖"], 备注=i)) for i in range(6)] + [("q", "1", fields(正文="x", _record_id="r"))]
    records = spark.createDataFrame(rows, "config_id string, " + Q.SCHEMA)
    made = O.drafted(records, {"正文": "raw_content", "状态": "_status_raw", "类型": "_intent_raw"}, cap=3)
    config = {r["config_id"]: json.loads(r["config"]) for r in made.collect()}
    assert config["p"]["project_specific_fields_to_raw_extra"] == ["备注"] and config["p"]["intent_mapping"] == {"traffic": "traffic", "流量帖": O.PENDING}
    assert [x["match_contains"] for x in config["p"]["tier_extraction"]["rules"]] == [["爆贴"], ["趴"]] and config["q"]["field_mapping"] == {"正文": "raw_content"}
    columns = spark.createDataFrame([("p", "正文"), ("p", "新列"), ("p", "_record_id")], "config_id string, column string")
    found = told(O.validated(made, columns=columns))
    assert [x[:2] for x in found] == [("p", "pending")] * 3 + [("p", "uncovered")] and found[-1][3] == "新列"


def test_values_outside_their_sets(spark):
    ways = {"d/e": {"content_format": "no", "sub_directions": [{"content_format": "vlog", "intent_override": "mixed"}]}, "f": {"content_format": "story", "target_audience": ["a", "z"], "intent_override": O.PENDING}}
    config = {"intent_mapping": {"a": "b"}, "category": "x", "schema_family": "any", "tier_extraction": {"rules": [{"tier": None}, {"tier": "好"}]}, "direction_decomposition": ways}
    configs = spark.createDataFrame([("1", json.dumps(config, ensure_ascii=False)), ("2", "[]"), ("3", "no json"), ("4", "{}"), ("5", None)], "config_id string, config string")
    found = told(O.validated(configs, {"category": ["y"], "content_format": ["story"], "target_audience": ["a"]}))
    assert found == [
        ("1", "error", "/category", "x"),
        ("1", "error", "/direction_decomposition/d~1e/sub_directions/0/content_format", "vlog"),
        ("1", "error", "/direction_decomposition/f/target_audience/1", "z"),
        ("1", "error", "/intent_mapping/a", "b"),
        ("1", "error", "/tier_extraction/rules/1/tier", "好"),
        ("2", "error", "", "[]"),
        ("3", "error", "", "no json"),
        ("5", "error", "", ""),
    ]


def test_structures_are_compared(spark):
    made = {"field_mapping": {"a": "x", "b": "y"}, "direction_decomposition": {"d": {"content_format": "s"}}, "tier_extraction": {"source": "s"}, "tier_thresholds": {"爆": 1}}
    wanted = {"field_mapping": {"a": "other", "c": "y"}, "direction_decomposition": {"d": {"content_format": "t"}}, "tier_extraction": {"source": "t"}}
    frame = lambda x: spark.createDataFrame([("1", json.dumps(x))], "config_id string, config string")
    assert told(O.compared(frame(made), frame(made))) == []
    assert told(O.compared(frame(made), frame(wanted))) == [("1", "columns", "extra", "b"), ("1", "columns", "missing", "c"), ("1", "source of tiers", "extra", "s"), ("1", "source of tiers", "missing", "t")]
    assert told(O.compared(frame(wanted), frame(wanted))) == [("1", "thresholds", "missing", "")]


def test_answers_are_tried_once_more(spark):
    def ask(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("down")
        return ['```json\n{"x": "good"}\n```' if "wrong:" in p or "fine" in p else "no json" if "none" in p else '{"x": "bad"}' for p in prompts]

    rows = [("1", "fine"), ("2", "none"), ("3", "bad"), ("4", "boom")]
    prompts = spark.createDataFrame(rows, "id string, prompt string").repartition(4, "id")
    wrong = lambda j: F.when(F.get_json_object(j, "$.x") != "good", F.array(F.lit("x is bad"))).otherwise(F.array().cast("array<string>"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        valid, failed = N.with_retry(prompts, ask, wrong)
        assert sorted((r["id"], r["answer"], r["retried"]) for r in valid.collect()) == [("1", '{"x": "good"}', False), ("2", '{"x": "good"}', True), ("3", '{"x": "good"}', True)]
        assert [(r["id"], r["errors"]) for r in failed.collect()] == [("4", ["call failed: RuntimeError: down"])]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_prompts_that_leak_are_refused(spark):
    fine = spark.createDataFrame([("a", "brand")], "id string, context string")
    assert N.guarded(fine).count() == 1
    with pytest.raises(Exception, match="leaks performance"):
        N.guarded(fine.withColumn("context", F.lit("互动数 9"))).collect()


def test_lessons_and_exit_codes(spark):
    lessons = spark.createDataFrame([("a", " h ", "s", "w", "t"), ("b", "", "s", "w", "t")], "note_id string, hook_type string, structure string, why_it_worked string, transferable_tactic string")
    assert [tuple(r) for r in N.valid_lessons(lessons).collect()] == [("a", "h", "s", "w", "t")]
    outcome = lambda *x: H.exit_code(spark.createDataFrame([(o,) for o in x], "outcome string"))
    assert [outcome("ok", "hygiene"), outcome("systemic"), outcome("systemic", "ok"), outcome("content", "content"), outcome()] == [1, 1, 0, 0, 0]


def test_reports(spark):
    assert H.report(spark.createDataFrame([("a|b", None)], "x string, y int"), "t") == "# t\n\n| x | y |\n| --- | --- |\n| a\\|b |  |"
    with pytest.raises(ValueError):
        H.report(spark.range(9), "t", 8)


def test_ranks_and_percentiles_of_groups(spark):
    r = random.Random(3)
    rows = [(g, r.choice([r.randint(-50, 50), r.randint(0, 10**6)])) for g in "abc" for _ in range(r.randint(1, 200))] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    by = {}
    for g, v in rows:
        by.setdefault(g, []).extend([v] if v is not None else [])
    got = {x["g"]: x for x in A.percentiles(df, ["g"], "v", [0.25, 0.9]).collect()}
    assert got.keys() == by.keys() and got["d"]["p25"] is None
    for g in "abc":
        assert got[g]["n"] == len(by[g]) and got[g]["p25"] == pytest.approx(np.percentile(by[g], 25)) and got[g]["p90"] == pytest.approx(np.percentile(by[g], 90))
    median = {x["g"]: x["median"] for x in A.upper_median(df, ["g"], "v").collect()}
    assert median == {g: sorted(own)[len(own) // 2] for g, own in by.items() if own}
    ranks = sorted((x["column"], x["rank"], x["value"], x["n"]) for x in A.distribution(df, ["g", "v"]).collect())
    for c, own in (("g", [g for g, _ in rows]), ("v", ["" if v is None else str(v) for _, v in rows])):
        counted = sorted(((-own.count(x), x) for x in set(own)))
        assert [(k, x, n) for col, k, x, n in ranks if col == c] == [(i + 1, x, -m) for i, (m, x) in enumerate(counted)]


def test_ranks_of_values_that_lie_close_together(spark):
    """Ranges keep tasks even where values are within 1 % of each other, or begin alike."""
    n = 200_000
    close = spark.range(n).selectExpr("1e9 + (id * 7919 % 200000) * 0.05 AS v", "concat('https://example.org/a/long/common/path/', lpad(id, 9, '0')) AS s")
    placed = A.ordinals(close, [], [F.desc("v")])
    sizes = [r["count"] for r in close.repartitionByRange(4, F.desc("v")).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * n / 4
    assert placed.where("before <> round(199999 - (v - 1e9) / 0.05) OR total <> 200000").count() == 0
    assert A.ordinals(close, [], [F.asc("s")]).where("before <> cast(right(s, 9) AS int)").count() == 0


def test_streaming_upsert_and_windows(spark, tmp_path):
    source, table = f"{tmp_path}/in", f"file://{tmp_path}/state"
    rows = [(1, "a", "2024-01-01 00:00:10"), (1, "b", "2024-01-01 00:00:50"), (2, "c", "2024-01-01 00:06:00")]
    events = spark.createDataFrame(rows, "k int, x string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(source)
    state = KeyedTable(spark, table, ["k"], events.schema, buckets=4)
    stream = spark.readStream.schema(events.schema).parquet(source)
    q = W.upserting(stream, state, [F.desc("ts")]).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["k"], r["x"]) for r in state.read().collect()) == [(1, "b"), (2, "c")]
    counts = W.windowed(stream, "ts", ["k"], [F.count(F.lit(1)).alias("n")], "5 minutes")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["k"], r["n"]) for r in spark.table("w").collect()) == [(1, 2), (2, 1)]


def test_name_based_ids(spark):
    names = ["a", "", "中文", None]
    got = spark.createDataFrame([(x,) for x in names], "n string").select(I.uuid5(uuid.NAMESPACE_DNS, F.col("n")).alias("id")).collect()
    assert [r["id"] for r in got] == [None if x is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, x)) for x in names]
