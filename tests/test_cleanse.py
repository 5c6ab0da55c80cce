import json

import pytest
from pyspark.sql import functions as F

from tallyforge import vocabulary as V
from tallyforge.functions import cleanse as C
from tallyforge.functions import rules as R


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").repartition(1)
    return [r["out"] for r in sorted(rows.select("i", f(F.col("c")).alias("out")).collect())]


def cells(*values):
    return [None if v is ... else json.dumps(v, ensure_ascii=False) for v in values]


def test_numbers(spark):
    got = each(spark, cells("/", "1,234", "1，234", "１２３", True, 7, "１．５", [1], {"text": "1"}, ..., "无", "x", " 8 "), C.parse_numeric)
    assert got == [None, 1234, 1234, 123, None, 7, 1.5, None, None, None, None, None, 8]


def test_arrays(spark):
    got = each(spark, cells("a, b、c/d\ne", "无", [], [{"text": "x"}, " y ", ""], ...), C.parse_array)
    assert got == [["a", "b", "c", "d", "e"], None, [], ["x", "y"], None]


def test_dates(spark):
    got = each(spark, cells(1704067200000, 1704067200, "", " 2024-01-01 ", ...), C.parse_date)
    assert got == ["2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00+00:00", None, "2024-01-01", None]


def test_status_tokens_and_flat_cells(spark):
    assert each(spark, cells(["a，b", "c|d"], "a，b", [], ...), C.status_tokens) == [["a", "b", "c", "d"], ["a，b"], [], []]
    assert each(spark, cells({"text": " x "}, ["a", {"text": "b"}], " y ", "", ...), C.flatten_cell) == ["x", "a, b", " y ", None, None]


RULES = [(("大爆", "新爆款"), V.MEGA_HIT), (("爆贴预备",), V.PRE_HIT), (("爆贴",), V.HIT), (("趴",), V.FLOP)]


def test_tiers(spark):
    tiers = lambda c: R.extract_tier(C.status_tokens(c), RULES, V.UNKNOWN)
    got = each(spark, cells(["爆贴预备", "爆贴"], ["爆贴预备", "大爆"], "爆贴预备", "none", "趴", "趴了", ...), tiers)
    assert got == [V.HIT, V.MEGA_HIT, V.PRE_HIT, V.UNKNOWN, V.FLOP, V.FLOP, V.UNKNOWN]


def test_intents(spark):
    mapping = {"流量帖": "traffic", "直给笔记": "conversion"}
    got = each(spark, cells(["流量帖", "直给笔记"], "未知词", ..., ["流量帖", "流量帖"], []), lambda c: R.map_intent(C.parse_array(c), mapping))
    assert got == ["mixed", "other", None, "traffic", None]


def test_audience(spark):
    profile = lambda c: F.to_json(C.audience_profile(c))
    got = json.loads(each(spark, ["性别分布：男性4%，女性96%；阅读时长：14.7秒；城市：上海占12.5%，北京占8%"], profile)[0])
    assert got["gender_distribution"] == {"male": 0.04, "female": 0.96} and got["read_duration_sec"] == 14.7 and got["city_distribution"] == {"上海": 0.125, "北京": 0.08}
    assert each(spark, ["", None, "性别："], profile) == [None, None, None]
    twice = json.loads(each(spark, ["性别：男10%，男20%；性别：女30%"], profile)[0])
    assert twice["gender_distribution"] == {"female": 0.3}


def test_window_labels(spark):
    hours = {2: "2h", 3: "24h", 36: "72h", 120: "7d", 240: "14d", 504: "30d", 1080: "final", 8760: "ad_hoc", -1: "ad_hoc"}
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = each(spark, list(hours), lambda c: R.window_label(start, start + F.expr("INTERVAL 1 HOUR") * c), "int")
    assert got == list(hours.values())


def test_comments(spark):
    block = "1. 用户A: hello\n贴主: thanks\n12.\n\n用户A | hello: there\n(2) " + "长" * 30 + "：x"
    rows = spark.createDataFrame([("n", block), ("m", None)], "note_id string, comment_block string")
    got = sorted((r["comment_id"], r["role"], r["content"]) for r in R.comments(rows).collect())
    assert got == [("n_c1", "素人", "hello"), ("n_c2", "贴主", "thanks"), ("n_c3", "素人", "hello: there"), ("n_c4", "素人", "(2) " + "长" * 30 + "：x")]


def test_masking_fences_and_sums(spark):
    assert each(spark, [f"key sk-{'a' * 40} end", "plain", None], C.mask_secrets) == ["key ***REDACTED*** end", "plain", None]
    assert each(spark, ['```json\n{"a": 1}\n```', " plain "], lambda c: F.trim(F.regexp_replace(C.strip_fence(c), "\n", ""))) == ['{"a": 1}', "plain"]
    assert each(spark, [1, None], lambda c: R.sum_present(c, F.lit(None).cast("int")), "int") == [1, None]


def test_vocabulary_moves(spark):
    got = each(spark, [["a", "b", "c", "a"], None], lambda c: R.migrate_array(c, {"a": "c", "b": None}), "array<string>")
    assert got == [["c"], None]


def test_unknown_platform_is_an_error(spark):
    assert each(spark, ["a"], lambda c: R.platform_code(c, {"a": "A"})) == ["A"]
    with pytest.raises(Exception, match="unknown platform"):
        each(spark, ["b"], lambda c: R.platform_code(c, {"a": "A"}))
