"""Row-level rules on cells that cycle over listed forms by key, with the results stated by hand."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..catalog import Catalog
from ..functions import cleanse as C
from ..functions import rules as R
from ..functions import scores as S
from ..plans import annotation as N
from ..sources import records as Q

TABLE, KEY = "orders", "o_orderkey"


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def cycled(cases: Sequence[tuple], results: dict[str, str], of: Callable[[Column], dict[str, Column]]) -> tuple[Callable, str]:
    """A query that puts each key's case (its first element) through ``of``, and its oracle from the rest of the case.

    ``results`` names the result columns and their SQL types.
    """
    n = len(cases)

    def run(c: Catalog):
        inputs = F.array(*(F.lit(x[0]).cast("string") for x in cases))
        keyed = c.table(TABLE).select(KEY, F.element_at(inputs, (F.col(KEY) % n + 1).cast("int")).alias("cell"))
        return keyed.select(KEY, *(v.alias(k) for k, v in of(F.col("cell")).items()))

    columns = [f"CAST(CASE {KEY} % {n} {' '.join(f'WHEN {i} THEN {_literal(x[j])}' for i, x in enumerate(cases))} END AS {kind}) AS {name}" for j, (name, kind) in enumerate(results.items(), 1)]
    return run, f"SELECT {KEY}, {', '.join(columns)} FROM {TABLE}"


def cell(x: object) -> str:
    return json.dumps(x, ensure_ascii=False)


def joined(c: Column) -> Column:
    return F.array_join(c, ";")


TIER_RULES = [(("大爆", "新爆款"), V.MEGA_HIT), (("爆贴预备", "预备"), V.PRE_HIT), (("爆贴",), V.HIT), (("参考",), V.REFERENCE), (("限流",), V.RISK), (("趴",), V.FLOP)]
INTENTS = {"流量帖": "traffic", "直给笔记": "conversion", "科普": "educational"}
CLOSED = {
    "lever": [x for own in R.LEVER_VALENCE.values() for x in own],
    "valence": ["positive", "negative", "neutral"],
    "intensity": ["low", "medium", "high"],
    "archetypes": ["怕落后", "想被爱", "求安稳"],
    "trends": ["通用", "节日", "时事热点"],
    "content_format": ["story", "list"],
}
ANNOTATION = "lever string, valence string, intensity string, archetypes array<string>, trends array<string>, content_format string"


def note(lever="焦虑撬动", valence="negative", intensity="low", archetypes=("怕落后",), trends=("通用",), content_format="story") -> str:
    return cell({"lever": lever, "valence": valence, "intensity": intensity, "archetypes": list(archetypes), "trends": list(trends), "content_format": content_format})


def _annotation_errors(c: Column) -> Column:
    row = F.from_json(c, ANNOTATION)
    return R.annotation_errors({k: row[k] for k in CLOSED}, CLOSED)


def _audience(c: Column) -> dict[str, Column]:
    p = C.audience_profile(C.audience_text(c))
    share = lambda part, name: F.try_element_at(p[part], F.lit(name))
    return {"female": share("gender_distribution", "female"), "young": share("age_distribution", "18-24"), "shanghai": share("city_distribution", "上海"), "seconds": p["read_duration_sec"], "raw": p["raw"]}


def _comments(c: Column) -> dict[str, Column]:
    lines = R.comment_lines(c)
    return {"roles": joined(F.transform(lines, lambda x: x["role"])), "contents": joined(F.transform(lines, lambda x: x["content"]))}


def _sample(c: Column) -> dict[str, Column]:
    row = F.from_json(c, "raw_content string, tier string, intent string, note_id string, project_id string, comments array<struct<content:string,role:string,pinned:boolean>>")
    s = R.reference_sample({k: row[k] for k in ("raw_content", "tier", "intent", "note_id", "project_id")}, row["comments"])
    return {"title": s["title"], "quality": s["quality_score"], "tags": joined(s["tags"]), "said": joined(F.transform(s["top_comments"], lambda x: F.concat_ws(",", x["role"], x["text"], x["pinned"].cast("string"))))}


def _flags(c: Column) -> dict[str, Column]:
    row = F.from_json(c, "t array<string>, g string, a array<string>")
    flags = R.audience_flags(row["t"], row["g"], row["a"], {"宝妈": "female", "年轻男性": "male"}, {"宝妈": ["25-34", "35-44"], "年轻男性": ["18-24"]})
    return {"flags": joined(F.transform(flags, lambda x: F.concat_ws(":", x["type"], x["severity"])))}


def _calibration(c: Column) -> dict[str, Column]:
    row = F.from_json(c, "gender map<string,double>, age map<string,double>, city map<string,double>, g string, a array<string>, c array<string>")
    found = R.audience_calibration(row["gender"], row["age"], row["city"], row["g"], row["a"], row["c"])
    return {k: found[k] for k in ("age_match", "gender_match", "city_match")}


def _synthetic(c: Column) -> dict[str, Column]:
    row = F.from_json(c, "s string, t string")
    flag = R.synthetic_flag(row["s"], row["t"])
    return {"synthetic": F.get_json_object(flag, "$.synthetic"), "reason": F.get_json_object(flag, "$.synthetic_reason")}


def _numeric_tier(c: Column) -> dict[str, Column]:
    row = F.from_json(c, "t string, s string, i double, h double, m double")
    tier, source = R.numeric_tier(row["t"], row["s"], row["i"], row["h"], row["m"])
    return {"tier": tier, "source": source}


def _weights(c: Column) -> dict[str, Column]:
    row = F.from_json(c, "age double, trends array<string>")
    own = S.layered_weights(row["age"], row["trends"])
    return {name: F.round(w, 6) for name, w in zip(("surface", "essence", "audience"), own)}


def _vocabulary(c: Column) -> dict[str, Column]:
    row = F.from_json(c, "a array<string>, s string")
    moves = {"旧": "新", "弃": None, "并": "新"}
    return {"tags": joined(R.migrate_array(row["a"], moves)), "scalar": R.migrate_scalar(row["s"], moves)}


def _direction(c: Column) -> dict[str, Column]:
    row = F.from_json(c, "present string, d string")
    return {"content_format": R.lift(row["present"], row["d"], {"护肤": "story", "母婴": "list"}), "threshold": R.threshold(row["d"], {"护肤": 50.0}, F.lit(200.0))}


CYCLES = {
    "c3_dates": cycled(
        [(cell(1704067200000), "2024-01-01T00:00:00+00:00"), (cell(1704067200), "2024-01-01T00:00:00+00:00"), (cell(""), None), (cell(" 2024-01-01 "), "2024-01-01"), (cell("无"), None), (cell(True), None), (cell(["x"]), None), (None, None)],
        {"moment": "VARCHAR"}, lambda c: {"moment": C.parse_date(c)},
    ),
    "c4_flat_cells": cycled(
        [(cell({"text": " x "}), "x"), (cell(["a", {"text": "b"}, " "]), "a, b"), (cell("女性自发, 男性自发"), "女性自发, 男性自发"), (cell(""), None), (cell(7), "7"), (cell([]), None), (None, None)],
        {"flat": "VARCHAR"}, lambda c: {"flat": C.flatten_cell(c)},
    ),
    "c5_status_tokens": cycled(
        [(cell(["a，b", "c|d"]), "a;b;c;d"), (cell("a，b"), "a，b"), (cell([{"text": "x、y/z"}, ","]), "x;y;z"), (cell({"text": "k"}), "k"), (cell([]), ""), (None, "")],
        {"tokens": "VARCHAR"}, lambda c: {"tokens": joined(C.status_tokens(c))},
    ),
    "c6_tiers": cycled(
        [(cell(["爆贴预备", "爆贴"]), "爆"), (cell(["爆贴预备", "大爆"]), "大爆"), (cell("爆贴预备"), "预备"), (cell("备注：新爆款"), "大爆"), (cell(["限流", "参考"]), "参考"), (cell("趴了"), "趴"), (cell("评估中"), "未知"), (cell([]), "未知"), (None, "未知")],
        {"tier": "VARCHAR"}, lambda c: {"tier": R.extract_tier(C.status_tokens(c), TIER_RULES, V.UNKNOWN)},
    ),
    "c7_intents": cycled(
        [(cell(["流量帖", "直给笔记"]), "mixed"), (cell("流量帖"), "traffic"), (cell(["科普", "科普"]), "educational"), (cell("traffic"), "traffic"), (cell("没见过"), "other"), (cell(["没见过", "科普"]), "educational"), (cell([]), None), (cell(""), None), (None, None)],
        {"intent": "VARCHAR"}, lambda c: {"intent": R.map_intent(F.when(C.kind(c) == "list", C._elements(c)).otherwise(F.array_compact(F.array(C.flatten_cell(c)))), INTENTS)},
    ),
    "c8_audiences": cycled(
        [
            (cell("性别分布：男性4%，女性96%；年龄分布：<18占2%，18-24占5%；城市分布：上海11%，北京5%；阅读时长：14.7秒"), 0.96, 0.05, 0.11, 14.7, "性别分布：男性4%，女性96%；年龄分布：<18占2%，18-24占5%；城市分布：上海11%，北京5%；阅读时长：14.7秒"),
            (cell([{"text": "性别：女"}, {"text": "80%；"}, "年龄：无"]), 0.8, None, None, None, "性别：女80%；年龄：无"),
            (cell("城市:上海12.55,北京8;阅读时长:9"), None, None, 0.1255, 9.0, "城市:上海12.55,北京8;阅读时长:9"),
            (cell("性别分布：；年龄：-"), None, None, None, None, None),
            (cell("说明没有冒号"), None, None, None, None, None),
            (None, None, None, None, None, None),
        ],
        {"female": "DOUBLE", "young": "DOUBLE", "shanghai": "DOUBLE", "seconds": "DOUBLE", "raw": "VARCHAR"}, _audience,
    ),
    "c9_coerced": cycled(
        [(cell("1,234"), 1234.0, "1|234", "1,234"), (cell("１．５"), 1.5, "１．５", "１．５"), (cell(True), None, "True", None), (cell("/"), None, None, "/"), (cell([{"text": "x"}, "y"]), None, "x|y", "x, y"), (cell(7), 7.0, "7", "7"), (cell("1f"), None, "1f", "1f"), (cell("1d"), None, "1d", "1d"), (cell("1e3"), 1000.0, "1e3", "1e3"), (None, None, None, None)],
        {"number": "DOUBLE", "parts": "VARCHAR", "plain": "VARCHAR"}, lambda c: {"number": C.coerce(c, "numeric"), "parts": F.array_join(C.coerce(c, "array"), "|"), "plain": C.coerce(c, "text")},
    ),
    "c12_sums": cycled(
        [(cell(["1", "2", "x"]), 3.0), (cell(["/", None, "5"]), 5.0), (cell(["/", "无"]), None), (cell(["0", "0", "0"]), 0.0), (cell([]), None)],
        {"total": "DOUBLE"}, lambda c: {"total": R.sum_present(*(C.numeric_text(F.try_element_at(F.from_json(c, "array<string>"), F.lit(i))) for i in (1, 2, 3)))},
    ),
    "c13_c14_directions": cycled(
        [(cell({"present": "guide", "d": "护肤"}), "guide", 50.0), (cell({"d": "护肤"}), "story", 50.0), (cell({"d": "母婴"}), "list", 200.0), (cell({"d": "其他"}), None, 200.0), (cell({}), None, 200.0)],
        {"content_format": "VARCHAR", "threshold": "DOUBLE"}, _direction,
    ),
    "c15_numeric_tiers": cycled(
        [
            (cell({"i": 500, "h": 100, "m": 400}), "大爆", "数值推断"), (cell({"t": "未知", "s": "状态字段", "i": 150, "h": 100, "m": 400}), "爆", "数值推断"), (cell({"t": "趴", "s": "状态字段", "i": 900, "h": 100, "m": 400}), "趴", "状态字段"),
            (cell({"t": "未知", "s": "状态字段", "i": 5, "h": 100, "m": 400}), "未知", "状态字段"), (cell({"h": 100, "m": 400}), None, None), (cell({"i": 900, "h": 100}), "爆", "数值推断"), (cell({"i": 900}), None, None),
        ],
        {"tier": "VARCHAR", "source": "VARCHAR"}, _numeric_tier,
    ),
    "c16_synthetic": cycled(
        [(cell({"s": "关注中", "t": "爆贴"}), "true", "note status"), (cell({"t": "伪爆贴500"}), "true", "tier source"), (cell({"s": "关注", "t": "伪爆贴"}), "true", "note status; tier source"), (cell({"s": "正常"}), "false", None), (cell({"t": "爆贴"}), "false", None), (cell({}), None, None)],
        {"synthetic": "VARCHAR", "reason": "VARCHAR"}, _synthetic,
    ),
    "c21_comments": cycled(
        [
            ("1. 用户A: hello", "素人", "hello"), ("贴主: thanks", "贴主", "thanks"), ("用户A | hello", "素人", "hello"), ("hello", "素人", "hello"), ("客服: hello\n原帖作者：hi", "运营;贴主", "hello;hi"), ("作者: a\n楼主: b", "素人;素人", "a;b"),
            ("运营小号|x: y", "运营", "x: y"), ("12.\n\n 3、\n(2)、用户: z", "素人", "z"), ("名字｜full", "素人", "名字｜full"), ("贴主 |", "贴主", ""), ("这个名字有二十一个字符那么长所以它不是名字了吧: x", "素人", "这个名字有二十一个字符那么长所以它不是名字了吧: x"), ("a:\r\nb", "素人;素人", "a:;b"), ("", "", ""), (None, None, None),
        ],
        {"roles": "VARCHAR", "contents": "VARCHAR"}, _comments,
    ),
    "c23_platforms": cycled([("xiaohongshu", "小红书"), ("douyin", "抖音"), ("weibo", "微博")], {"code": "VARCHAR"}, lambda c: {"code": R.platform_code(c, {"xiaohongshu": "小红书", "douyin": "抖音", "weibo": "微博"})}),
    "c24_reference_samples": cycled(
        [
            (cell({"raw_content": "first\nsecond", "tier": "大爆", "note_id": "n", "comments": [{"content": "c", "role": "贴主", "pinned": True}, {"content": "", "role": "素人"}]}), "first", 200, "synced;大爆", "贴主,c,true"),
            (cell({"raw_content": "x" * 90, "tier": "爆"}), "x" * 80, 100, "synced;爆", ""),
            (cell({"raw_content": "\nbody", "tier": "参考", "comments": [{"content": "d", "role": "素人"}]}), "未命名样本", 0, "synced;参考", "素人,d,false"),
            (cell({}), "未命名样本", 0, "synced", ""),
        ],
        {"title": "VARCHAR", "quality": "INTEGER", "tags": "VARCHAR", "said": "VARCHAR"}, _sample,
    ),
    "c25_masked": cycled(
        [(f"key {x} end", "key ***REDACTED*** end") for x in ("sk-ant-" + "a1_-" * 5, "sb_secret_" + "A1b2" * 5, "sbp_" + "c3D4" * 5, ".".join(["eyJ" + "e5_-" * 5, "f6_-" * 5, "g7_-" * 5]), "AIza" + "h8_-" * 5, "sk-proj-" + "i9_-" * 5, "sk-" + "j0K1" * 10)]
        + [("key sk-short AIzaShort sbp_short end", "key sk-short AIzaShort sbp_short end"), ("plain", "plain"), (None, None), ("a sbp_" + "x" * 20 + " b AIza" + "y" * 25, "a ***REDACTED*** b ***REDACTED***")],
        {"masked": "VARCHAR"}, lambda c: {"masked": C.mask_secrets(c)},
    ),
    "c26_annotation_errors": cycled(
        [
            (note(), ""), (note(lever="好奇驱动", valence="neutral", trends=("节日", "时事热点")), ""), (note(lever="没有", valence=None), "lever;valence"), (note(archetypes=()), "archetypes: one or two"), (note(archetypes=("怕落后", "想被爱", "求安稳")), "archetypes: one or two"),
            (note(archetypes=("别的",)), "archetypes"), (note(trends=()), "trends: missing"), (note(trends=("通用", "节日")), "trends: exclusive"), (note(trends=("别的",)), "trends"), (note(content_format="vlog"), "content_format"), (note(valence="positive"), "lever against valence"), (note(lever="造梦投射", intensity="x"), "intensity;lever against valence"),
        ],
        {"errors": "VARCHAR"}, lambda c: {"errors": joined(_annotation_errors(c))},
    ),
    "c27_fenced_json": cycled(
        [('```json\n{"a": 1}\n```', True), ('```\n{"a": 1}```', True), (' {"a": 1} ', True), ('x ```json\n{"a": 1}\n```', False), ("```", False), ("no", False), (None, False)],
        {"parsed": "BOOLEAN"}, lambda c: {"parsed": C.fenced_json(c).isNotNull()},
    ),
    "c28_payload_caps": cycled([("中" * 3, False), ("中" * 4, True), ("x" * 10, False), ("x" * 11, True), (None, False)], {"too_large": "BOOLEAN"}, lambda c: {"too_large": C.too_large(c, 10)}),
    "c29_lessons": cycled(
        [
            (cell({"hook_type": "a", "structure": "b", "why_it_worked": "c", "transferable_tactic": "d"}), ""), (cell({"hook_type": " ", "structure": "b", "why_it_worked": "c", "transferable_tactic": "d"}), "hook_type"),
            (cell({}), "hook_type;structure;why_it_worked;transferable_tactic"), (cell({"why_it_worked": "x", "structure": ""}), "hook_type;structure;transferable_tactic"),
        ],
        {"errors": "VARCHAR"}, lambda c: {"errors": joined(R.lesson_errors({k: F.get_json_object(c, f"$.{k}") for k in N.LESSON}))},
    ),
    "c32_vocabulary_moves": cycled(
        [(cell({"a": ["旧", "x", "并", "弃"], "s": "旧"}), "新;x", "新"), (cell({"a": ["弃"], "s": "弃"}), "", None), (cell({"a": [], "s": "y"}), "", "y"), (cell({}), None, None)],
        {"tags": "VARCHAR", "scalar": "VARCHAR"}, _vocabulary,
    ),
    "c34_layered_weights": cycled(
        [(cell({"age": 30.0, "trends": ["通用", "节日"]}), 0.707107, 0.707107, 0.5), (cell({"age": 30.0, "trends": ["时代语言范式"]}), 0.5, 0.707107, 0.5), (cell({"age": 9.0, "trends": ["时代语言范式", "节日"]}), 0.5, 0.901250, 0.812252), (cell({"age": 12.0, "trends": None}), 0.5, 0.870551, 0.757858)],
        {"surface": "DOUBLE", "essence": "DOUBLE", "audience": "DOUBLE"}, _weights,
    ),
    "c35_calibration": cycled(
        [
            (cell({"gender": {"female": 0.8, "male": 0.2}, "age": {"18-24": 0.6, "25-34": 0.4}, "city": {"上海": 0.2, "北京": 0.1}, "g": "female", "a": ["18-24"], "c": ["上海"]}), True, True, True),
            (cell({"gender": {"female": 0.7, "male": 0.3}, "age": {"18-24": 0.4, "25-34": 0.6}, "city": {"上海": 0.2}, "g": "female", "a": ["18-24"], "c": ["北京"]}), False, False, False),
            (cell({"gender": {"female": 0.1, "male": 0.9}, "age": {"b": 0.5, "a": 0.5}, "city": {"x": 0.5}, "g": "male", "a": ["a"], "c": ["x", "y"]}), True, True, True),
        ],
        {"age_match": "BOOLEAN", "gender_match": "BOOLEAN", "city_match": "BOOLEAN"}, _calibration,
    ),
    "c35_audience_flags": cycled(
        [
            (cell({"t": ["宝妈"], "g": "male", "a": ["25-34"]}), "gender_mismatch:high"), (cell({"t": ["宝妈"], "g": "female", "a": ["18-24"]}), "age_no_overlap:medium"), (cell({"t": ["年轻男性"], "g": "female", "a": ["45+"]}), "gender_mismatch:high;age_no_overlap:medium"),
            (cell({"t": ["宝妈"], "g": "mixed", "a": ["35-44"]}), ""), (cell({"t": ["大众"], "g": "male", "a": ["18-24"]}), ""), (cell({"t": ["宝妈", "年轻男性"], "g": "male", "a": []}), ""),
        ],
        {"flags": "VARCHAR"}, _flags,
    ),
    "r22_leaks": cycled(
        [("品牌与人群", ""), ("实际表现：互动数 9", "互动数;实际表现"), ("frontier 大爆贴", "tier;大爆;爆贴"), ("", "")],
        {"leaks": "VARCHAR"}, lambda c: {"leaks": joined(N.leaks(c))},
    ),
}

CONFIG = {
    "project_id": "p",
    "field_mapping": {
        "正文": "raw_content", "互动": "interactions", "曝光": "impressions", "点赞": "likes", "人群": "target_audience", "发布": "publish_time", "形式": "content_format",
        "状态": "_status_raw", "笔记状态": "_note_status_raw", "类型": "_intent_raw", "方向": "_direction_raw", "昵称": "_account_name",
    },
    "tier_extraction": {"source": "状态字段", "rules": [{"match_contains": ["大爆"], "tier": "大爆"}, {"match_contains": ["爆贴"], "tier": "爆"}, {"default": None}]},
    "intent_mapping": {"流量帖": "traffic", "直给": "conversion"},
    "tier_thresholds": {"爆": 100, "大爆": 1000},
    "computed_fields": {"interactions": {"sum": ["点赞", "收藏"]}},
    "direction_decomposition": {
        "护肤": {"content_format": "story", "intent_override": "educational", "tier_threshold_override": {"爆": 50}},
        "粗": {"content_format": "list", "intent_override": "conversion", "tier_threshold_override": {"爆": 500}, "sub_directions": [{"name": "细"}]},
    },
    "excluded_directions": [{"direction": "女性自发, 男性自发"}],
    "project_specific_fields_to_raw_extra": ["备注", "收藏"],
}

#: A record's fields, and: tier, tier_source, intent, interactions, content_format, synthetic, item, route.
RECORDS = [
    ({"正文": "a", "互动": "1,200", "状态": ["爆贴"], "类型": "流量帖", "备注": "x"}, "爆", "状态字段", "traffic", 1200.0, None, "false", None, "accepted"),
    ({"正文": "b", "互动": 150}, "爆", "数值推断", None, 150.0, None, None, None, "accepted"),
    ({"正文": "c", "互动": 60, "方向": "护肤", "类型": "流量帖"}, "爆", "数值推断", "educational", 60.0, "story", None, None, "accepted"),
    ({"正文": "d", "互动": 60, "方向": [{"text": "护肤"}], "形式": "guide"}, "爆", "数值推断", "educational", 60.0, "guide", None, None, "accepted"),
    ({"正文": "e", "互动": 150, "方向": "粗", "类型": ["流量帖", "直给"]}, None, None, "mixed", 150.0, None, None, None, "accepted"),
    ({"正文": "f", "互动": 5000, "方向": ["女性自发", "男性自发"], "状态": "大爆"}, "数据异常", "数据异常", None, 5000.0, None, "false", None, "accepted"),
    ({"正文": "g", "状态": "伪爆贴500"}, "爆", "状态字段", None, None, None, "true", None, "accepted"),
    ({"正文": "h", "笔记状态": "关注", "状态": "大爆"}, "大爆", "状态字段", None, None, None, "true", None, "accepted"),
    ({"正文": "i", "点赞": "7", "收藏": "８"}, None, None, None, 15.0, None, None, None, "accepted"),
    ({"正文": "j", "来源条目": [{"text": " item-1 "}], "来源项目": "p9"}, None, None, None, None, None, None, "item-1", "accepted"),
    ({"正文": "k", "没声明": 1}, None, None, None, None, None, None, None, "quarantine"),
    ({"互动": 3}, None, None, None, 3.0, None, None, None, "quarantine"),
    ({"发布": 1704067200000}, None, None, None, None, None, None, None, "placeholder"),
    ({}, None, None, None, None, None, None, None, "placeholder"),
]


def mapping() -> Q.Mapping_:
    return Q.load_mapping(CONFIG, "p", {"来源条目": "source_item_id"}, ("来源项目",))


def records(c: Catalog):
    """Records whose fields cycle by key over RECORDS."""
    each = F.array(*(F.from_json(F.lit(cell({k: cell(v) for k, v in r[0].items()})), "map<string,string>") for r in RECORDS))
    return c.table(TABLE).select(F.col(KEY).cast("string").alias("record_id"), F.element_at(each, (F.col(KEY) % len(RECORDS) + 1).cast("int")).alias("fields"))


def _transformed(c: Catalog):
    rows = Q.transform(records(c), mapping())
    return rows.select(F.col("record_id").cast("long").alias(KEY), "tier", "tier_source", "intent", "interactions", "content_format", F.get_json_object("flags", "$.synthetic").alias("synthetic"), "source_item_id")


def _routed(c: Catalog):
    parts = Q.route(Q.transform(records(c), mapping()))
    name = {"accepted": "accepted", "quarantine": "quarantine", "placeholders": "placeholder"}
    out = None
    for k, df in parts.items():
        own = df.select(F.col("record_id").cast("long").alias(KEY), F.lit(name[k]).alias("route"))
        out = own if out is None else out.unionByName(own)
    return out


def _metrics(c: Catalog):
    rows = Q.metric_rows(Q.transform(records(c), mapping()), F.lit("2024-01-02 00:00:00").cast("timestamp"))
    return rows.select(F.regexp_replace("note_id", "^p_", "").cast("long").alias(KEY), "window_label", "interactions", F.col("likes").alias("likes"))


def _extra(c: Catalog):
    rows = Q.transform(records(c), mapping())
    at = lambda k: F.get_json_object("raw_extra", f"$.{k}")
    return rows.select(F.col("record_id").cast("long").alias(KEY), at("备注").alias("remark"), at("收藏").alias("saved"), at("_direction_raw").alias("direction"), at("_tier_source_raw").alias("tier_text"), at("来源项目").alias("origin"))


def _comment_rows(c: Catalog):
    block = F.array(F.lit("1. 用户A: x\n\n贴主: y"), F.lit("12."), F.lit(None), F.lit("solo"))
    notes = c.table(TABLE).select(F.col(KEY).alias("note_id"), F.element_at(block, (F.col(KEY) % 4 + 1).cast("int")).alias("comment_block"))
    return R.comments(notes)


def _preflight(c: Catalog):
    return Q.preflight(records(c), mapping()).withColumns({k: F.array_join(k, ";") for k in ("blocking", "warnings")})


def _stated(columns: dict[str, tuple[int, str]]) -> str:
    n = len(RECORDS)
    cases = lambda j: " ".join(f"WHEN {i} THEN {_literal(r[j])}" for i, r in enumerate(RECORDS))
    return ", ".join(f"CAST(CASE {KEY} % {n} {cases(j)} END AS {kind}) AS {name}" for name, (j, kind) in columns.items())


_EXTRA = {0: ('"x"', None, None, '["爆贴"]', None), 2: (None, None, '"护肤"', None, None), 3: (None, None, '[{"text": "护肤"}]', None, None), 4: (None, None, '"粗"', None, None), 5: (None, None, '["女性自发", "男性自发"]', '"大爆"', None), 6: (None, None, None, '"伪爆贴500"', None), 7: (None, None, None, '"大爆"', None), 8: (None, '"８"', None, None, None), 9: (None, None, None, None, '"p9"')}


def _extra_sql() -> str:
    names = ("remark", "saved", "direction", "tier_text", "origin")
    cases = lambda j: " ".join(f"WHEN {i} THEN {_literal(x[j])}" for i, x in _EXTRA.items())
    return ", ".join(f"CAST(CASE {KEY} % {len(RECORDS)} {cases(j)} END AS VARCHAR) AS {name}" for j, name in enumerate(names))


QUERIES = {name: run for name, (run, _) in CYCLES.items()} | {
    "c10_c18_ingest": _transformed,
    "c10_raw_extra": _extra,
    "c11_c17_routes": _routed,
    "c20_metric_rows": _metrics,
    "c22_comment_ids": _comment_rows,
    "r16_preflight": _preflight,
    "a14_column_values": lambda c: Q.column_values(records(c), 3),
    "io4_fields": lambda c: Q.fields(records(c)).select("column", "records", F.array_join("kinds", ";").alias("kinds")),
}

_CELLS = [(k, v) for r in RECORDS for k, v in r[0].items()]


def _values(x: object) -> list[str]:
    elements = x if isinstance(x, list) else [x]
    return [e["text"].strip() if isinstance(e, dict) else str(e) for e in elements]


def _cell_rows(rows: Sequence[tuple]) -> str:
    return ", ".join(f"({', '.join(map(_literal, r))})" for r in rows)


_VALUES = [(i, k, v) for i, r in enumerate(RECORDS) for k, x in r[0].items() for v in _values(x)]
_KINDS = [(i, k, "list" if isinstance(x, list) else "string" if isinstance(x, str) else "number") for i, r in enumerate(RECORDS) for k, x in r[0].items()]

ORACLES = {name: sql for name, (_, sql) in CYCLES.items()} | {
    "c10_c18_ingest": f"SELECT {KEY}, {_stated({'tier': (1, 'VARCHAR'), 'tier_source': (2, 'VARCHAR'), 'intent': (3, 'VARCHAR'), 'interactions': (4, 'DOUBLE'), 'content_format': (5, 'VARCHAR'), 'synthetic': (6, 'VARCHAR'), 'source_item_id': (7, 'VARCHAR')})} FROM {TABLE}",
    "c10_raw_extra": f"SELECT {KEY}, {_extra_sql()} FROM {TABLE}",
    "c11_c17_routes": f"SELECT {KEY}, {_stated({'route': (8, 'VARCHAR')})} FROM {TABLE}",
    "c20_metric_rows": f"SELECT {KEY}, 'ad_hoc' AS window_label, interactions, CAST(CASE WHEN {KEY} % {len(RECORDS)} = 8 THEN 7 END AS DOUBLE) AS likes FROM (SELECT {KEY}, {_stated({'interactions': (4, 'DOUBLE')})} FROM {TABLE}) WHERE interactions IS NOT NULL",
    "c22_comment_ids": f"""SELECT {KEY} || '_c' || n AS comment_id, {KEY} AS note_id, CAST(n AS INTEGER) AS comment_order, role, content FROM {TABLE} JOIN
      (VALUES (0, 1, '素人', 'x'), (0, 2, '贴主', 'y'), (3, 1, '素人', 'solo')) t(k, n, role, content) ON {KEY} % 4 = k""",
    "r16_preflight": f"""SELECT count(*) AS rows, count(*) FILTER (WHERE k < 10) AS accepted, count(*) FILTER (WHERE k = 10) AS undeclared, count(*) FILTER (WHERE k = 10) AS lost, count(*) FILTER (WHERE k = 11) AS anomalies,
      count(*) FILTER (WHERE k > 11) AS placeholders, CAST(0 AS BIGINT) AS other_intents, CAST(0 AS BIGINT) AS unknown_directions, 'notes would be lost' AS blocking, 'anomalies' AS warnings FROM (SELECT {KEY} % {len(RECORDS)} AS k FROM {TABLE})""",
    "a14_column_values": f"""SELECT "column", value, n, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k FROM (
      SELECT c AS "column", v AS value, count(*) AS n FROM {TABLE} JOIN (VALUES {_cell_rows(_VALUES)}) t(i, c, v) ON {KEY} % {len(RECORDS)} = i GROUP BY ALL)) WHERE k <= 3""",
    "io4_fields": f"""SELECT c AS "column", count(*) AS records, array_to_string(list_sort(list(DISTINCT v)), ';') AS kinds FROM {TABLE} JOIN (VALUES {_cell_rows(_KINDS)}) t(i, c, v) ON {KEY} % {len(RECORDS)} = i GROUP BY c""",
}
