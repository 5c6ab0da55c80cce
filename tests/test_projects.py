import json
import random

import pytest

from tallyforge import vocabulary as V
from tallyforge.sources import records as Q
from tallyforge.sources.projects import transform_all


def mapping(i, r):
    way = lambda: {"content_format": r.choice(["story", "list"]), "target_audience": r.choice(["a、b", ["c", "d"]]), "intent_override": r.choice([None, "mixed"]), "tier_threshold_override": r.choice([{}, {"爆": 50}])}
    config = {
        "project_id": f"p{i}",
        "field_mapping": {"正文": "raw_content", f"互动{i % 3}": "interactions", "互动": "interactions", "曝光": "impressions", f"状态{i % 2}": "_status_raw", "备注": "_note_for_tier", "类型": "_intent_raw", "方向": "_direction_raw", "合作": "_note_status_raw"},
        "tier_extraction": {"source": r.choice([V.BY_STATUS, V.BY_REMARK]), "rules": [{"match_contains": [f"大{i}", "大爆"], "tier": "大爆"}, {"match_contains": "爆", "tier": "爆"}][: r.randint(0, 2)], "default": r.choice([None, "趴"])},
        "intent_mapping": {f"类{k}": r.choice(V.INTENTS) for k in range(r.randint(0, 4))},
        "direction_decomposition": {f"d{k}": r.choice([way(), way(), {"sub_directions": [{"name": "s"}], "tier_threshold_override": {"爆": 10}}]) for k in range(r.randint(0, 3))},
        "excluded_directions": r.choice([[], ["d2"]]),
        "tier_thresholds": r.choice([{}, {"爆": 100, "大爆": 1000}]),
        "computed_fields": r.choice([{}, {"interactions": ["赞", "藏"]}]),
        "project_specific_fields_to_raw_extra": r.choice([[], ["额外", "赞"]]),
    }
    return Q.load_mapping(config, f"p{i}", r.choice([{}, {"来源": "source_item_id"}]), r.choice([[], ["版本"]]))


def record(r):
    cells = {
        "正文": r.choice(["text", "", "/"]), "互动": r.choice([5, "1,200", "150", None]), "互动0": r.choice([7, "/"]), "互动1": 70, "曝光": "9", "状态0": r.choice(["爆贴", ["大爆、x", "爆"], "伪爆贴"]), "状态1": r.choice(["大7", "无"]),
        "备注": r.choice(["爆", "x"]), "类型": r.choice(["类0", ["类1", "类2"], "traffic", "?"]), "方向": r.choice(["d0", "d1", "d2", "d9"]), "合作": r.choice(["关注", "no"]), "赞": 3, "藏": "4", "额外": {"text": "e"}, "来源": " src ", "版本": [], "odd": True,
    }
    return {k: json.dumps(v, ensure_ascii=False) for k, v in cells.items() if r.random() < 0.7}


def test_one_plan_for_200_projects_equals_single_ones(spark):
    r = random.Random(11)
    mappings = [mapping(i, r) for i in range(200)]
    rows = [(f"p{i}", f"r{k}", record(r)) for i in range(200) for k in range(5)] + [("unknown", "r", {})]
    records = spark.createDataFrame(rows, "project_id string, " + Q.SCHEMA).repartition(4).cache()
    many = transform_all(records, mappings)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1 and "BroadcastHashJoin" in plan
    found = {}
    for x in many.collect():
        found.setdefault(x["project_id"], {})[x["record_id"]] = x.asDict()
    assert len(found) == 200
    for m in mappings[::40]:
        single = Q.transform(records.where(f"project_id = '{m.project_id}'").select("record_id", "fields"), m).collect()
        assert len(single) == 5
        for x in single:
            want, got = x.asDict(), found[m.project_id][x["record_id"]]
            want["raw_extra"], got["raw_extra"] = json.loads(want["raw_extra"]), json.loads(got["raw_extra"])
            assert {k: got[k] for k in want} == want
            assert all(v is None for k, v in got.items() if k not in want)


def test_projects_must_agree_on_types():
    own = [Q.load_mapping({"project_id": p, "field_mapping": {"a": {"target": "x", "type": t}}}, p) for p, t in (("p", "text"), ("q", "numeric"))]
    with pytest.raises(ValueError):
        transform_all(None, own)
