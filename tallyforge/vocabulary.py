"""Closed vocabularies of the data model.

Fixed values: they stand in the data and must be spelled exactly so.
"""

FLOP, PRE_HIT, HIT, MEGA_HIT = "趴", "预备", "爆", "大爆"
REFERENCE, RISK, DELETED, UNKNOWN, ANOMALOUS = "参考", "风控", "删除", "未知", "数据异常"
TIERS = (FLOP, PRE_HIT, HIT, MEGA_HIT, REFERENCE, RISK, DELETED, UNKNOWN, ANOMALOUS)
HITS = (HIT, MEGA_HIT)
BORROWABLE = (HIT, MEGA_HIT, REFERENCE)
TIER_RANK = {MEGA_HIT: 7, HIT: 6, PRE_HIT: 5, REFERENCE: 4, RISK: 3, FLOP: 2, UNKNOWN: 1}

BY_STATUS, BY_REMARK, BY_HAND, INFERRED = "状态字段", "备注字段", "人工补录", "数值推断"
HUMAN_SOURCES = (BY_STATUS, BY_REMARK, BY_HAND)

ANY_TREND, ERA_LANGUAGE = "通用", "时代语言范式"
SHORT_TERM_TRENDS = ("特定平台事件", "特定IP引用", "时事热点", "季节性事件", "节日", "当代流行词")

WINDOW_LABELS = ("2h", "24h", "72h", "7d", "14d", "30d", "final", "ad_hoc")
#: First hour since publishing of each label; from the last on (and before publishing) it is ad_hoc.
WINDOW_HOURS = (0, 3, 36, 120, 240, 504, 1080, 8760)
NULL_TOKENS = ("", "/", "-", "—", "无", "暂无", "/无", "N/A", "n/a", "null", "NULL", "None")
INTENTS = ("traffic", "conversion", "educational", "mixed", "other")
COMMENT_ROLES = ("贴主", "素人", "路人", "运营", "未知")
