"""Loosely typed cells into typed columns, as expressions on their JSON text.

A cell is a JSON value: string, number, boolean, list or object.  ``cell`` columns below
hold that text; null means no cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V

_WIDE = "０１２３４５６７８９．"
_NARROW = "0123456789."

# Forms of secrets that are masked, in order.
SECRETS = (
    r"sk-ant-[A-Za-z0-9_\-]{20,}",
    r"sb_secret_[A-Za-z0-9]{20,}",
    r"sbp_[A-Za-z0-9]{20,}",
    r"eyJ[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{20,}",
    r"AIza[A-Za-z0-9_\-]{20,}",
    r"sk-proj-[A-Za-z0-9_\-]{20,}",
    r"sk-[A-Za-z0-9]{40,}",
)
REDACTED = "***REDACTED***"


def kind(cell: Column) -> Column:
    """string, number, boolean, list, object or null of a JSON text."""
    first = F.substring(F.trim(cell), 1, 1)
    return (
        F.when(cell.isNull() | (F.trim(cell) == "null"), "null").when(first == '"', "string").when(first == "[", "list").when(first == "{", "object").when(F.trim(cell).isin("true", "false"), "boolean").otherwise("number")
    )


def string_of(cell: Column) -> Column:
    """A JSON string's text, or a number's digits; null for other kinds."""
    text = F.from_json(F.concat(F.lit('{"v":'), cell, F.lit("}")), "v string")["v"]
    return F.when(kind(cell).isin("string", "number"), text)


def is_null_token(text: Column) -> Column:
    return F.coalesce(F.trim(text).isin(*V.NULL_TOKENS), F.lit(True))


#: What a number looks like; a cast would also take Java's forms, such as 1d.
_NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"


def numeric_text(text: Column) -> Column:
    """A number from text: full-width digits, thousands commas and null tokens understood; else null."""
    plain = F.regexp_replace(F.translate(F.trim(text), _WIDE, _NARROW), "[,，]", "")
    return F.when(~is_null_token(text) & plain.rlike(_NUMBER), plain.try_cast("double"))


def parse_numeric(cell: Column) -> Column:
    """A number from a cell; booleans, lists and objects are none."""
    return numeric_text(string_of(cell))


def split_text(text: Column) -> Column:
    """Trimmed non-empty parts between , ， 、 / and line ends; null for null tokens."""
    parts = F.filter(F.transform(F.split(text, "[,，、/\n]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(~is_null_token(text), parts)


def _elements(cell: Column) -> Column:
    """Texts of a list's elements: strings, numbers, or objects with a text; blank ones are left out."""
    plain = F.from_json(cell, "array<string>")
    text = lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x)
    return F.filter(F.transform(plain, lambda x: F.trim(text(x))), lambda x: x.isNotNull() & (x != ""))


def parse_array(cell: Column) -> Column:
    """An array of texts from a list or from delimited text; an empty list stays empty, a number or boolean is one element."""
    single = F.when(kind(cell) == "boolean", F.initcap(F.trim(cell))).when(kind(cell) == "number", F.trim(cell))
    return F.when(kind(cell) == "list", _elements(cell)).when(single.isNotNull(), F.array(single)).otherwise(split_text(string_of(cell)))


def parse_date(cell: Column) -> Column:
    """ISO text of a moment: numbers above 1e12 are milliseconds, others seconds; text passes stripped."""
    n = F.when(kind(cell) == "number", string_of(cell).try_cast("double"))
    moment = F.when(n > 1e12, F.timestamp_millis(n.cast("bigint"))).otherwise(F.timestamp_millis((n * 1000).cast("bigint")))
    text = F.trim(string_of(cell))
    return F.when(n.isNotNull(), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).when(~is_null_token(text), text)


def flatten_cell(cell: Column) -> Column:
    """One text of any cell: a string or number as it is, an object's text, or a list's texts joined by ", "; null if empty."""
    text = F.when(kind(cell) == "object", F.trim(F.get_json_object(cell, "$.text"))).when(kind(cell) == "list", F.array_join(_elements(cell), ", ")).otherwise(string_of(cell))
    return F.when(text != "", text)


def status_tokens(cell: Column) -> Column:
    """Tokens of a status: a list's texts split at ， 、 / | and comma; any other cell is one token, never split."""
    parts = F.flatten(F.transform(_elements(cell), lambda x: F.split(x, r"[，、/|,]")))
    listed = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    single = flatten_cell(cell)
    return F.when(kind(cell) == "list", listed).when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<string>"))


def audience_text(cell: Column) -> Column:
    """A cell's text with the runs of a list joined by nothing, which keeps its sections apart."""
    listed = F.array_join(F.transform(F.from_json(cell, "array<string>"), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x)), "")
    text = F.when(kind(cell) == "object", F.get_json_object(cell, "$.text")).when(kind(cell) == "list", listed).otherwise(string_of(cell))
    return F.trim(text)


#: How a section of an audience text begins, and its name; the English names of genders.
AUDIENCE_SECTIONS = {"性别": "gender_distribution", "年龄": "age_distribution", "城市": "city_distribution"}
GENDERS = {"男性": "male", "男": "male", "女性": "female", "女": "female"}


def audience_profile(text: Column) -> Column:
    """An audience's shares (0 to 1) from 「性别分布：男性4%，女性96%；年龄分布：<18占2%；阅读时长：14.7秒」 and the like.

    A struct of gender_distribution, age_distribution, city_distribution (maps),
    read_duration_sec and raw (the first 500 characters); null where no section says
    anything.  Of sections that begin alike, and of names that repeat, the last counts.
    """
    section = lambda s: F.struct(F.trim(F.regexp_extract(s, r"(?s)^(.*?)[：:]", 1)).alias("key"), F.trim(F.regexp_extract(s, r"(?s)^.*?[：:](.*)$", 1)).alias("value"))
    sections = F.filter(F.transform(F.split(text, "[；;]"), section), lambda x: ~x["value"].isin("", "无"))
    pattern = r"^(.+?)占?(\d+(?:\.\d+)?)\s*%?$"
    english = F.create_map(*(F.lit(x) for pair in GENDERS.items() for x in pair))

    def pairs(value: Column, names: Column | None) -> Column:
        told = F.filter(F.transform(F.split(value, "[，,]"), lambda x: F.trim(x)), lambda x: x.rlike(pattern))
        name = lambda x: F.trim(F.regexp_extract(x, pattern, 1))
        key = (lambda x: F.coalesce(F.try_element_at(names, name(x)), name(x))) if names is not None else name
        entries = F.transform(told, lambda x: F.struct(key(x).alias("key"), F.round(F.regexp_extract(x, pattern, 2).cast("double") / 100, 4).alias("value")))
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
        return F.when(F.size(last) > 0, F.map_from_entries(last))

    def shares(start: str) -> Column:
        found = F.transform(F.filter(sections, lambda s: s["key"].startswith(start)), lambda s: pairs(s["value"], english if start == "性别" else None))
        return F.try_element_at(F.filter(found, lambda m: m.isNotNull()), F.lit(-1))

    read = F.filter(F.transform(F.filter(sections, lambda s: s["key"].startswith("阅读时长")), lambda s: F.regexp_extract(s["value"], r"(\d+(?:\.\d+)?)", 1)), lambda x: x != "")
    parts = {name: shares(start) for start, name in AUDIENCE_SECTIONS.items()} | {"read_duration_sec": F.try_element_at(read, F.lit(-1)).cast("double")}
    return F.when(F.coalesce(*(c.cast("string") for c in parts.values())).isNotNull(), F.struct(*(c.alias(k) for k, c in parts.items()), F.left(text, F.lit(500)).alias("raw")))


def mask_secrets(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def strip_fence(text: Column) -> Column:
    """A text without the line that opens a ``` fence and the ``` that closes it."""
    plain = F.regexp_replace(text, r"(?s)^\s+|\s+$", "")
    opened = F.when(F.contains(plain, F.lit("\n")), F.regexp_replace(plain, r"(?s)^[^\n]*\n", "")).otherwise("")
    return F.when(plain.startswith("```"), F.regexp_replace(opened, r"(?s)```$", "")).otherwise(plain)


def fenced_json(text: Column) -> Column:
    """The JSON text in a possibly fenced answer; null where it is none."""
    inner = F.regexp_replace(strip_fence(text), r"(?s)^\s+|\s+$", "")
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def too_large(text: Column, limit: int = 100_000) -> Column:
    """Whether a payload is beyond ``limit`` bytes."""
    return F.octet_length(F.coalesce(text, F.lit(""))) > limit


def coerce(cell: Column, target: str) -> Column:
    """A cell under a target type: numeric, integer, array, date or text."""
    return {"numeric": parse_numeric, "array": parse_array, "date": parse_date, "text": flatten_cell, "integer": lambda c: F.floor(parse_numeric(c)).cast("bigint")}[target](cell)
