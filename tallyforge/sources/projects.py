"""Ingest of many projects in one plan: mappings as rows of a small table that records are joined with.

:func:`.records.transform` writes a mapping into the plan, which suits one project.  Here a
mapping is a row of maps and arrays, sent to every task, and a record looks its own up; the
plan is the same for one project and for hundreds, and the records are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import cleanse as C
from ..functions import rules as R
from .records import LIFTED, TARGET_TYPES, Mapping_

_WAY = "struct<content_format:string,target_audience:string,user_pain_point:string,product_focus:string,intent:string,hit:double,mega:double>"
_RULES = (
    "project_id string, sources map<string,array<string>>, computed map<string,array<string>>, lineage map<string,string>, tier_source string, remark boolean, "
    "tier_rules array<struct<needles:array<string>,tier:string>>, tier_default string, intents map<string,string>, ways map<string," + _WAY + ">, lifts array<string>, "
    "excluded array<string>, hit double, mega double, kept array<struct<name:string,column:string>>, declared array<string>"
)
#: Intermediates that something else takes, so that they aren't kept.
_TAKEN = ("_status_raw", "_note_for_tier", "_intent_raw")


def _row(m: Mapping_) -> tuple:
    sources: dict[str, list[str]] = {}
    for c, (target, _) in m.fields.items():
        sources.setdefault(target, []).append(c)
    text = lambda v: None if v is None else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    ways, lifts = {}, set()
    for name, d in m.directions.items():
        told = {k: None if d.subs else text(d.lifted.get(k)) for k in LIFTED}
        lifts |= {k for k, v in told.items() if v is not None}
        ways[name] = (*(told[k] for k in LIFTED), None if d.subs else d.intent, *(None if d.thresholds.get(t) is None else float(d.thresholds[t]) for t in (V.HIT, V.MEGA_HIT)))
    kept = {c: c for c in (*m.extra, *m.lineage_kept)} | {c: t for c, (t, _) in m.fields.items() if t.startswith("_") and t not in _TAKEN}
    by_name = {name: c for c, name in kept.items()}
    limit = [None if m.thresholds.get(t) is None else float(m.thresholds[t]) for t in (V.HIT, V.MEGA_HIT)]
    return (
        m.project_id, sources, {t: list(c) for t, c in m.computed.items()}, {t: c for c, t in m.lineage.items()}, m.tier_source, m.tier_source == V.BY_REMARK,
        [(list(n), t) for n, t in m.tier_rules], m.tier_default, dict(m.intents), ways, sorted(lifts), list(m.excluded), *limit, list(by_name.items()), m.declared(),
    )


def rule_table(spark: SparkSession, mappings: Sequence[Mapping_]) -> DataFrame:
    """A row of rules for each mapping; as large as the configs, whatever the number of records."""
    if len({m.project_id for m in mappings}) < len(mappings):
        raise ValueError("a project has several mappings")
    return spark.createDataFrame([_row(m) for m in mappings], _RULES)


def _types(mappings: Sequence[Mapping_]) -> dict[str, str]:
    """The type of each target that a record may fill; projects must agree on it."""
    found: dict[str, set[str]] = {}
    for m in mappings:
        for target, kind in m.fields.values():
            if not target.startswith("_"):
                found.setdefault(target, set()).add(kind)
        for target in m.computed:
            found.setdefault(target, set()).add("numeric")
        for target in m.lineage.values():
            found.setdefault(target, set()).add("text")
        for d in m.directions.values():
            for target in () if d.subs else d.lifted:
                found.setdefault(target, set()).add(TARGET_TYPES.get(target, "text"))
    if several := {t: sorted(k) for t, k in found.items() if len(k) > 1}:
        raise ValueError(f"projects differ in the type of {several}")
    return {t: k.pop() for t, k in found.items()}


def transform_all(records: DataFrame, mappings: Sequence[Mapping_]) -> DataFrame:
    """What :func:`.records.transform` gives for each project's records (project_id, record_id, fields), in one plan.

    The columns are those of all projects; one that a project doesn't map is null in its
    rows.  Records of a project without a mapping are left out.
    """
    types = _types(mappings)
    rules = F.broadcast(rule_table(records.sparkSession, mappings).select("project_id", F.struct(*(c.split()[0] for c in _RULES.split(", ") if not c.startswith("project_id"))).alias("r")))
    joined = records.select("project_id", "record_id", "fields").join(rules, "project_id")
    r = lambda name: F.col(f"r.{name}")
    none = F.array().cast("array<string>")
    cell = lambda c: F.try_element_at("fields", c)
    listed = lambda name, target: F.coalesce(F.try_element_at(r(name), F.lit(target)), none)
    first = lambda values: F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))
    raw = lambda target: first(F.transform(listed("sources", target), cell))
    # what several columns ask for is computed in steps, once a record, or it would be repeated in each of them
    tier_cell = F.when(r("remark"), raw("_note_for_tier")).otherwise(raw("_status_raw"))
    joined = joined.select("*", C.flatten_cell(raw("_direction_raw")).alias("_direction"), tier_cell.alias("_tier_cell"), raw("_intent_raw").alias("_intent_cell"))
    direction, tier_cell, intent_cell = F.col("_direction"), F.col("_tier_cell"), F.col("_intent_cell")
    joined = joined.select("*", F.try_element_at(r("ways"), direction).alias("_way"))
    way = F.col("_way")

    def value(target: str, kind: str) -> Column:
        # of several columns the last that has a value counts
        out = first(F.reverse(F.transform(listed("sources", target), lambda c: C.coerce(cell(c), kind))))
        if kind == "numeric":
            parts = F.filter(F.transform(listed("computed", target), lambda c: C.parse_numeric(cell(c))), lambda v: v.isNotNull())
            out = F.coalesce(out, F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)))
        if target in LIFTED:
            own = C.split_text(way[target]) if kind == "array" else way[target]
            there = F.exists(listed("sources", target), lambda c: F.map_contains_key("fields", c))
            out = F.when(F.array_contains(r("lifts"), target) & ~there, own).otherwise(out)
        if kind == "text":
            promoted = F.try_element_at(r("lineage"), F.lit(target))
            out = F.when(promoted.isNotNull(), F.nullif(F.trim(C.flatten_cell(cell(promoted))), F.lit(""))).otherwise(out)
        return out

    values_of = [value(t, k).alias(f"_target_{t}") for t, k in types.items()]
    targets = {t: F.col(f"_target_{t}") for t in types}
    ruled = tier_cell.isNotNull() & (F.size(r("tier_rules")) > 0)
    of = lambda token: first(F.transform(F.filter(r("tier_rules"), lambda x: F.exists(x["needles"], lambda n: F.contains(token, n))), lambda x: x["tier"]))
    rank = lambda tier: F.coalesce(F.try_element_at(R._map(V.TIER_RANK), tier), F.lit(0))
    ranked = F.transform(F.filter(F.transform(C.status_tokens(tier_cell), of), lambda t: t.isNotNull()), lambda t: F.struct(rank(t).alias("rank"), t.alias("tier")))
    tier = F.when(ruled, F.coalesce(F.array_max(ranked)["tier"], r("tier_default")))
    source = F.when(ruled, r("tier_source"))
    values = F.when(C.kind(intent_cell) == "list", C._elements(intent_cell)).otherwise(F.array_compact(F.array(C.flatten_cell(intent_cell))))
    joined = joined.select("*", *values_of, tier.alias("_tier"), values.alias("_values"))
    tier, values = F.col("_tier"), F.col("_values")
    mapped = F.array_distinct(F.filter(F.transform(values, lambda v: F.coalesce(F.try_element_at(r("intents"), v), v)), lambda v: v.isin(*V.INTENTS)))
    joined = joined.select("*", mapped.alias("_mapped"))
    mapped = F.col("_mapped")
    intent = F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, None).when(F.size(mapped) == 1, mapped[0]).when(F.size(mapped) > 1, "mixed").otherwise("other")
    out_of = F.coalesce(F.array_contains(r("excluded"), direction), F.lit(False))
    tier, source = F.when(out_of, V.ANOMALOUS).otherwise(tier), F.when(out_of, V.ANOMALOUS).otherwise(source)
    tier, source = R.numeric_tier(tier, source, targets.get("interactions", F.lit(None).cast("double")), F.coalesce(way["hit"], r("hit")), F.coalesce(way["mega"], r("mega")))
    pairs = F.concat(F.transform(r("kept"), lambda k: F.struct(k["name"].alias("key"), cell(k["column"]).alias("value"))), F.array(F.struct(F.lit("_tier_source_raw").alias("key"), tier_cell.alias("value"))))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull() & ~p["value"].isin('""', "[]", "null"))
    return joined.select(
        F.concat_ws("_", "project_id", "record_id").alias("note_id"),
        "project_id",
        "record_id",
        *(v.alias(t) for t, v in targets.items()),
        tier.alias("tier"),
        source.alias("tier_source"),
        F.coalesce(way["intent"], intent).alias("intent"),
        R.synthetic_flag(raw("_note_status_raw"), tier_cell).alias("flags"),
        F.to_json(F.map_from_entries(pairs)).alias("raw_extra"),
        F.array_sort(F.array_except(F.map_keys("fields"), r("declared"))).alias("undeclared"),
    )
