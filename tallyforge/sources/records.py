"""Records with loosely typed fields: reading, sampling and ingesting them under a mapping.

A record is ``record_id`` and ``fields``, a map from column to the JSON text of its cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import cleanse as C
from ..functions import rules as R
from ..operators.ranking import top_per_group

SCHEMA = "record_id string, fields map<string,string>"


def read_json_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Records from JSON lines {"record_id": ..., "fields": {...}}; several tables are one source."""
    lines = spark.read.text(list(paths)).select(F.get_json_object("value", "$.record_id").alias("record_id"), F.get_json_object("value", "$.fields").alias("f"))
    cells = F.transform_values(F.from_json("f", "map<string,variant>"), lambda k, v: F.to_json(v))
    return lines.where(F.col("record_id").isNotNull()).select("record_id", cells.alias("fields"))


def read_csv(spark: SparkSession, id_column: str, *paths: str) -> DataFrame:
    """Records from CSV files with a header; cells are strings, empty ones absent."""
    rows = spark.read.csv(list(paths), header=True, multiLine=True, escape='"')
    columns = [c for c in rows.columns if c != id_column]
    cells = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in columns)))
    text = F.transform_values(cells, lambda k, v: F.regexp_replace(v, r'^\{"v":(.*)\}$', "$1"))
    return rows.select(F.col(id_column).alias("record_id"), F.map_filter(text, lambda k, v: v != "{}").alias("fields"))


def union(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def sample(records: DataFrame, n: int = 20) -> tuple[list, list[str]]:
    """``n`` records and the columns seen among them."""
    rows = records.limit(n).collect()
    return rows, sorted({c for r in rows for c in (r["fields"] or {})})


def fields(records: DataFrame) -> DataFrame:
    """The columns that occur: column, records (how many have a cell there) and kinds of their cells, sorted."""
    cells = records.select(F.explode("fields").alias("column", "cell"))
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("records"), F.sort_array(F.collect_set(C.kind(F.col("cell")))).alias("kinds"))


def column_values(records: DataFrame, cap: int = 40, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """The ``cap`` most frequent values of each column (of each group): column, value, n and rank (ties by value); list cells count by element.

    Values are counted before any are ranked, and Spark keeps the first ``cap`` of a column
    in each task.  Only ``columns``, if they are given.
    """
    cell = F.col("cell")
    values = F.when(C.kind(cell) == "list", C._elements(cell)).otherwise(F.array(C.flatten_cell(cell)))
    cells = records.select(*by, F.explode("fields").alias("column", "cell"))
    cells = cells if columns is None else cells.where(F.col("column").isin(*columns))
    each = cells.select(*by, "column", F.explode(values).alias("value")).where(F.col("value").isNotNull())
    counted = each.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counted, [*by, "column"], [F.desc("n"), F.asc("value")], cap)


#: Types of a note's columns by target, where a mapping names none; others are text.
TARGET_TYPES = {
    **dict.fromkeys(("impressions", "reads", "interactions", "likes", "saves", "shares", "comments_count", "search_rank", "keyword_rank"), "numeric"),
    **dict.fromkeys(("hit_blue_keywords", "target_blue_keywords", "hashtags", "tags", "target_audience", "human_truth_archetype", "trend_dependencies"), "array"),
    "publish_time": "date",
}
TYPES = ("text", "numeric", "integer", "array", "date")
#: Metrics that a note keeps and a snapshot gets too, and those that only a snapshot has.
SHARED_METRICS = ("impressions", "reads", "interactions", "hit_blue_keywords")
ONLY_METRICS = ("likes", "saves", "shares", "comments_count", "search_rank", "keyword_rank")
#: Attributes that a direction may lift into a note.
LIFTED = ("content_format", "target_audience", "user_pain_point", "product_focus")
#: Keys that every record of a source may carry; nobody declares them.
META_KEYS = ("_record_id", "_created_time", "_last_modified_time")


@dataclass(frozen=True)
class Direction:
    """What a direction says of its notes; ``lifted`` and ``intent`` count only without sub-directions."""

    lifted: Mapping[str, object] = field(default_factory=dict)
    intent: str | None = None
    thresholds: Mapping[str, float] = field(default_factory=dict)
    subs: bool = False


@dataclass(frozen=True)
class Mapping_:
    """How a project's columns become a note's; load one with :func:`load_mapping`.

    Targets that begin with "_" are intermediates: _status_raw or _note_for_tier (whichever
    ``tier_source`` names) gives the tier, _note_status_raw the synthetic flag, _intent_raw
    and _direction_raw what they say; any other is kept in raw_extra.
    """

    project_id: str
    fields: Mapping[str, tuple[str, str]]  #: source column: (target, type)
    tier_source: str = V.BY_STATUS
    tier_rules: Sequence[tuple[Sequence[str], str]] = ()
    tier_default: str | None = None
    intents: Mapping[str, str] = field(default_factory=dict)
    directions: Mapping[str, Direction] = field(default_factory=dict)
    excluded: Sequence[str] = ()
    thresholds: Mapping[str, float] = field(default_factory=dict)
    computed: Mapping[str, Sequence[str]] = field(default_factory=dict)
    extra: Sequence[str] = ()
    lineage: Mapping[str, str] = field(default_factory=dict)  #: column of an id: target that it is promoted to
    lineage_kept: Sequence[str] = ()  #: further columns of the origin, kept in raw_extra

    def declared(self) -> list[str]:
        return sorted({*self.fields, *self.extra, *self.lineage, *self.lineage_kept, *META_KEYS})

    def columns_of(self, target: str) -> list[str]:
        return [c for c, (t, _) in self.fields.items() if t == target]


def load_mapping(config: Mapping, project_id: str, lineage: Mapping[str, str] | None = None, lineage_kept: Sequence[str] = ()) -> Mapping_:
    """A mapping from a parsed config (YAML or JSON), checked.

    Required: project_id (the file's name) and field_mapping {column: target}, or {target, type}.
    The tier's source, its rules' tiers, types, intents and thresholds must be known ones.
    """
    problems = [k for k in ("project_id", "field_mapping") if not config.get(k)]
    if problems:
        raise ValueError(f"missing: {', '.join(problems)}")
    if config["project_id"] != project_id:
        raise ValueError(f"project_id {config['project_id']!r} is not the file's name {project_id!r}")
    targets = {c: (m, TARGET_TYPES.get(m, "text")) if isinstance(m, str) else (m["target"], m.get("type") or TARGET_TYPES.get(m["target"], "text")) for c, m in config["field_mapping"].items()}
    tier = config.get("tier_extraction") or {}
    given = [r for r in tier.get("rules") or [] if "match_contains" in r]
    rules = [((r["match_contains"],) if isinstance(r["match_contains"], str) else tuple(r["match_contains"]), r.get("tier")) for r in given]
    default = next((r["default"] for r in tier.get("rules") or [] if "default" in r), tier.get("default"))
    directions = {
        name: Direction({k: d[k] for k in LIFTED if d.get(k) is not None}, d.get("intent_override"), d.get("tier_threshold_override") or {}, bool("sub_directions" in d))
        for name, d in (config.get("direction_decomposition") or {}).items()
    }
    thresholds = config.get("tier_thresholds") or {}
    wrong = {
        "tier source": {tier.get("source", V.BY_STATUS)} - {V.BY_STATUS, V.BY_REMARK},
        "tiers": {t for _, t in rules} - {*V.TIERS},
        "types": {t for _, t in targets.values()} - {*TYPES},
        "intents": {v for v in (config.get("intent_mapping") or {}).values()} - {*V.INTENTS},
        "thresholds": {k for own in (thresholds, *(d.thresholds for d in directions.values())) for k in own} - {*V.HITS},
    }
    if any(wrong.values()):
        raise ValueError("unknown " + "; ".join(f"{k}: {sorted(map(str, v))}" for k, v in wrong.items() if v))
    excluded = [d["direction"] if isinstance(d, Mapping) else d for d in config.get("excluded_directions") or ()]
    computed = {t: spec["sum"] if isinstance(spec, Mapping) else spec for t, spec in (config.get("computed_fields") or {}).items()}
    return Mapping_(
        project_id, targets, tier.get("source", V.BY_STATUS), rules, default, config.get("intent_mapping") or {}, directions, excluded, thresholds, computed,
        config.get("project_specific_fields_to_raw_extra") or (), lineage or {}, lineage_kept,
    )


def undeclared(mapping: Mapping_) -> Column:
    """Columns of a record that the mapping doesn't declare, sorted."""
    return F.array_sort(F.array_except(F.map_keys("fields"), F.array(*map(F.lit, mapping.declared()))))


def transform(records: DataFrame, mapping: Mapping_) -> DataFrame:
    """note_id, the mapped columns, tier, tier_source, intent, flags, raw_extra (JSON) and undeclared of each record."""
    none = F.lit(None).cast("string")
    cell = lambda c: F.try_element_at("fields", F.lit(c))
    raw = lambda target: F.coalesce(none, *map(cell, mapping.columns_of(target)))
    out: dict[str, Column] = {}
    for c, (target, kind) in mapping.fields.items():
        if not target.startswith("_"):
            own = C.coerce(cell(c), kind)
            out[target] = F.coalesce(own, out[target]) if target in out else own
    for target, parts in mapping.computed.items():
        total = R.sum_present(*(C.parse_numeric(cell(c)) for c in parts))
        out[target] = F.coalesce(out[target], total) if target in out else total
    for c, target in mapping.lineage.items():
        out[target] = F.nullif(F.trim(C.flatten_cell(cell(c))), F.lit(""))
    tier_cell = raw("_note_for_tier" if mapping.tier_source == V.BY_REMARK else "_status_raw")
    ruled = tier_cell.isNotNull() & F.lit(bool(mapping.tier_rules))
    tier = F.when(ruled, R.extract_tier(C.status_tokens(tier_cell), mapping.tier_rules, mapping.tier_default))
    source = F.when(ruled, F.lit(mapping.tier_source))
    intent_cell = raw("_intent_raw")
    intent = R.map_intent(F.when(C.kind(intent_cell) == "list", C._elements(intent_cell)).otherwise(F.array_compact(F.array(C.flatten_cell(intent_cell)))), mapping.intents)
    direction = C.flatten_cell(raw("_direction_raw"))
    single = {name: d for name, d in mapping.directions.items() if not d.subs}
    for name in LIFTED:
        texts = {d: ", ".join(v) if isinstance(v, (list, tuple)) else str(v) for d, v in ((d, x.lifted.get(name)) for d, x in single.items()) if v is not None}
        if texts and TARGET_TYPES.get(name) == "array":
            texts_ = R.lift(F.lit(None).cast("string"), direction, texts)
            own = C.split_text(texts_)
        elif texts:
            own = R.lift(F.lit(None).cast("string"), direction, texts)
        else:
            continue
        there = F.array_contains(F.array(F.lit(False), *(F.map_contains_key("fields", c) for c in mapping.columns_of(name))), True)
        out[name] = F.when(there, out[name]).otherwise(own) if name in out else own
    told = {name: d.intent for name, d in single.items() if d.intent}
    intent = F.coalesce(F.try_element_at(R._map(told), direction), intent) if told else intent
    out_of = F.coalesce(direction.isin(*mapping.excluded), F.lit(False)) if mapping.excluded else F.lit(False)
    tier, source = F.when(out_of, V.ANOMALOUS).otherwise(tier), F.when(out_of, V.ANOMALOUS).otherwise(source)
    limit = lambda t: R.threshold(direction, {d: x.thresholds[t] for d, x in mapping.directions.items() if t in x.thresholds}, F.lit(mapping.thresholds.get(t)).cast("double"))
    tier, source = R.numeric_tier(tier, source, out.get("interactions", F.lit(None).cast("double")), limit(V.HIT), limit(V.MEGA_HIT))
    # raw_extra: columns kept by name, and intermediates that nothing else takes or that must stay traceable
    kept = {c: c for c in (*mapping.extra, *mapping.lineage_kept)}
    kept |= {c: t for c, (t, _) in mapping.fields.items() if t.startswith("_") and t not in ("_status_raw", "_note_for_tier", "_intent_raw")}
    extra = {name: cell(c) for c, name in kept.items()} | {"_tier_source_raw": tier_cell}
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in extra.items())), lambda p: p["value"].isNotNull() & ~p["value"].isin('""', "[]", "null"))
    taken = [t for t in out if t not in ("tier", "tier_source", "intent")]
    return records.select(
        F.concat(F.lit(f"{mapping.project_id}_"), "record_id").alias("note_id"),
        F.lit(mapping.project_id).alias("project_id"),
        "record_id",
        *(out[t].alias(t) for t in taken),
        tier.alias("tier"),
        source.alias("tier_source"),
        intent.alias("intent"),
        R.synthetic_flag(raw("_note_status_raw"), tier_cell).alias("flags"),
        F.to_json(F.map_from_entries(pairs)).alias("raw_extra"),
        undeclared(mapping).alias("undeclared"),
    )


#: Columns of which a record must fill one to be a note that lost its text, not a placeholder.
SIGNALS = ("account_id", "publish_url", "impressions", "reads", "interactions", "tier")


def route(rows: DataFrame, signals: Sequence[str] = SIGNALS) -> dict[str, DataFrame]:
    """accepted, quarantine (undeclared columns, or no content) and placeholders (no content and no signal either)."""
    drift, empty = F.size("undeclared") > 0, C.is_null_token(F.col("raw_content"))
    silent = F.lit(True)
    for c in signals:
        if c in rows.columns:
            silent = silent & F.col(c).isNull()
    reason = F.when(drift, "undeclared fields").otherwise("missing raw_content")
    return {
        "accepted": rows.where(~drift & ~empty).drop("undeclared"),
        "quarantine": rows.where(drift | (empty & ~silent)).select("project_id", "record_id", "undeclared", reason.alias("reason")),
        "placeholders": rows.where(~drift & empty & silent).select("project_id", "record_id"),
    }


def metric_rows(rows: DataFrame, collected_at: Column) -> DataFrame:
    """A snapshot of each row that has a metric: its metrics, age in hours and the label of that age."""
    own = [c for c in (*SHARED_METRICS, *ONLY_METRICS) if c in rows.columns]
    at = F.try_to_timestamp(F.col("publish_time")) if "publish_time" in rows.columns else F.lit(None).cast("timestamp")
    hours = F.floor((F.unix_micros(collected_at.cast("timestamp")) - F.unix_micros(at)) / 3_600_000_000)
    some = F.coalesce(*(F.col(c).cast("string") for c in own)).isNotNull() if own else F.lit(False)
    return rows.where(some).select("note_id", R.window_label(at, collected_at).alias("window_label"), collected_at.alias("collected_at"), hours.alias("hours_since_publish"), *own)


def note_rows(rows: DataFrame) -> DataFrame:
    """Rows as notes: without the metrics that only snapshots have."""
    return rows.drop(*(c for c in ONLY_METRICS if c in rows.columns))


def due(sync_interval: Column, scheduled: Column) -> Column:
    """Whether a project is synced: those on demand are left out of scheduled runs."""
    return ~(scheduled & sync_interval.eqNullSafe("on_demand"))


def preflight(records: DataFrame, mapping: Mapping_) -> DataFrame:
    """What ingesting would do, in one row and one pass: counts, ``blocking`` problems and ``warnings``.

    rows, accepted, undeclared, lost (undeclared, but with a text), anomalies (a signal but
    no text), placeholders, other_intents and unknown_directions (of accepted rows).  Lost
    notes and an empty source block; anomalies, intents and directions that the mapping
    doesn't know are warned of.
    """
    rows = transform(records, mapping)
    drift, text = F.size("undeclared") > 0, ~C.is_null_token(F.col("raw_content"))
    signal = F.lit(False)
    for c in SIGNALS:
        if c in rows.columns:
            signal = signal | F.col(c).isNotNull()
    direction = C.flatten_cell(F.get_json_object("raw_extra", "$._direction_raw"))
    known = [*mapping.directions, *mapping.excluded]
    fine = ~drift & text
    one = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(fine).alias("accepted"),
        F.count_if(drift).alias("undeclared"),
        F.count_if(drift & text).alias("lost"),
        F.count_if(~drift & ~text & signal).alias("anomalies"),
        F.count_if(~drift & ~text & ~signal).alias("placeholders"),
        F.count_if(fine & (F.col("intent") == "other")).alias("other_intents"),
        F.count_if(fine & direction.isNotNull() & ~F.coalesce(direction.isin(*known), F.lit(False))).alias("unknown_directions"),
    )
    blocking = [F.when(F.col("rows") == 0, "no rows"), F.when(F.col("lost") > 0, "notes would be lost")]
    warned = [F.when(F.col(c) > 0, c) for c in ("anomalies", "other_intents", "unknown_directions")]
    return one.withColumns({"blocking": F.array_compact(F.array(*blocking)), "warnings": F.array_compact(F.array(*warned))})


def write_dead_letters(failures: DataFrame, path: str, batch: str) -> None:
    """Write the failed rows of a batch as JSON lines under its name; a batch that is tried again replaces its own."""
    failures.write.mode("overwrite").json(f"{path}/batch={batch}")
