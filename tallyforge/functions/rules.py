"""Deterministic labelling rules as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V


def _map(values: Mapping) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def extract_tier(tokens: Column, rules: Sequence[tuple[Sequence[str], str]], default: str | None = None) -> Column:
    """Tier of a status: each token takes the first rule (needles, tier) that it contains a needle of, the highest rank wins."""

    def of(token: Column) -> Column:
        out = F.lit(None).cast("string")
        for needles, tier in reversed(rules):
            for needle in needles:
                out = F.when(F.contains(token, F.lit(needle)), tier).otherwise(out)
        return out

    rank = lambda tier: F.coalesce(F.try_element_at(_map(V.TIER_RANK), tier), F.lit(0))
    found = F.transform(F.filter(F.transform(tokens, of), lambda t: t.isNotNull()), lambda t: F.struct(rank(t).alias("rank"), t.alias("tier")))
    return F.coalesce(F.array_max(found)["tier"], F.lit(default).cast("string"))


def map_intent(values: Column, mapping: Mapping[str, str]) -> Column:
    """The one intent that all values map to (a value that is an intent maps to itself), mixed for several, other if none is, null without values."""
    as_intent = lambda v: F.coalesce(F.try_element_at(_map(mapping), v), v) if mapping else v
    mapped = F.array_distinct(F.filter(F.transform(values, as_intent), lambda v: v.isin(*V.INTENTS)))
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, None).when(F.size(mapped) == 1, mapped[0]).when(F.size(mapped) > 1, "mixed").otherwise("other")


def numeric_tier(tier: Column, source: Column, interactions: Column, hit: Column, mega: Column) -> tuple[Column, Column]:
    """Tier and source where an unlabelled or unknown note's interactions reach its thresholds."""
    open_ = (tier.isNull() | (tier == V.UNKNOWN)) & interactions.isNotNull()
    implied = F.when(open_ & (interactions >= mega), V.MEGA_HIT).when(open_ & (interactions >= hit), V.HIT)
    return F.coalesce(implied, tier), F.when(implied.isNotNull(), V.INFERRED).otherwise(source)


def threshold(direction: Column, overrides: Mapping[str, float], common: Column) -> Column:
    """A direction's own threshold, else the project's."""
    return F.coalesce(F.try_element_at(_map(overrides), direction), common) if overrides else common


def excluded(direction: Column, tier: Column, directions: Sequence[str]) -> Column:
    """Tier with that of excluded directions made anomalous."""
    return F.when(F.coalesce(direction.isin(*directions), F.lit(False)), V.ANOMALOUS).otherwise(tier)


def synthetic_flag(note_status: Column, tier_text: Column) -> Column:
    """JSON that says whether, and why, a note's metrics count as made up; null where neither text is there."""
    watched, fake = F.coalesce(F.contains(note_status, F.lit("关注")), F.lit(False)), F.coalesce(F.contains(tier_text, F.lit("伪爆贴")), F.lit(False))
    reasons = F.array_join(F.array_compact(F.array(F.when(watched, "note status"), F.when(fake, "tier source"))), "; ")
    yes = F.to_json(F.struct(F.lit(True).alias("synthetic"), reasons.alias("synthetic_reason")))
    return F.when(watched | fake, yes).when(note_status.isNotNull() | tier_text.isNotNull(), '{"synthetic":false}')


def window_label(published: Column, collected: Column) -> Column:
    """Label of the age at which metrics were taken; before publishing, unknown or after a year: ad_hoc."""
    hours = F.floor((F.unix_micros(collected.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 3_600_000_000)
    out = F.lit(V.WINDOW_LABELS[-1])
    for label, first, end in reversed(list(zip(V.WINDOW_LABELS, V.WINDOW_HOURS, V.WINDOW_HOURS[1:]))):
        out = F.when((hours >= first) & (hours < end), label).otherwise(out)
    return out


def sum_present(*parts: Column) -> Column:
    """Sum of the parts that are there; null if none is."""
    total = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def lift(present: Column, direction: Column, attribute: Mapping[str, str]) -> Column:
    """A column, filled from its direction's attribute where it is absent."""
    return F.coalesce(present, F.try_element_at(_map(attribute), direction)) if attribute else present


def platform_code(platform: Column, codes: Mapping[str, str]) -> Column:
    """A platform's code; one that is not listed is an error."""
    return F.coalesce(F.try_element_at(_map(codes), platform), F.raise_error(F.concat(F.lit("unknown platform: "), F.coalesce(platform, F.lit("null")))))


def migrate_array(values: Column, moves: Mapping[str, str | None]) -> Column:
    """Elements renamed by ``moves`` (None drops one), each kept once, in order."""
    known = _map({k: v or "" for k, v in moves.items()})
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.coalesce(F.try_element_at(known, v), v)), lambda v: v != ""))


def migrate_scalar(value: Column, moves: Mapping[str, str | None]) -> Column:
    return F.nullif(F.coalesce(F.try_element_at(_map({k: v or "" for k, v in moves.items()}), value), value), F.lit(""))


#: How a commenter's name begins, and the role it means; any other name is 素人.
ROLE_PREFIXES = {"贴主": "贴主", "原帖作者": "贴主", "运营": "运营", "客服": "运营"}
PLAIN_ROLE = "素人"


def comment_lines(block: Column) -> Column:
    """role and content of each line of a block of comments, in order; blank and number-only lines go.

    "1. name: text" and "(1)、name | text" lose number and name (a name before a colon has 20
    characters at most); a bar comes before a colon.
    """
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")

    def parse(line: Column) -> Column:
        rest = F.regexp_replace(line, r"(?U)^\(?\d+\)?[.、]\s*", "")
        bar, colon = F.contains(rest, F.lit("|")), rest.rlike(r"(?U)^[^:：]{1,20}[:：]\s*.+$")
        name = strip(F.when(bar, F.substring_index(rest, "|", 1)).when(colon, F.regexp_extract(rest, r"^([^:：]{1,20})[:：]", 1)).otherwise(""))
        said = strip(F.when(bar, F.regexp_replace(rest, r"^[^|]*\|", "")).otherwise(F.regexp_replace(rest, r"^[^:：]{1,20}[:：]", "")))
        role = F.lit(None).cast("string")
        for prefix, value in reversed(ROLE_PREFIXES.items()):
            role = F.when(name.startswith(prefix), value).otherwise(role)
        content = F.when(bar | (colon & (role.isNotNull() | (said != ""))), said).otherwise(rest)
        return F.struct(F.coalesce(role, F.lit(PLAIN_ROLE)).alias("role"), content.alias("content"))

    lines = F.transform(F.split(block, "\r\n|[\n\r\\x0B\\f\\x1c-\\x1e\\x85\u2028\u2029]"), strip)
    return F.transform(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"(?U)^\d+[.、]?$")), parse)


def comments(notes: DataFrame, block: str = "comment_block") -> DataFrame:
    """One row per parsed comment: comment_id ({note}_c{n}, from 1), note_id, comment_order, role, content."""
    parsed = notes.select("note_id", F.posexplode(comment_lines(F.col(block))).alias("at", "c"))
    return parsed.select(F.format_string("%s_c%d", F.col("note_id").cast("string"), F.col("at") + 1).alias("comment_id"), "note_id", (F.col("at") + 1).alias("comment_order"), "c.role", "c.content")


#: Levers by the valence that must go with them.
LEVER_VALENCE = {
    "negative": ("焦虑撬动", "羞耻撬动", "恐惧撬动", "愤怒撬动", "罪恶感撬动"),
    "positive": ("造梦投射", "认同感建立", "归属感建立", "共鸣释放", "虚荣撬动"),
    "neutral": ("好奇驱动", "信息差利用"),
}


def annotation_errors(row: Mapping[str, Column], closed: Mapping[str, Sequence[str]]) -> Column:
    """What is wrong with an annotation, as names of its broken rules.

    ``closed``: allowed values of lever, valence, intensity, archetypes, trends and
    content_format.  Scalars must be there and allowed; one or two archetypes and one or
    more trends, all allowed, 通用 alone; a lever goes with its valence.
    """
    outside = lambda c: ~F.coalesce(row[c].isin(*closed[c]), F.lit(False))
    count = lambda c: F.coalesce(F.size(row[c]), F.lit(0))
    strange = lambda c: F.exists(row[c], lambda x: ~F.coalesce(x.isin(*closed[c]), F.lit(False)))
    checks = [F.when(outside(c), c) for c in ("lever", "valence", "intensity")]
    checks += [
        F.when(~count("archetypes").between(1, 2), "archetypes: one or two").when(strange("archetypes"), "archetypes"),
        F.when(count("trends") < 1, "trends: missing").when(strange("trends"), "trends"),
        F.when((count("trends") > 1) & F.array_contains(row["trends"], V.ANY_TREND), "trends: exclusive"),
        F.when(outside("content_format"), "content_format"),
        *(F.when(row["lever"].isin(*levers) & ~row["valence"].eqNullSafe(F.lit(valence)), "lever against valence") for valence, levers in LEVER_VALENCE.items()),
    ]
    return F.array_compact(F.array(*checks))


def lesson_errors(lesson: Mapping[str, Column]) -> Column:
    """Names of a lesson's texts that are missing or blank."""
    return F.array_compact(F.array(*(F.when(F.trim(F.coalesce(c, F.lit(""))) == "", name) for name, c in lesson.items())))


def reference_sample(row: Mapping[str, Column], comments_: Column, origin: str = "synced") -> Column:
    """A note as a reference sample.

    Title from its first line (80 characters at most), quality by tier, comments with a
    text as (text, role, pinned), tags of its ``origin`` and tier, lineage as JSON.
    """
    first = F.left(F.substring_index(F.coalesce(row["raw_content"], F.lit("")), "\n", 1), F.lit(80))
    quality = F.when(row["tier"] == V.MEGA_HIT, 200).when(row["tier"] == V.HIT, 100).otherwise(0)
    told = F.filter(comments_, lambda c: F.coalesce(c["content"], F.lit("")) != "")
    top = F.transform(told, lambda c: F.struct(c["content"].alias("text"), c["role"].alias("role"), F.coalesce(c["pinned"], F.lit(False)).alias("pinned")))
    return F.struct(
        F.when(first != "", first).otherwise("未命名样本").alias("title"),
        F.coalesce(row["raw_content"], F.lit("")).alias("content_text"),
        F.coalesce(top, F.array().cast("array<struct<text:string,role:string,pinned:boolean>>")).alias("top_comments"),
        F.array_compact(F.array(F.lit(origin), F.nullif(row["tier"], F.lit("")))).alias("tags"),
        quality.alias("quality_score"),
        F.to_json(F.struct(row["note_id"].alias("note_id"), row["project_id"].alias("project_id"), row["tier"].alias("tier"), row["intent"].alias("intent"))).alias("lineage"),
    )


def majority(shares: Column) -> Column:
    """The name with the greatest share of a map, the first by its name of equal ones."""
    best = F.array_sort(F.map_entries(shares), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    return F.try_element_at(best, F.lit(1))["key"]


def audience_calibration(gender: Column, age: Column, city: Column, inferred_gender: Column, inferred_ages: Column, inferred_cities: Column, most: float = 0.7) -> Column:
    """Whether an inferred audience agrees with the measured one: age_match, gender_match and city_match.

    A gender of more than ``most`` is the audience's, else it is mixed; the first inferred
    age band must be the greatest measured one, and the greatest city among those inferred.
    """
    share = lambda name: F.coalesce(F.try_element_at(gender, F.lit(name)), F.lit(0.0))
    measured = F.when(share("female") > most, "female").when(share("male") > most, "male").otherwise("mixed")
    return F.struct(
        (majority(age) == F.try_element_at(inferred_ages, F.lit(1))).alias("age_match"),
        (measured == inferred_gender).alias("gender_match"),
        F.array_contains(inferred_cities, majority(city)).alias("city_match"),
    )


def audience_flags(targets: Column, inferred_gender: Column, inferred_ages: Column, gender_of: Mapping[str, str], ages_of: Mapping[str, Sequence[str]]) -> Column:
    """Where an inferred audience contradicts the targeted one: structs of type and severity.

    ``gender_of`` and ``ages_of`` say what a target implies.  Genders contradict (high) if
    one is implied and another inferred; ages (medium) if implied and inferred ones share none.
    """
    wanted = F.array_distinct(F.filter(F.transform(targets, lambda t: F.try_element_at(_map(gender_of), t)), lambda g: g.isNotNull()))
    gender = F.when(F.size(wanted) == 1, wanted[0])
    bands = F.create_map(*(x for t, own in ages_of.items() for x in (F.lit(t), F.array(*map(F.lit, own)))))
    ages = F.flatten(F.filter(F.transform(targets, lambda t: F.try_element_at(bands, t)), lambda a: a.isNotNull()))
    flag = lambda kind, severity: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"))
    return F.array_compact(
        F.array(
            F.when((inferred_gender != "mixed") & (gender != inferred_gender), flag("gender_mismatch", "high")),
            F.when((F.size(ages) > 0) & (F.size(inferred_ages) > 0) & ~F.arrays_overlap(ages, inferred_ages), flag("age_no_overlap", "medium")),
        )
    )
