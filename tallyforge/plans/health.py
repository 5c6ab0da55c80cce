"""Checks of a store's state, and verdicts on its health."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import aggregates as A
from ..operators.state import orphans

#: What a check that could not be made says.
UNKNOWN = "N/A"


@dataclass(frozen=True)
class There:
    """Whether a table, or a column of it, is there."""

    table: str
    column: str | None = None


@dataclass(frozen=True)
class Where:
    """How many rows of a table meet a condition."""

    table: str
    condition: Column | str | None = None


@dataclass(frozen=True)
class Once:
    """Whether no key (null ones aside) is in a table twice; with ``wanted`` false, whether one is.

    A table or column that is missing keeps no key unique.
    """

    table: str
    columns: Sequence[str]
    wanted: bool = True


@dataclass(frozen=True)
class Repeats:
    """How many keys (null ones aside) are in a table more than once."""

    table: str
    columns: Sequence[str]


@dataclass(frozen=True)
class Rows:
    """How many rows a frame has: for what takes more than one table."""

    frame: Callable[[], DataFrame]


@dataclass(frozen=True)
class Check:
    """What is compared with what is expected."""

    ord: str
    section: str
    name: str
    rule: There | Where | Once | Repeats | Rows
    expected: str


def status(actual: Column, expected: Column) -> Column:
    """pass, unknown, backfill (0 wanted, some there), fail (false) or look, by what was found and wanted."""
    number = F.when(actual.rlike(r"^\d+$"), actual.try_cast("bigint"))
    return (
        F.when(actual == expected, "pass")
        .when(actual == UNKNOWN, "unknown")
        .when(expected.startswith("> 0") & (number > 0), "pass")
        .when((expected == "0") & (number > 0), "backfill")
        .when(F.contains(expected, F.lit("any of")), "see hint")
        .when(actual == "false", "fail")
        .otherwise("look")
    )


def verify(store: Store, checks: Sequence[Check]) -> DataFrame:
    """ord, section, name, actual, expected and status of each check, all in one plan; none of it runs before that does.

    All conditions on the rows of a table are counted in one scan of it, and all its keys
    in one shuffle.  A check whose tables or columns are missing is unknown, not an error.
    """
    known: list[tuple[Check, Column]] = []
    row_checks: dict[str, list[tuple[Check, Column]]] = {}
    key_checks: dict[str, list[Check]] = {}
    frames: list[DataFrame] = []
    for c in checks:
        r = c.rule
        try:
            if isinstance(r, There):
                known.append((c, F.lit(str(store.has(r.table, r.column)).lower())))
            elif isinstance(r, Where):
                condition = F.lit(True) if r.condition is None else F.expr(r.condition) if isinstance(r.condition, str) else r.condition
                store(r.table).where(condition).schema  # resolves it, so that what is missing shows here  # noqa: B018
                row_checks.setdefault(r.table, []).append((c, condition))
            elif isinstance(r, Rows):
                frame = r.frame()
                frames.append(_told(frame.agg(F.count(F.lit(1)).cast("string").alias("_0")), [(c, F.col("_0"))]))
            elif store.has(r.table) and {*r.columns} <= {*store(r.table).columns}:
                key_checks.setdefault(r.table, []).append(c)
            elif isinstance(r, Once):
                known.append((c, F.lit(str(not r.wanted).lower())))
            else:
                raise AnalysisException(f"no column of {r.table}")
        except AnalysisException:
            known.append((c, F.lit(UNKNOWN)))
    for table, own in row_checks.items():
        counts = store(table).agg(*(F.count_if(condition).alias(f"_{i}") for i, (_, condition) in enumerate(own)))
        frames.append(_told(counts, [(c, F.col(f"_{i}").cast("string")) for i, (c, _) in enumerate(own)]))
    for table, own in key_checks.items():
        frames.append(_keys_told(store(table), own))
    if known:
        frames.append(_told(store.spark().range(1), known))
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out.withColumn("status", status(F.col("actual"), F.col("expected")))


def _told(one: DataFrame, found: Sequence[tuple[Check, Column]]) -> DataFrame:
    """A row for each check from the one row of ``one``."""
    rows = [F.struct(*(F.lit(getattr(c, k)).alias(k) for k in ("ord", "section", "name")), actual.alias("actual"), F.lit(c.expected).alias("expected")) for c, actual in found]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _keys_told(table: DataFrame, checks: Sequence[Check]) -> DataFrame:
    key = lambda columns: F.to_json(F.array(*(F.col(c).cast("string") for c in columns)))
    full = lambda columns: F.forall(F.array(*(F.col(c).isNotNull() for c in columns)), lambda x: x)
    keys = [F.when(full(c.rule.columns), F.struct(F.lit(i).alias("i"), key(c.rule.columns).alias("key"))) for i, c in enumerate(checks)]
    each = table.select(F.explode(F.array_compact(F.array(*keys))).alias("k")).groupBy("k.i", "k.key").agg(F.count(F.lit(1)).alias("n"))
    repeated = each.agg(*(F.count_if((F.col("i") == i) & (F.col("n") > 1)).alias(f"_{i}") for i in range(len(checks))))
    number = [F.col(f"_{i}") for i in range(len(checks))]
    said = [((n == 0) == c.rule.wanted if isinstance(c.rule, Once) else n).cast("string") for n, c in zip(number, checks, strict=True)]
    return _told(repeated, list(zip(checks, said, strict=True)))


class Store:
    """Tables by name, as functions that read them; one that is missing raises when it is asked for."""

    def __init__(self, tables: Mapping[str, Callable[[], DataFrame]]):
        self.tables = tables
        self._read: dict[str, DataFrame] = {}  # a table's schema is looked up once

    def __call__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise AnalysisException(f"no table {name}")
        if name not in self._read:
            self._read[name] = self.tables[name]()
        return self._read[name]

    def has(self, table: str, column: str | None = None) -> bool:
        try:
            return column is None and self(table) is not None or column in self(table).columns
        except AnalysisException:
            return False

    def spark(self) -> SparkSession:
        return SparkSession.active()


def owner_mismatches(items: DataFrame, batches: DataFrame, projects: DataFrame, source: str) -> DataFrame:
    """Items that came from ``source`` and belong to another user than their project's owner (if it has one)."""
    owned = batches.join(projects.where(F.col("owner_id").isNotNull()).select("project_id", "owner_id"), "project_id").select("batch_id", "owner_id")
    return items.where(F.col("external_source") == source).join(owned, "batch_id").where(F.col("owner_id") != F.col("user_id"))


def dangling(projects: DataFrame, targets: DataFrame, column: str, owner: str | None = None) -> DataFrame:
    """Projects whose ``column`` names no target, or one without its ``owner``."""
    kept = targets if owner is None else targets.where(F.col(owner).isNotNull())
    return orphans(projects, kept, column, "project_id")


def state_checks(s: Store, source: str = "library", tactic: str = "library_synced") -> list[Check]:
    """The checks of the whole store, in nine sections.

    Tables: notes, projects, evaluations of the library; items, batches, item_projects and
    versions of the writing channel; samples, sample_projects and outputs of the sample
    channel.  Constraints are judged by their data, and policies by their column.
    """
    there, once = There, lambda t, *columns: Once(t, columns)
    rows = lambda t, condition=None: Where(t, condition)
    lost = lambda c, t, key: Rows(lambda: orphans(s("notes"), s(t), c, key))
    listed = [
        ("01", "A", "library is there", there("notes"), "true"),
        ("02", "A", "writing channel is there", there("items"), "true"),
        ("03", "A", "sample channel is there", there("samples"), "true"),
        ("11", "B", "notes", there("notes"), "true"),
        ("12", "B", "notes: time of the second channel", there("notes", "synced_to_channel2_at"), "true"),
        ("13", "B", "projects: project of the second channel", there("projects", "channel2_project_id"), "true"),
        ("14", "B", "evaluations", there("evaluations"), "true"),
        ("15", "B", "one evaluation for each item and kind", once("evaluations", "item_id", "evaluator_type"), "true"),
        ("21", "C", "items", there("items"), "true"),
        ("22", "C", "items: external source", there("items", "external_source"), "true"),
        ("23", "C", "items: external id", there("items", "external_source_id"), "true"),
        ("24", "C", "items: proposed label", there("items", "example_label_proposal"), "true"),
        ("25", "C", "external ids may recur among users", Once("items", ["external_source", "external_source_id"], wanted=False), "true"),
        ("26", "C", "external ids are unique for each user", once("items", "user_id", "external_source", "external_source_id"), "true"),
        ("31", "D", "items have an owner to restrict by", there("items", "user_id"), "true"),
        ("32", "D", "batches have an owner to restrict by", there("batches", "user_id"), "true"),
        ("41", "E", "samples: title", there("samples", "post_title"), "true"),
        ("42", "E", "samples: source note", there("samples", "source_note_id"), "true"),
        ("43", "E", "samples: source note is indexed (any of two ways)", there("samples", "source_note_id"), "true"),
        ("44", "E", "one sample for each source note", once("samples", "source_note_id"), "true"),
        ("45", "E", "source notes with several samples", Repeats("samples", ["source_note_id"]), "0"),
        ("51", "F", "hits", rows("notes", P.hit(F.col("tier"))), "> 0"),
        ("52", "F", "notes on the first channel", rows("notes", "synced_to_channel1_at IS NOT NULL"), "> 0"),
        ("53", "F", "notes on the second channel", rows("notes", "synced_to_channel2_at IS NOT NULL"), "> 0"),
        ("54", "F", "sample packs", rows("samples", "source_type = 'pack'"), "own and synced ones"),
        ("55", "F", "samples of the old type", rows("samples", f"source_type = '{source}_sync'"), "0"),
        ("56", "F", "synced samples with the raw platform", rows("samples", P.has(F.col("tags"), f"{source}_sync") & (F.col("platform") == "xiaohongshu")), "0"),
        ("57", "F", "items from the library", rows("items", f"external_source = '{source}'"), "> 0"),
        ("58", "F", "items of another owner", Rows(lambda: owner_mismatches(s("items"), s("batches"), s("item_projects"), source)), "0"),
        ("59", "F", "batches of synced items", rows("batches", f"tactic = '{tactic}'"), "as many as synced projects"),
        ("60", "F", "positive examples", rows("items", "example_label = 'positive'"), "> 0"),
        ("70", "G", "projects that lead to no or an unowned writing project", Rows(lambda: dangling(s("projects"), s("item_projects"), "channel2_project_id", "owner_id")), "0"),
        ("71", "G", "projects that lead to no sample project", Rows(lambda: dangling(s("projects"), s("sample_projects"), "channel1_project_id")), "0"),
        ("80", "H", "notes of a missing item", lost("source_item_id", "items", "item_id"), "0"),
        ("81", "H", "notes of a missing version", lost("source_version_id", "versions", "version_id"), "0"),
        ("82", "H", "notes of a missing output", lost("source_output_id", "outputs", "output_id"), "0"),
        ("90", "I", "projects that end before they start", rows("projects", "start_date > end_date"), "0"),
    ]
    return [Check(*x) for x in listed]


def saturated(pools: DataFrame, threshold: float = 0.6) -> DataFrame:
    """All pools of positives, with ``saturated``: whether one lever takes ``threshold`` or more."""
    return pools.withColumn("saturated", F.coalesce(F.col("dominant_ratio") >= threshold, F.lit(False)))


def verdict(samples: DataFrame, audits: DataFrame, as_of: Column, days: float = 7, least: float = 0.3) -> DataFrame:
    """Four checks of the loop in one row: their figures, ``problems``, ``advisories`` and whether it is ``healthy``.

    ``samples``: source_note_id, platform, category.  ``audits``: created_at, status and
    output (JSON of db_sourced, static_sourced and total_vibe_cells; what is no number counts
    as 0).  A hit rate below ``least`` over the last ``days``, a warning in the last day or a
    synced sample without platform or category is a problem; nothing synced or audited yet
    is only said.
    """
    synced = F.col("source_note_id").isNotNull()
    own = samples.agg(F.count(F.lit(1)).alias("total"), F.count_if(synced).alias("synced"), F.count_if(synced & (P.blank(F.col("platform")) | P.blank(F.col("category")))).alias("unreachable"))
    since = lambda n: F.col("created_at") >= as_of - F.make_dt_interval(secs=F.lit(n * 86_400.0))
    figure = lambda key: F.coalesce(F.get_json_object("output", f"$.{key}").try_cast("bigint"), F.lit(0))
    recent = lambda key: F.coalesce(F.sum(F.when(since(days), figure(key))), F.lit(0)).alias(key)
    audit = audits.agg(
        F.count_if(since(days)).alias("audit_rows"), recent("db_sourced"), recent("static_sourced"), recent("total_vibe_cells"), F.count_if(since(1) & (F.col("status") == "completed_warn")).alias("warnings")
    )
    rate = A.ratio(F.col("db_sourced"), F.col("total_vibe_cells"))
    row = own.crossJoin(audit).withColumn("hit_rate", rate)
    problems = [F.when(F.col("hit_rate") < least, "hit rate"), F.when(F.col("warnings") > 0, "warnings"), F.when(F.col("unreachable") > 0, "unreachable samples")]
    said = [F.when(F.col("synced") == 0, "nothing synced"), F.when(F.col("audit_rows") == 0, "nothing audited")]
    row = row.withColumns({"problems": F.array_compact(F.array(*problems)), "advisories": F.array_compact(F.array(*said))})
    return row.withColumn("healthy", F.size("problems") == 0)


def exit_codes(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """``exit_code`` of each pass of ``outcomes`` (a row each, by ``outcome``): 1 if it failed as a whole, else 0.

    Any hygiene failure fails it, systemic ones do if nothing succeeded, and failures of
    content alone never do.
    """
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    failed = (n("hygiene") > 0) | ((n("systemic") > 0) & (n("ok") == 0))
    return outcomes.groupBy(*by).agg(failed.cast("int").alias("exit_code"))


def exit_code(outcomes: DataFrame) -> int:
    """That of one pass."""
    return exit_codes(outcomes, []).first()["exit_code"]


def pending_annotations(notes: DataFrame) -> DataFrame:
    """Notes with a text of each project, and how many of them are not annotated yet."""
    worth = notes.where(~P.blank(F.col("raw_content")))
    return worth.groupBy("project_id").agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("annotated_at").isNull()).alias("pending"))


def report(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    lines = [f"# {title}", "", f"| {' | '.join(rows.columns)} |", f"|{' --- |' * len(rows.columns)}"]
    return "\n".join([*lines, *(f"| {' | '.join(map(cell, r))} |" for r in got)])
