"""Keyed state: upserts, audit diffs, cascades and constraint checks, on whole frames; :mod:`.keyed` has tables that are changed by batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, payload: DataFrame, key: Sequence[str], write_once: Sequence[str] = ()) -> DataFrame:
    """Rows of ``table`` with those of ``payload`` (one a key) merged in by key.

    Columns that the payload lacks are preserved, those it has are replaced (null too), and
    ``write_once`` columns only fill what is null.
    """
    new = payload.select(*(F.col(k).alias(f"_{k}") for k in key), *(F.col(c).alias(f"_{c}") for c in payload.columns if c not in key), F.lit(True).alias("_new"))
    joined = table.join(new, [F.col(k) == F.col(f"_{k}") for k in key], "full")

    def value(c: str) -> Column:
        if c in key:
            return F.coalesce(c, f"_{c}")
        if c not in payload.columns:
            return F.col(c)
        return F.coalesce(c, f"_{c}") if c in write_once else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))

    return joined.select(*(value(c).alias(c) for c in table.columns))


def insert_missing(table: DataFrame, payload: DataFrame, key: Sequence[str]) -> DataFrame:
    """``table`` and those rows of ``payload`` whose key it lacks."""
    return table.unionByName(payload.join(table.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def with_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent was written."""
    return children.join(parents.select(key), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children that point to no parent; null points nowhere and is none."""
    own = children.where(F.col(foreign).isNotNull())
    return own.join(parents.select(F.col(key).cast("string").alias("_key")), F.col(foreign).cast("string") == F.col("_key"), "left_anti")


def delete_cascade(children: DataFrame, deleted: DataFrame, foreign: str, key: str) -> DataFrame:
    return children.join(deleted.select(F.col(key).alias("_key")), F.col(foreign) == F.col("_key"), "left_anti")


def delete_set_null(children: DataFrame, deleted: DataFrame, foreign: str, key: str) -> DataFrame:
    gone = deleted.select(F.col(key).alias("_key")).distinct()
    joined = children.join(gone, F.col(foreign) == F.col("_key"), "left")
    return joined.withColumn(foreign, F.when(F.col("_key").isNull(), F.col(foreign))).drop("_key")


def update(table: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """``values`` where ``condition`` holds; the rest is as it was."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def update_from(table: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Null ``columns`` filled from the row of ``source`` with the same key."""
    new = source.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    return table.join(new, F.col(key) == F.col("_key"), "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(*table.columns)


def audit_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """row_id, operation and the changed columns ({column: [old, new]} as JSON); rows without a change give none."""
    columns = [c for c in new.columns if c != key]
    as_map = lambda d, name: d.select(F.col(key).alias(f"{name}_id"), F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("string") for c in columns))).alias(name))
    both = as_map(old, "before").join(as_map(new, "after"), F.col("before_id") == F.col("after_id"), "full")
    empty = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array_repeat(F.lit(None).cast("string"), len(columns)))
    pairs = F.map_zip_with(F.coalesce("before", empty), F.coalesce("after", empty), lambda k, a, b: F.array(a, b))
    changed = F.map_filter(pairs, lambda k, v: ~v[0].eqNullSafe(v[1]))
    operation = F.when(F.col("before_id").isNull(), "INSERT").when(F.col("after_id").isNull(), "DELETE").otherwise("UPDATE")
    rows = both.select(F.coalesce("after_id", "before_id").alias("row_id"), operation.alias("operation"), changed.alias("changed"))
    return rows.where((F.col("operation") != "UPDATE") | (F.size("changed") > 0)).withColumn("changed", F.to_json("changed"))


def reconcile_pointers(parents: DataFrame, children: DataFrame, key: str, pointer: str, parent: str, child: str, order: Sequence[str] = ()) -> DataFrame:
    """``pointer`` kept where it names an own child, else the first child in ``order``, else null."""
    first = children.groupBy(F.col(parent).alias("_parent")).agg(F.min(F.struct(*order, child))[child].alias("_first"))
    own = children.select(F.col(parent).alias("_p"), F.col(child).alias("_c"))
    valid = parents.join(own, (F.col(key) == F.col("_p")) & (F.col(pointer) == F.col("_c")), "left")
    return valid.join(first, F.col(key) == F.col("_parent"), "left").withColumn(pointer, F.coalesce("_c", "_first")).select(*parents.columns)


def date_range(rows: DataFrame, by: str, at: str) -> DataFrame:
    """First and last moment of each group."""
    return rows.where(F.col(at).isNotNull()).groupBy(by).agg(F.min(at).alias("start_date"), F.max(at).alias("end_date"))


def violations(table: DataFrame, key: str, closed: Mapping[str, Sequence[str]] | None = None, required: Sequence[str] = (), unique: Sequence[Sequence[str]] = ()) -> DataFrame:
    """row and rule of each broken constraint; null passes a closed set, and null keys are all different."""
    checks = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), f"{c}: closed set") for c, allowed in (closed or {}).items()]
    checks += [F.when(F.col(c).isNull(), f"{c}: required") for c in required]
    out = table.select(F.col(key).cast("string").alias("row"), F.explode(F.array_compact(F.array(*checks, F.lit(None).cast("string")))).alias("rule"))
    for columns in unique:
        full = table.where(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()).dropna(subset=list(columns))
        repeated = full.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.min(F.col(key).cast("string")).alias("row")).where("n > 1")
        out = out.unionByName(repeated.select("row", F.lit(f"{', '.join(columns)}: unique").alias("rule")))
    return out


def copy_missing(source: DataFrame, target: DataFrame, key: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """``target`` with the rows it lacks, and counts that reconcile the copy, taken in one pass over the keys of both."""
    missing = source.join(target.select(*key), list(key), "left_anti")
    sides = source.select(F.lit(1).alias("s"), F.lit(0).alias("t"), F.lit(0).alias("m")).unionByName(target.select(F.lit(0).alias("s"), F.lit(1).alias("t"), F.lit(0).alias("m")))
    counts = sides.unionByName(missing.select(F.lit(0).alias("s"), F.lit(0).alias("t"), F.lit(1).alias("m"))).agg(F.sum("s"), F.sum("t"), F.sum("m")).first()
    read, before, added = (int(x or 0) for x in counts)
    return target.unionByName(missing, allowMissingColumns=True), {"read": read, "before": before, "added": added, "after": before + added}


def fill(table: DataFrame, column: str, value: Column, where: Column | None = None) -> DataFrame:
    """``column`` set to ``value`` where it is null (and ``where`` holds)."""
    return update(table, F.col(column).isNull() & (F.lit(True) if where is None else where), {column: value})


def field_difference(rows: DataFrame, declared: Sequence[str], fields: str = "fields") -> DataFrame:
    """column, side and rows of the keys of a map column that a declaration lacks (undeclared), and of declared ones that no row has (missing)."""
    present = rows.select(F.explode(F.map_keys(fields)).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("rows"))
    named = rows.sparkSession.createDataFrame([(c,) for c in declared], "declared string")
    both = present.join(F.broadcast(named), F.col("column") == F.col("declared"), "full").where(F.col("column").isNull() | F.col("declared").isNull())
    side = F.when(F.col("declared").isNull(), "undeclared").otherwise("missing")
    return both.select(F.coalesce("column", "declared").alias("column"), side.alias("side"), F.coalesce("rows", F.lit(0)).alias("rows"))
