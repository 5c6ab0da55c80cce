"""Aggregates: guarded ratios, exact percentiles, distributions and shares at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialised


def ratio(x: Column, n: Column) -> Column:
    """x / n as a double; null where n is null or 0."""
    return F.when(n != 0, x.cast("double") / n)


def percent(x: Column, n: Column, digits: int = 1) -> Column:
    return F.round(ratio(100 * x.cast("double"), n), digits)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def whole_mean(c: Column) -> Column:
    """The mean, rounded half up to a whole number."""
    return F.round(F.avg(c)).cast("int")


def sorted_set(c: Column) -> Column:
    """Distinct values, sorted; nulls are left out."""
    return F.sort_array(F.collect_set(c))


def percentiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Exact percentiles with linear interpolation of each group, and n; null where it has no values.

    From :func:`value_ranks`: values are counted, and only the counts near the wanted ranks
    are looked at, so no task holds a group's values.  ``value`` is numeric.
    """
    ranks = value_ranks(df.select(*by, F.col(value).cast("double").alias(value)), value, by=by)
    v, total = F.col(value), F.col("total")
    below = total - F.col("before") - F.col("n")  # values less than this one
    held = lambda k: (below <= k) & (k < below + F.col("n"))
    out = []
    for p in points:
        at = F.lit(p) * (total - 1)
        low, high = F.max(F.when(held(F.floor(at)), v)), F.max(F.when(held(F.ceil(at)), v))
        part = F.max(at - F.floor(at))
        out.append(((1 - part) * low + part * high).alias(f"p{round(100 * p)}"))
    found = ranks.groupBy(*by).agg(F.max("total").alias("n"), *out)
    empty = df.groupBy(*by).agg(F.count(value).alias("_n")).where("_n = 0").select(*by, F.lit(0).cast("bigint").alias("n"), *(F.lit(None).cast("double").alias(f"p{round(100 * p)}") for p in points))
    return found.unionByName(empty)


def upper_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The value at index n // 2 of each group's sorted (numeric) values, from :func:`value_ranks`."""
    below, at = F.col("total") - F.col("before") - F.col("n"), F.floor(F.col("total") / 2)
    return value_ranks(df, value, by=by).where((below <= at) & (at < below + F.col("n"))).select(*by, F.col(value).alias("median"))


def distribution(df: DataFrame, columns: Sequence[str], cap: int | None = None) -> DataFrame:
    """How often each value of each column occurs: column, value, n and its rank by count (ties by value); ``cap`` values of each.

    One pass over the table whatever the number of columns; nulls count as "".  With a
    ``cap`` Spark keeps so many of a column in each task; without one ranks come from
    :func:`ordinals`, so that a column of very many values is not sorted in one task.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns))).alias("p")
    counts = df.select(pairs).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    if cap is not None:
        ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value")))
        return ranked.where(F.col("rank") <= cap)
    placed = ordinals(counts, ["column"], [F.desc("n"), F.asc("value")])
    return placed.select("column", "value", "n", (F.col("before") + 1).cast("int").alias("rank"))


def ordinals(df: DataFrame, by: Sequence[str], order: Sequence[Column], weight: str | None = None) -> DataFrame:
    """``df`` with how many rows (or how much ``weight``) come ``before`` each in its group's order, and the group's ``total``.

    The rows are sorted by ranges of group and order, whose splitters Spark draws from a
    sample, so that values however close or alike are dealt out evenly.  Each range is
    numbered in its own task, and starts where the ranges of its group before it end, one
    sum a group and range.  Rows that ``order`` doesn't tell apart are numbered in any order
    and meet in one range: count them first where they may be many.  The sorted rows are
    written to the shared folder, so that both readings of them see the same ranges.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *(F.asc(c) for c in by), *order).withColumn("_range", F.spark_partition_id())
    held = materialised(ranged)
    sums = held.groupBy(*by, "_range").agg(F.sum(one).alias("_own"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = F.sum("_own").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_range").alias("_of"), F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_own").over(group).alias("total"))
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = F.sum(one).over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    numbered = held.withColumn("_within", F.coalesce(within, F.lit(0))).join(sums, same)
    return numbered.select(*df.columns, (F.col("_within") + F.col("_ahead")).alias("before"), "total")


def value_ranks(df: DataFrame, value: str, extra: Sequence[Column] = (), by: Sequence[str] = ()) -> DataFrame:
    """One row for each value of each group, from the largest: n, how many rows come ``before`` it, and the ``total``.

    Rows are counted by value in every task before those counts are put in order by ranges
    (:func:`ordinals`), so no task sees all values of a group, nor all rows of a value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *extra)
    return ordinals(counts, by, [F.desc(value)], "n")


def ntile_end(total: Column, tiles: int, tile: int) -> Column:
    """How many rows the first ``tile`` of ``tiles`` hold; the remainder goes to the first tiles, one each."""
    return F.floor(total / tiles) * tile + F.least(total % tiles, F.lit(tile))


def json_sum(c: Column, key: str) -> Column:
    """Sum of a JSON object's numbers under a key; what is no number counts as 0."""
    return F.sum(F.coalesce(F.get_json_object(c, f"$.{key}").try_cast("bigint"), F.lit(0)))
