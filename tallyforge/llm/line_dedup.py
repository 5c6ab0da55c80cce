"""Site-relative line dedup, in DataFrame functions alone.

A line is boilerplate of its host if the share of the host's pages that hold it exceeds
``ratio``; what stands on one page alone repeats nothing and stays, however small the host.
A caller may also ask for a ``floor``: then, on hosts of few pages, the line must exceed so
many pages or half of them, whichever is less.
Lines are counted by host and digest after a partial aggregation in each task, so neither a
large host nor a line that stands on every page meets in one task as rows, and texts stay
where they are: the boilerplate found is sent to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_HOT, cut

RATIO = 0.1
#: Pages that a line must be on at least.
LEAST_PAGES = 2
#: Digests of boilerplate (16 bytes each) that are sent to every task; more are joined.
MOST_BROADCAST = 500_000
#: Pages of a host that meet in one task if the boilerplate is joined.
PAGES_A_TASK = 20_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.encode(line, "UTF-8")))


def boilerplate(pages: DataFrame, ratio: float = RATIO, floor: int = 0, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host``, its ``total`` pages and ``drop``, the digests of its boilerplate lines.

    As each line of ``drop`` takes ``ratio`` of the host's pages, the array holds at most
    (distinct lines of an average page) / ``ratio`` digests, whatever the host's size.
    """
    distinct = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _digest))
    counts = pages.select("host", F.explode(distinct).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    totals = pages.groupBy(F.col("host").alias("t_host")).agg(F.count(F.lit(1)).alias("total"))
    exceeds = F.col("total") * F.lit(ratio)
    if floor:
        exceeds = F.greatest(exceeds, F.least(F.col("total") * 0.5, F.lit(float(floor))))
    return (
        counts.join(totals, F.col("host").eqNullSafe(F.col("t_host")))
        .where(F.col("n") > exceeds)
        .groupBy("host")
        .agg(F.first("total").alias("total"), F.collect_list("line").alias("drop"))
    )


def line_dedup(docs: DataFrame, ratio: float = RATIO, floor: int = 0, least_pages: int = LEAST_PAGES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``docs`` without their hosts' boilerplate lines; ``source`` is the host.

    Adds ``n_lines`` and ``n_dropped`` and changes ``text``; the other columns of
    documents are kept and extra ones dropped.  Null text stays null (no lines), a null
    source is a host of its own, blank lines (nothing or spaces only; a tab is no space)
    are neither counted nor dropped, a line repeated in one page counts once and goes
    everywhere, a page of boilerplate alone becomes empty, repeated rows are pages of
    their own, a text of any length is worked on whole, and an empty table gives an empty
    result.
    """
    pages = docs.select(F.col("source").alias("host"), "text")
    found = cut(boilerplate(pages, ratio, floor, least_pages), "boilerplate").select(F.col("host").alias("b_host"), "total", "drop")
    digests, listed = (x or 0 for x in found.agg(F.sum(F.size("drop")), F.sum("total")).first())
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    same = F.col("source").eqNullSafe(F.col("b_host"))
    if digests <= most_broadcast:
        joined = own.join(F.broadcast(found), same, "left")
    else:  # a large host's pages go to several tasks, each with a copy of its list; at most MOST_HOT hosts are large
        parts = F.greatest(F.lit(1), F.ceil(F.col("total") / max(PAGES_A_TASK, listed // MOST_HOT))).cast("int")
        hot = found.where(parts > 1).select("b_host", parts.alias("parts"))
        salt = F.coalesce(F.pmod(F.xxhash64("doc_id", F.length("text")), F.col("parts")), F.lit(0)).alias("salt")
        salted = own.join(F.broadcast(hot), same, "left").select(*own.columns, salt)
        copied = found.select("b_host", "drop", F.explode(F.sequence(F.lit(0), parts - 1)).alias("b_salt"))
        joined = salted.join(copied.hint("merge"), same & (F.col("salt") == F.col("b_salt")), "left")
    lines = _lines(F.col("text"))
    left = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop"), _digest(x))))
    return joined.select(
        "doc_id",
        F.array_join(left, "\n").alias("text"),
        "lang",
        "source",
        "n_chars",
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size(left), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "text", "n_lines", "n_dropped")


ORACLE = f"""
WITH pages AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
counts AS (
  SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM pages) WHERE trim(line) <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY ALL),
found AS (
  SELECT c.source, list(c.line) AS bad FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {LEAST_PAGES} AND c.n > t.total * {RATIO} GROUP BY ALL),
kept AS (
  SELECT p.doc_id, p.lines, CASE WHEN f.bad IS NULL THEN p.lines ELSE list_filter(p.lines, lambda x: NOT list_contains(f.bad, x)) END AS ok
  FROM pages p LEFT JOIN found f ON p.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, array_to_string(ok, chr(10)) AS text, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(ok), 0) AS n_dropped FROM kept
"""
