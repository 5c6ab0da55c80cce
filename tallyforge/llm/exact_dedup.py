"""Exact dedup over a persistent digest index.

The index is bucketed and sorted by digest, so that looking a new batch up in it shuffles
the batch's digests alone and never the index: a sort-merge semi join finds what is known
of the batch, a sort-merge anti join what is new, and only the batch's rows are appended.
Batches are numbered by their names, and one only meets what batches before it brought: a
batch that is offered again, because its job died or by mistake, gets the result it had.
Rows are reduced to one per digest before they are shuffled; a text that a third of all
rows share costs one row a task, and its rows are dealt to several tasks at the end.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import Files
from .common import bytes_of, cut, delete_path, join_spread, shared_folder


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text's UTF-8 bytes; null counts as empty."""
    return F.sha2(bytes_of(text), 256)


class DigestIndex:
    """Digests seen so far, in a bucketed and sorted table at ``path``.

    ``path`` lies in storage that all executors share.  A later session opens the
    same index by giving the same path and bucket count.  Columns: ``digest``, ``rows``
    (how many rows of one batch held it), ``keep_id`` (the row that stays: the largest
    id of the first batch that held it), which counts only where ``first`` is true, and the
    batch's ``number``; later batches add rows of their own, so nothing is ever rewritten.
    A batch's number is kept, by its name, in a folder beside the index before anything of
    it is written.  One batch is entered at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.batches = f"{path.rstrip('/')}.batches"
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT, rows BIGINT, first BOOLEAN, number BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def number(self, batch: str) -> int:
        """The batch's number: the one it got when it was first offered, else the next."""
        files, name = Files(self.spark, self.batches), hashlib.sha256(batch.encode()).hexdigest()
        taken = {x[10:-5]: int(x[:9]) for x in files.names(self.batches) if x.endswith(".json")}
        if name not in taken:
            taken[name] = max(taken.values(), default=-1) + 1
            files.create(f"{self.batches}/{taken[name]:09d}-{name}.json", batch)
        return taken[name]

    def before(self, number: int | None) -> DataFrame:
        return self.table() if number is None else self.table().where(F.col("number") < number)

    def known(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """digest, old_id and old_rows of the digests of ``batch`` (one row a digest) that the index had before batch ``number``."""
        met = self.before(number).join(batch.select("digest").hint("merge"), "digest", "left_semi")
        return met.groupBy("digest").agg(F.max(F.when(F.col("first"), F.col("keep_id"))).alias("old_id"), F.sum("rows").alias("old_rows"))

    def unseen(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """Rows of ``batch`` (one per digest) whose digest the index lacked before batch ``number``."""
        return batch.join(self.before(number).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, batch: DataFrame, number: int) -> None:
        """Add ``batch`` (digest, keep_id, rows, first; one row a digest), but for what is in under its number."""
        there = self.table().where(F.col("number") == number).select("digest")
        new = batch.select("digest", "keep_id", "rows", "first", F.lit(number).cast("long").alias("number"))
        if not there.isEmpty():
            new = cut(new.join(there.hint("merge"), "digest", "left_anti"), "missing")
        (
            new.repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def forget(self, files: bool = False) -> None:
        """Take the table out of the catalog; the index can be opened again by its path, unless its ``files`` go too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if files:
            delete_path(self.spark, self.path)
            delete_path(self.spark, self.batches)


def digest_groups(docs: DataFrame) -> DataFrame:
    """One row per distinct text: ``digest``, ``keep_id`` (largest doc_id), ``rows``."""
    return (
        docs.select("doc_id", text_digest(F.col("text")).alias("digest"))
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("rows"))
    )


def exact_dedup(docs: DataFrame, index: DigestIndex, name: str | None = None) -> DataFrame:
    """Mark the copies among ``docs`` and against what ``index`` held before; append what is new.

    One row per input row: doc_id, keep_id, group_size, kept, text_sha256.  A text
    that the index knew from an earlier batch keeps that earlier row, so none of the
    new rows stays; otherwise the row with the largest doc_id stays.  ``group_size``
    counts the rows of all batches so far.

    ``name`` names the batch.  The same batch under the same name gives the same rows again
    and leaves the index as it is, also if later batches have come since, or if the job that
    offered it first died at whatever point.  Without a name it is a batch of its own.

    Null text counts as empty; null doc_id sorts below every id (keep_id is null only
    if all of a group's ids are).  Of rows repeated with the same text and id, one is
    kept.  An empty table gives an empty result.  Extra columns are ignored.
    """
    number = index.number(name or uuid.uuid4().hex)
    batch = cut(digest_groups(docs), "batch")
    earlier = cut(index.known(batch, number), "known")  # only what this batch meets, as it was before
    unseen = index.unseen(batch, number).select("digest", "keep_id", "rows", F.lit(True).alias("first"))
    again = batch.join(earlier.select("digest"), "digest", "left_semi").select("digest", "keep_id", "rows", F.lit(False).alias("first"))
    index.append(cut(unseen.unionByName(again), "arrivals"), number)
    groups = batch.join(earlier, "digest", "left").select(
        "digest",
        "rows",
        F.coalesce("old_rows", F.lit(0)).alias("old_rows"),
        F.col("old_rows").isNotNull().alias("known"),
        F.when(F.col("old_rows").isNotNull(), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
    )
    groups = groups.withColumn("group_size", F.col("rows") + F.col("old_rows"))
    rows = (
        docs.select("doc_id", text_digest(F.col("text")).alias("digest"))
        .groupBy("digest", "doc_id")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    total = batch.agg(F.sum("rows")).first()[0] or 0
    return (
        join_spread(rows, groups.drop("old_rows"), ["digest"], "rows", ["doc_id"], total)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` as one batch into a fresh index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, f"{shared_folder(spark)}/digest_index/{uuid.uuid4().hex}")
    marked = exact_dedup(docs, index)
    index.forget(files=True)  # the result doesn't read it
    return marked


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
