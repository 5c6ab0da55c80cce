"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rolling import forget_powers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session (tests) names none a temporary one is set; on a cluster
    that is an error, since executors can't see the driver's own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
    return spark.sparkContext.getCheckpointDir()


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/scratch/{spark.sparkContext.applicationId}"


#: Tables that :func:`cut` has written, by run and what they were made for ("" by default).
_tables: dict[tuple[str, str], list[str]] = {}
_owner: contextvars.ContextVar[tuple[str, str]] = contextvars.ContextVar("owner", default=("", ""))


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back, which ends its lineage there.

    A lost executor then costs a re-read, not a recomputation.  The tables stay until
    :func:`drop_tables` is called for their owner (:func:`owned_by`), or the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.setdefault(_owner.get(), []).append(path)
    return spark.read.parquet(path)


@contextlib.contextmanager
def owned_by(owner: str, run: str = ""):
    """Tables that are written meanwhile (by this thread) are the owner's, in that run."""
    before = _owner.set((run, owner))
    try:
        yield
    finally:
        _owner.reset(before)


def drop_tables(spark: SparkSession, owner: str, run: str = "") -> None:
    """Delete the owner's tables; what still reads them must have been written before."""
    for name in _tables.pop((run, owner), []):
        delete_path(spark, name)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that :func:`cut` has written in this application; call it once results are written."""
    delete_path(spark, _scratch(spark))
    _tables.clear()


def delete_path(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of ``doc_id``, modulo ``n`` (null: of the empty text)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % n


def drawn(share: Column, *keys: Column | str) -> Column:
    """True for about ``share`` (1e-12 or more) of all rows, by a hash of ``keys``."""
    steps = 1_000_000
    first, finer = F.pmod(F.xxhash64(*keys), F.lit(steps)), F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(steps))
    return first + finer / steps < share * steps


#: Rows of one key that may meet in one task, and keys with more that a broadcast may hold.
LEAST_SPREAD, MOST_HOT = 400, 4096


def join_spread(many: DataFrame, one: DataFrame, on: list[str], n: str | None, by: list[str], total: int, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a row a key; ``many`` has ``total`` rows.

    Keys of more than max(LEAST_SPREAD, total / MOST_HOT) rows, of which there are at most
    MOST_HOT, are told to all tasks; their rows are dealt by the columns ``by`` to as many
    copies of the key's row as that takes.  ``n`` is a column of ``one`` with the key's rows
    in ``many`` and not in the result; without it they are counted.
    """
    limit = max(LEAST_SPREAD, total // MOST_HOT)
    counted = many.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")) if n is None else one.select(*on, F.col(n).alias("_n"))
    hot = counted.where(F.col("_n") > limit).select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_copies"))
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_copies")), F.lit(0)).cast("int")
    salted = many.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_copies")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1))
    copied = (one if n is None else one.drop(n)).join(F.broadcast(hot), on, "left").withColumn("_salt", salts).drop("_copies")
    return salted.join(copied.hint("merge"), [*on, "_salt"], how).drop("_salt")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Meanwhile Python workers get whole texts in batches of few rows, unless the session asks for fewer anyway; bounds memory alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) > rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_small_batches(rows: int = 2000):
    """For functions of (spark, ...) that return a frame: it is written by :func:`small_batches` and read back, so that the session's setting is as before."""

    def wrap(run):
        @functools.wraps(run)
        def written(spark: SparkSession, *args):
            with small_batches(spark, rows):
                return cut(run(spark, *args), run.__name__)

        return written

    return wrap


def release_memory() -> None:
    """Give back what a finished task no longer holds; Python workers live on and share an executor's memory."""
    import pyarrow as pa

    forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_rows(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInPandas`` whose ``doc_id`` comes and goes as text: pandas has no null among whole numbers."""
    out = df.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, f"doc_id string, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
