"""A training-corpus pipeline over ``documents``: from raw texts to packed token sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  So a stage
may delete the tables that earlier ones needed: write a stage's result before calling a
later stage.
"""

from __future__ import annotations

import contextvars
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import line_dedup, near_dedup, packing, quality, suffix_dedup
from tallyforge.llm.common import cut, drop_tables, in_small_batches, owned_by, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The run that stages belong to; stages that are called one by one are of the run over their folder.
_run: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)
#: Words of a passage that may not be left twice, and the bytes that so many have at least, in any language.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 2 * PASSAGE_WORDS - 1


@in_small_batches()
def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels, selects.

    A null or empty text is graded like any other, repeated rows alike; extra columns go;
    an empty table stays empty.  Without labels all grades are equally likely, and none is
    selected.
    """
    graded = quality.grade(docs.select(*COLUMNS), quality.trained(spark, docs, sf_dir))
    return graded.where("selected").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their hosts' boilerplate lines.

    No row goes: a page of boilerplate alone becomes empty, a null text stays null; a null
    source is a host, repeated rows are pages of their own, extra columns go.
    """
    kept = line_dedup.line_dedup(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least doc_id.

    Null and empty texts are copies of each other, a null id counts as greatest, one of
    rows repeated whole stays; extra columns go.
    """
    with small_batches(spark):  # what is left to do is a join
        return near_dedup.near_dedup(docs.select(*COLUMNS))


@in_small_batches()
def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of more than 50 words that stand anywhere else, each as one whole.

    No row goes: a text of such passages alone becomes empty, a null text stays null;
    repeated rows hold each other's passages; extra columns go.
    """
    return suffix_dedup.suffix_dedup(docs.select(*COLUMNS), length=PASSAGE_BYTES, anchor=32, least_words=PASSAGE_WORDS)


@in_small_batches()
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences.

    A null or empty text is one end token; null and repeated ids and repeated rows are
    documents of their own; an empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _stage(k: int, name: str, run: Stage) -> tuple[str, Stage]:
    """A stage that first deletes what earlier stages left in the shared folder, since their results are written by now."""

    def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        of = _run.get() or sf_dir
        for earlier in range(k):
            drop_tables(spark, f"stage {earlier}", of)
        with owned_by(f"stage {k}", of):
            return run(spark, docs, sf_dir)

    return name, functools.wraps(run)(cleaned)


STAGES = [
    _stage(0, "quality classifier", select_quality),
    _stage(1, "line dedup", drop_lines),
    _stage(2, "n-gram Jaccard join", drop_near_copies),
    _stage(3, "suffix-array dedup", drop_passages),
    _stage(4, "best-fit packing", pack),
]
#: The classifier, the set comparison and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), _run.set(uuid.uuid4().hex)
    try:
        for name, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir), "".join(c if c.isalnum() else "_" for c in name))
        return docs
    finally:
        _run.reset(before)
