"""Best-fit packing by minimum bin slack over the length histogram.

Lengths are whole numbers up to the capacity, so all that a packing depends on is how
many pieces of each length there are: a histogram of at most ``capacity`` counts, which
is all that reaches the driver.  There, bin after bin is filled by a subset-sum dynamic
program over bitsets; a fullest combination is used again for as long as its pieces
last.  The pieces then find their places by their rank in their length, which is
counted by task and length and never sorts or gathers the pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, in_small_batches, map_rows, release_memory
from .tokens import CachedEncoder, StreamEncoder, merge_ranks, slices

CAPACITY = 2048
#: Characters of texts whose words are held at once, a text at least; bounds memory alone.
SLICE = 500_000
#: Rows of a task's and length's first rank that are broadcast.
MOST_FIRSTS = 200_000


@dataclass(frozen=True)
class Pattern:
    """``times`` bins, each with ``uses`` = (length, how many) in the order they are laid out."""

    times: int
    uses: tuple[tuple[int, int], ...]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """A largest subset sum of at most ``room``: how many pieces of each length; long ones first."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left:  # as 1, 2, 4, ... pieces at once
            part = min(part, left)
            after = (reach | reach << (length * part)) & mask
            if after != reach:
                steps.append((reach, length, part))
                reach = after
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for before, length, part in reversed(steps):
        if not before >> total & 1:
            total -= length * part
            out[length] = out.get(length, 0) + part
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Bins for ``counts`` pieces of each length, most alike ones together.

    Each bin takes the longest piece that is left and the combination of others that fills
    it most.  Each pattern uses up some length but for a remainder below its own use of it,
    so there are at most sum(1 + capacity / length) patterns, whatever the counts.
    """
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        uses = fullest({k: v for k, v in left.items() if v}, capacity - seed)
        left[seed] += 1
        uses[seed] = uses.get(seed, 0) + 1
        times = min(left[k] // v for k, v in uses.items())
        out.append(Pattern(times, tuple(sorted(uses.items(), reverse=True))))
        for k, v in uses.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
    return out


def _slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, for its pieces in order of rank: first rank, first bin, use and offset of each pattern."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first_bin = 0
    for p in patterns:
        offset = 0
        for length, use in p.uses:
            first = ranks.get(length, 0)
            rows.setdefault(length, []).append((first, first_bin, use, offset))
            ranks[length] = first + use * p.times
            offset += length * use
        first_bin += p.times
    return {k: tuple(np.array(x, dtype="int64") for x in zip(*v, strict=True)) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs length (1 to ``capacity``), task and rank.

    ``task`` and ``rank`` number the pieces of one length within the task that made them,
    without gaps from 0.  Ties and repeated rows are pieces of their own; no pieces give
    no sequences.
    """
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut(by_task.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "firsts")
    counts = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(minimum_bin_slack(counts, capacity))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), (pdf["first"] + pdf["rank"]).to_numpy()
            sequence, offset = np.empty(len(pdf), "int64"), np.empty(len(pdf), "int64")
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts):
                if not len(own):
                    continue
                n = int(length[own[0]])
                start, first_bin, use, at = slots[n]
                k = np.searchsorted(start, rank[own], side="right") - 1
                within = rank[own] - start[k]
                sequence[own] = first_bin[k] + within // use[k]
                offset[own] = at[k] + within % use[k] * n
            yield pdf.drop(columns=["task", "rank", "first"]).assign(sequence_id=sequence, offset=offset)

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("doc_id", "task", "rank")]
    joined = place_in_length(pieces, firsts).select(*pieces.columns, "first")
    return map_rows(joined, place, ", ".join([*kept, "sequence_id long", "offset long"]))


def place_in_length(pieces: DataFrame, firsts: DataFrame) -> DataFrame:
    """``pieces`` with ``first``: how many pieces of their length the tasks before theirs made.

    ``firsts`` has a row for each task and length, 16 bytes each: at most MOST_FIRSTS of them
    are sent to every task, more are joined, a task's pieces of a length with one row.
    """
    first = firsts.select("length", "task", "first")
    return pieces.join(F.broadcast(first) if first.count() <= MOST_FIRSTS else first.hint("merge"), ["length", "task"])


def _word_ids(path: str):
    """Ids of a word under the lower-casing word tokenizer; None for words that its library must see."""
    import re

    ranks = merge_ranks(path)
    plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?]*)")

    def word(x: str) -> list[int] | None:
        if not (m := plain.fullmatch(x)):
            return None
        ids = ranks.piece(m[1].lower().encode() + ranks.END)
        return ids + ranks.piece(m[2].encode() + ranks.END) if m[2] else ids

    return word


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, and task and rank for :func:`pack`.

    A document is its ids and then ``end_id``, so a null or empty text has one id.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memory()  # of what an earlier step's tasks left in this worker
        own = StreamEncoder(path, CachedEncoder(path, str.split, _word_ids(path)), end_id, SLICE)
        task, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
            for a, b in slices(texts, SLICE):
                rows, first = [], 0
                tokens, ends = own.encode(texts[a:b])
                for doc_id, last in zip(ids[a:b], ends.tolist(), strict=True):
                    for piece, start in enumerate(range(first, last, capacity)):
                        part = tokens[start : min(last, start + capacity)]
                        n = len(part)
                        rows.append((doc_id, piece, start - first, n, zlib.crc32(part), task, ranks[n]))
                        ranks[n] += 1
                    first = last
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])
        del own
        release_memory()

    schema = "piece int, start long, length long, ids_crc32 long, task int, rank long"
    return map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids; one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Documents longer
    than ``capacity`` are cut; the others stay whole.  Null text counts as empty; null or
    repeated doc_ids and repeated rows are documents of their own; extra columns are ignored.
    """
    return pack(cut(cut_documents(docs, path, capacity, end_id), "pieces"), capacity)


@in_small_batches()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
