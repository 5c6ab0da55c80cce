"""Event-time aggregates with watermarks, and keyed upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.keyed import KeyedTable
from ..operators.ranking import newest


def windowed(events: DataFrame, at: str, by: Sequence[str], aggregates: Sequence[Column], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates by tumbling (or, with ``slide``, sliding) windows; rows later than ``late`` are dropped."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    grouped = events.withWatermark(at, late).groupBy(window.alias("w"), *by).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *(c for c in grouped.columns if c not in ("w", *by)))


def sessions(events: DataFrame, at: str, by: Sequence[str], gap: str, aggregates: Sequence[Column], late: str = "10 minutes") -> DataFrame:
    """Aggregates by sessions that end after ``gap`` without an event."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *(c for c in grouped.columns if c not in ("w", *by)))


def deduplicated(events: DataFrame, at: str, key: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(key))


def interval_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, on: Column, within: str, late: str = "10 minutes") -> DataFrame:
    """Rows of ``right`` at the time of a row of ``left`` or up to ``within`` after it; both sides' state goes as the watermark passes."""
    timed, later = left.withWatermark(left_at, late), right.withWatermark(right_at, late)
    return timed.join(later, on & (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL {within}")))


def upserting(events: DataFrame, table: KeyedTable, order: Sequence[Column], columns: Sequence[str] | None = None, writer: str = "stream") -> DataStreamWriter:
    """A writer that merges each micro-batch's first row of a key, by ``order``, into ``table``.

    A batch that is replayed is known by its number and changes nothing; only the buckets
    that it touches are written.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        own = newest(batch, table.key, order)
        table.merge(own.select(*(columns or table.schema.names)), writer=writer, number=epoch)

    return events.writeStream.foreachBatch(merge)
