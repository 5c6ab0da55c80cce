"""Approximate counts of different values by day, kept as sketches that are united over any period."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import KeyedTable

#: Binary logarithm of a sketch's buckets; the relative error of an estimate is 0.6 % on average.
PRECISION = 15


class DailySketches:
    """A sketch of ``value``'s different values for each group and day, in a keyed table at ``path``.

    A day is sketched once, when it is over; counting a period unites its days' sketches
    and reads no row again.
    """

    def __init__(self, spark: SparkSession, path: str, by: str, at: str, value: str, buckets: int = 16):
        self.by, self.at, self.value = by, at, value
        self.table = KeyedTable(spark, path, [by, "day"], f"{by} string, day date, sketch binary", buckets)

    def done(self) -> datetime.date | None:
        """The last day that is in."""
        number = self.table.state()["writers"].get("days")
        return None if number is None else datetime.date.fromordinal(number)

    def new_rows(self, rows: DataFrame, until: datetime.date) -> DataFrame:
        """Rows of the days after :meth:`done` up to ``until``; the scan is told the days."""
        moment = lambda d: F.lit(datetime.datetime.combine(d, datetime.time()))
        own = rows.select(self.by, self.at, self.value).where(F.col(self.at) < moment(until + datetime.timedelta(1)))
        return own if self.done() is None else own.where(F.col(self.at) >= moment(self.done() + datetime.timedelta(1)))

    def refresh(self, rows: DataFrame, until: datetime.date) -> dict:
        """Sketch the days that are over by ``until`` and aren't in yet; run again, it changes nothing."""
        if self.done() is not None and until <= self.done():
            return {"version": self.table.state()["version"], "rows": 0, "refused": 0, "buckets": []}
        day = F.to_date(self.at).alias("day")
        sketched = self.new_rows(rows, until).where(F.col(self.by).isNotNull()).groupBy(self.by, day).agg(F.hll_sketch_agg(self.value, F.lit(PRECISION)).alias("sketch"))
        return self.table.merge(sketched, writer="days", number=until.toordinal())

    def counts(self, period: Column) -> DataFrame:
        """The group, ``period`` (of the column ``day``) and ``estimate`` of its different values."""
        united = self.table.read().groupBy(self.by, period.alias("period")).agg(F.hll_union_agg("sketch").alias("s"))
        return united.select(self.by, "period", F.hll_sketch_estimate("s").alias("estimate"))
