"""Copies of whole sets of tables: parents before children, by ranges of keys, resumed where they stopped.

Each target is a :class:`~..operators.keyed.KeyedTable`.  Its buckets are copied some at a
time, and the table's manifest notes for the copy's name which range is done, in the same
commit that brings the rows in.  So a copy that died is simply run again: ranges that are in
are passed over.  Rows whose key is null, or that point to a parent that the target doesn't
have, are written to the quarantine, as are then their own children; rows that the target
already has stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import Files, KeyedTable

QUARANTINED = "table string, key string, reason string"


@dataclass(frozen=True)
class CopiedTable:
    name: str
    key: Sequence[str]
    parents: Mapping[str, str] = field(default_factory=dict)  #: column: table to whose (single) key it points
    buckets: int = 64


def in_order(tables: Sequence[CopiedTable]) -> list[CopiedTable]:
    """Parents first, else as given; a table may point to itself, longer cycles are an error."""
    by_name = {t.name: t for t in tables}
    graph = {t.name: [p for p in t.parents.values() if p in by_name and p != t.name] for t in tables}
    return [by_name[name] for name in TopologicalSorter(graph).static_order()]


class Copy:
    """A named copy of ``tables`` from ``source`` (a frame by name) into the folder ``path``."""

    def __init__(self, spark: SparkSession, name: str, source: Callable[[str], DataFrame], path: str, tables: Sequence[CopiedTable], ranges: int = 8):
        self.spark, self.name, self.source, self.path, self.ranges = spark, name, source, path, ranges
        self.tables = in_order(tables)

    def target(self, table: CopiedTable) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/{table.name}", table.key, self.source(table.name).schema, table.buckets)

    def quarantined(self) -> DataFrame:
        """table, key (as JSON) and reason of all rows that were held back."""
        files, root = Files(self.spark, self.path), f"{self.path}/quarantine/{self.name}"
        found = [f"{root}/{t}/{k}" for t in files.names(root) for k in files.names(f"{root}/{t}")]
        return self.spark.read.schema(QUARANTINED).parquet(*found) if found else self.spark.createDataFrame([], QUARANTINED)

    def run(self, after: Callable[[str, int], None] | None = None) -> None:
        """Copy what isn't copied yet; ``after`` is told of each table and range that is done."""
        for table in self.tables:
            target = self.target(table)
            for k in range(self.ranges):
                if target.done(self.name, k):
                    continue
                self._range(table, target, k)
                if after:
                    after(table.name, k)

    def _range(self, table: CopiedTable, target: KeyedTable, k: int) -> None:
        rows = self.source(table.name)
        own = rows.where(F.floor(target.bucket() * self.ranges / target.buckets) == k)
        null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in table.key))
        reasons = [F.when(null, "no key")]
        for i, (column, parent) in enumerate(table.parents.items()):
            of = next((t for t in self.tables if t.name == parent), None)
            if of is None or parent == table.name:
                continue
            there = self.target(of).read().select(F.col(of.key[0]).alias(f"_key{i}"))
            own = own.join(there, F.col(column) == F.col(f"_key{i}"), "left")
            reasons.append(F.when(F.col(column).isNotNull() & F.col(f"_key{i}").isNull(), f"no {parent}"))
        judged = own.withColumn("_reason", F.coalesce(*reasons))
        key = F.to_json(F.array(*(F.col(c).cast("string") for c in table.key)), {"ignoreNullFields": "false"})
        held = judged.where("_reason IS NOT NULL").select(F.lit(table.name).alias("table"), key.alias("key"), F.col("_reason").alias("reason"))
        held.write.mode("overwrite").parquet(f"{self.path}/quarantine/{self.name}/{table.name}/{k}")
        fine = judged.where("_reason IS NULL").select(*rows.columns)
        new = fine.join(target.touched(fine).select(*table.key), list(table.key), "left_anti")
        target.merge(new.select(*rows.columns), order=[F.xxhash64(*rows.columns)], writer=self.name, number=k)

    def reconciled(self) -> DataFrame:
        """Of each table how many rows were read, are present in the target, are quarantined, and are lost (0 if all is well)."""
        out = []
        for table in self.tables:
            keys = self.source(table.name).select(*table.key)
            present = keys.join(self.target(table).read().select(*table.key), list(table.key), "left_semi").agg(F.count(F.lit(1)).alias("present"))
            out.append(keys.agg(F.count(F.lit(1)).alias("read")).crossJoin(present).select(F.lit(table.name).alias("table"), "read", "present"))
        counts = reduce(DataFrame.unionByName, out)
        held = self.quarantined().groupBy(F.col("table").alias("_table")).agg(F.count(F.lit(1)).alias("quarantined"))
        joined = counts.join(held, F.col("table") == F.col("_table"), "left").withColumn("quarantined", F.coalesce("quarantined", F.lit(0)))
        return joined.select("table", "read", "present", "quarantined", (F.col("read") - F.col("present") - F.col("quarantined")).alias("lost"))
