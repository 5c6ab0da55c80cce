"""Keyed tables that are changed by batches: only the buckets that a batch touches are written anew.

A :class:`KeyedTable` is a folder of Parquet files, dealt to buckets by a hash of the key,
and of manifests, one a version, that name the folder of each bucket.  A change writes new
folders for the buckets it touches and then one manifest, which is moved into place by a
rename that fails if the version exists.  So readers see one version whole, a job that dies
before the rename leaves the old one, and of two writers of one version the later fails.

A batch may be named by its writer and a number.  The manifest keeps the highest number of
each writer, and a batch whose number isn't higher is in already and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import materialised
from .state import upsert


class Files:
    """The file system of a folder, by Spark's own client, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A file that appears whole; FileAlreadyExistsException if there is one of that name."""
        beside = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(option, 1)
        none[0] = option.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.conf) if beside.toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        try:
            context.rename(beside, self.path(name), none)
        finally:
            self.fs.delete(beside, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class KeyedTable:
    """A versioned table of one row a key at ``path``, in storage that all executors share.

    ``schema`` and ``buckets`` count when the table is made; later sessions open it by its
    path and key.  Choose buckets so that one fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], schema: StructType | str | None = None, buckets: int = 64):
        self.spark, self.path, self.key = spark, path, list(key)
        self.files = Files(spark, path)
        if not self.versions():
            if schema is None:
                raise ValueError(f"no table at {path}")
            made = spark.createDataFrame([], schema).schema
            self._commit({"version": 0, "key": self.key, "count": buckets, "schema": made.jsonValue(), "buckets": {}, "writers": {}})
        state = self.state()
        if state["key"] != self.key:
            raise ValueError(f"the table's key is {state['key']}")
        self.buckets, self.schema = state["count"], StructType.fromJson(state["schema"])

    def versions(self) -> list[int]:
        return [int(x[:-5]) for x in self.files.names(f"{self.path}/manifests") if x.endswith(".json")]

    def state(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest."""
        version = max(self.versions()) if version is None else version
        return json.loads(self.files.read(f"{self.path}/manifests/{version:012d}.json"))

    def _commit(self, state: dict) -> None:
        self.files.create(f"{self.path}/manifests/{state['version']:012d}.json", json.dumps(state))

    def _frame(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{x}" for x in folders))

    def read(self, version: int | None = None) -> DataFrame:
        return self._frame(list(self.state(version)["buckets"].values()))

    def bucket(self, columns: Sequence[str] | None = None) -> Column:
        """The bucket of a row; ``columns`` are the key's names there."""
        types = [self.schema[k].dataType for k in self.key]
        return F.pmod(F.xxhash64(*(F.col(c).cast(t) for c, t in zip(columns or self.key, types, strict=True))), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, columns: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
        """The table's rows in the buckets of ``rows``, the only ones that are read; at most a number a bucket reaches the driver."""
        own = {str(r[0]) for r in rows.select(self.bucket(columns)).distinct().collect()}
        return self._frame([x for b, x in self.state(version)["buckets"].items() if b in own])

    def done(self, writer: str, number: int) -> bool:
        return number <= self.state()["writers"].get(writer, -1)

    def merge(self, batch: DataFrame, write_once: Sequence[str] = (), order: Sequence[Column] = (), writer: str | None = None, number: int | None = None) -> dict:
        """Merge ``batch`` by key as :func:`.state.upsert` does; what was done, as version, rows, refused and the buckets written.

        Rows with a null in their key are refused and counted.  Of rows of one key the first
        in ``order`` counts; without an order they are an error.  Columns that the table
        lacks are an error, those that the batch lacks are preserved.  A batch whose
        ``number`` its ``writer`` has reached is in already: nothing happens.
        """
        state = self.state()
        if unknown := {*batch.columns} - {*self.schema.names}:
            raise ValueError(f"the table has no {sorted(unknown)}")
        if writer is not None and self.done(writer, number):
            return {"version": state["version"], "rows": 0, "refused": 0, "buckets": []}
        typed = batch.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in batch.columns))
        held = materialised(typed.withColumn("_bucket", self.bucket()))
        null = self._null_key()
        keys = held.groupBy("_bucket", *self.key).agg(F.count(F.lit(1)).alias("_n"))
        counts = keys.groupBy("_bucket").agg(F.sum("_n").alias("n"), F.coalesce(F.sum(F.when(null, F.col("_n"))), F.lit(0)).alias("refused"), F.max(F.when(~null, F.col("_n"))).alias("most")).collect()
        own = held.dropna(subset=self.key)
        if order:
            first = Window.partitionBy(*self.key).orderBy(*order)
            own = own.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
        elif any((r["most"] or 0) > 1 for r in counts):
            raise ValueError("a key has several rows, and no order says which counts")
        buckets = sorted(r["_bucket"] for r in counts if r["n"] > r["refused"])
        old = self._frame([state["buckets"][str(b)] for b in buckets if str(b) in state["buckets"]])
        return self._replace(state, buckets, upsert(old, own.drop("_bucket"), self.key, write_once), {"rows": sum(r["n"] - r["refused"] for r in counts), "refused": sum(r["refused"] for r in counts)}, writer, number)

    def delete(self, keys: DataFrame, writer: str | None = None, number: int | None = None) -> dict:
        """Remove the rows of ``keys``; those that aren't there are none."""
        state = self.state()
        if writer is not None and self.done(writer, number):
            return {"version": state["version"], "rows": 0, "buckets": []}
        held = materialised(keys.select(*(F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.key)).dropna().distinct())
        buckets = [b for b in sorted(r[0] for r in held.select(self.bucket()).distinct().collect()) if str(b) in state["buckets"]]
        old = self._frame([state["buckets"][str(b)] for b in buckets])
        return self._replace(state, buckets, old.join(held, self.key, "left_anti"), {"rows": held.count()}, writer, number)

    def _null_key(self) -> Column:
        null = F.lit(False)
        for k in self.key:
            null = null | F.col(k).isNull()
        return null

    def _replace(self, state: dict, buckets: list[int], rows: DataFrame, told: dict, writer: str | None, number: int | None) -> dict:
        version, folder = state["version"] + 1, f"data/{state['version'] + 1:012d}-{uuid.uuid4().hex}"
        names = dict(state["buckets"])
        if buckets:
            dealt = rows.select(*self.schema.names).withColumn("_bucket", self.bucket())
            dealt.repartition(len(buckets), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            there = {*self.files.names(f"{self.path}/{folder}")}
            for b in buckets:
                names.pop(str(b), None)
                if f"_bucket={b}" in there:
                    names[str(b)] = f"{folder}/_bucket={b}"
        writers = state["writers"] | ({writer: number} if writer is not None else {})
        self._commit(state | {"version": version, "buckets": names, "writers": writers})
        return {"version": version, **told, "buckets": buckets}

    def clean(self, keep: int = 1) -> None:
        """Delete what only versions before the last ``keep``, or jobs that died, have written; let no job run meanwhile."""
        last = self.versions()[-keep:]
        used = {x.split("/")[1] for v in last for x in self.state(v)["buckets"].values()}
        for name in self.files.names(f"{self.path}/data"):
            if name not in used:
                self.files.delete(f"{self.path}/data/{name}")
        for name in self.files.names(f"{self.path}/manifests"):
            if not (name.endswith(".json") and int(name[:-5]) in last):
                self.files.delete(f"{self.path}/manifests/{name}")


class UniqueIndex:
    """Which row holds each key of a unique constraint, over the rows for which ``predicate`` holds.

    A batch is probed against its keys' buckets alone.  Nulls in a key are all different
    unless ``nulls_distinct`` is false, when they are one value.
    """

    def __init__(self, spark: SparkSession, path: str, row: str, columns: Sequence[str], predicate: str = "true", nulls_distinct: bool = True, buckets: int = 64):
        self.row, self.columns, self.predicate, self.nulls_distinct = row, list(columns), predicate, nulls_distinct
        self.table = KeyedTable(spark, path, ["key"], "key string, row string", buckets)

    def keys(self, rows: DataFrame) -> DataFrame:
        """row and key (JSON) of the rows that the constraint is about."""
        own = rows.where(self.predicate)
        if self.nulls_distinct:
            own = own.dropna(subset=self.columns)
        key = F.to_json(F.array(*(F.col(c).cast("string") for c in self.columns)), {"ignoreNullFields": "false"})
        return own.select(F.col(self.row).cast("string").alias("row"), key.alias("key"))

    def violations(self, batch: DataFrame) -> DataFrame:
        """row, key and ``holder`` of a batch's rows whose key another row has: in the index, or, if it is less, in the batch."""
        own = materialised(self.keys(batch))
        held = self.table.touched(own).select("key", F.col("row").alias("old"))
        least = own.groupBy("key").agg(F.min("row").alias("least"))
        met = own.join(least, "key").join(held, "key", "left")
        holder = F.coalesce("old", "least")
        return met.where(holder != F.col("row")).select("row", "key", holder.alias("holder"))

    def add(self, batch: DataFrame, writer: str | None = None, number: int | None = None) -> DataFrame:
        """Enter a batch's keys that break nothing; the others' :meth:`violations`."""
        broken = materialised(self.violations(batch))
        self.table.merge(self.keys(batch).join(broken.select("row", "key"), ["row", "key"], "left_anti"), order=[F.asc("row")], writer=writer, number=number)
        return broken
