"""Paged records as a Spark data source: ``paged_records``, for batches and streams.

A source table is read a page at a time; a page is a JSON object of ``items`` (record_id
and fields), ``has_more`` and, if so, ``page_token``, the name of the next.  Pages lie in
files ``<path>/<table>/<token>.json``, tokens in their order; for a live service override
:meth:`PagedRecords.pages` with an object of the same two methods.

Batches deal the pages of all tables out to tasks.  A stream's offset is, for each table,
how many of its pages have been read, so that one that is stopped goes on where it was:
no page is read twice or left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .records import SCHEMA as RECORD

SCHEMA = f"table string, page int, {RECORD}"
#: Pages of one task unless ``pagesPerTask`` says otherwise.
PAGES = 16


class PageFolder:
    """Pages in files; ``path`` is a folder, or a URI that pyarrow knows, that all executors see."""

    def __init__(self, path: str):
        self.path = path

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def tokens(self, table: str | None = None) -> list[str]:
        """The tokens of a table's pages in order, or the names of all tables."""
        from pyarrow import fs

        files, root = self._open()
        found = files.get_file_info(fs.FileSelector(root if table is None else f"{root}/{table}"))
        if table is None:
            return sorted(x.base_name for x in found if x.type == fs.FileType.Directory and x.base_name[0] not in "._")
        return sorted(x.base_name[:-5] for x in found if x.base_name.endswith(".json"))

    def page(self, table: str, token: str) -> dict:
        files, root = self._open()
        with files.open_input_stream(f"{root}/{table}/{token}.json") as stream:
            return json.loads(stream.readall())


class PageRange(InputPartition):
    def __init__(self, table: str, first: int, tokens: Sequence[str]):
        self.table, self.first, self.tokens = table, first, list(tokens)


class _Reading:
    """What batches and streams share."""

    def __init__(self, source: PagedRecords):
        self.pages, self.options = source.pages(), dict(source.options)
        self.per_task = int(self.options.get("pagespertask", self.options.get("pagesPerTask", PAGES)))

    def tables(self) -> list[str]:
        named = self.options.get("tables")
        return named.split(",") if named else self.pages.tokens()

    def ranges(self, table: str, first: int, last: int | None) -> list[PageRange]:
        tokens = self.pages.tokens(table)[first:last]
        return [PageRange(table, first + a, tokens[a : a + self.per_task]) for a in range(0, len(tokens), self.per_task)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for k, token in enumerate(partition.tokens):
            for item in self.pages.page(partition.table, token)["items"]:
                cells = {c: json.dumps(v, ensure_ascii=False) for c, v in (item.get("fields") or {}).items()}
                yield partition.table, partition.first + k, item["record_id"], cells


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[PageRange]:
        return [p for t in self.tables() for p in self.ranges(t, 0, None)]


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {t: len(self.pages.tokens(t)) for t in self.tables()}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        return [p for t in end for p in self.ranges(t, start.get(t, 0), end[t])]


class PagedRecords(DataSource):
    """Options: ``path``; ``tables`` (several, with commas; by default all); ``pagesPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def pages(self) -> PageFolder:
        return PageFolder(self.options["path"])

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(self)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self)


def read(spark: SparkSession, path: str, tables: Sequence[str] = (), source: type[PagedRecords] = PagedRecords) -> DataFrame:
    """table, page, record_id and fields (cells as JSON text) of every record of the pages at ``path``."""
    return _options(spark.read, spark, path, tables, source).load()


def stream(spark: SparkSession, path: str, tables: Sequence[str] = (), source: type[PagedRecords] = PagedRecords) -> DataFrame:
    return _options(spark.readStream, spark, path, tables, source).load()


def _options(reader, spark: SparkSession, path: str, tables: Sequence[str], source: type[PagedRecords]):
    spark.dataSource.register(source)
    reader = reader.format(source.name()).option("path", path)
    return reader.option("tables", ",".join(tables)) if tables else reader


def write_pages(records: DataFrame, path: str, size: int = 100) -> None:
    """Write records (table, record_id and the columns of their fields) as pages of ``size``, in order of record_id.

    Pages are numbered by ranges, not by one sort of a table in one task.
    """
    from ..operators.aggregates import ordinals

    columns = [c for c in records.columns if c not in ("table", "record_id")]
    item = F.struct("record_id", F.struct(*columns).alias("fields"))
    placed = ordinals(records.withColumn("item", item).select("table", "record_id", "item"), ["table"], [F.asc("record_id")])
    page = F.floor(F.col("before") / size).cast("int")
    last = F.floor((F.col("total") - 1) / size).cast("int")
    pages = placed.groupBy("table", page.alias("page"), last.alias("last")).agg(F.sort_array(F.collect_list("item")).alias("items"))
    token = lambda n: F.format_string("%09d", n)
    more = F.col("page") < F.col("last")
    text = F.to_json(F.struct("items", more.alias("has_more"), F.when(more, token(F.col("page") + 1)).alias("page_token")))

    def put(batches):
        from pyarrow import fs

        files, root = PageFolder(path)._open()
        for pdf in batches:
            for table, name, own in zip(pdf["table"], pdf["name"], pdf["text"], strict=True):
                files.create_dir(f"{root}/{table}", recursive=True)
                beside = f"{root}/{table}/.{name}.{hash(own) & 0xFFFFFFFF:x}"
                with files.open_output_stream(beside) as out:
                    out.write(own.encode())
                files.move(beside, f"{root}/{table}/{name}.json")  # a task that is run again puts the same page in its place
            yield pdf[["name"]]

    pages.select("table", token(F.col("page")).alias("name"), text.alias("text")).mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()
