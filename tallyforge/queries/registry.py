"""All queries of the library proper, as functions of (spark, folder), and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog
from . import extras, ingest, operators, rules, store, streams, tables, views

MODULES = (views, operators, rules, store, tables, streams, ingest, extras)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, run=run: run(Catalog(spark, folder))) for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
