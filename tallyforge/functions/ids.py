"""Identifiers made from names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The name-based UUID (version 5) of a text within a namespace; null for null."""
    h = F.sha1(F.concat(F.lit(namespace.bytes), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    parts = (F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(name.isNotNull(), F.concat_ws("-", *parts))


def surrogate(*parts: Column) -> Column:
    """A stable 32-digit key of several columns; null and "" differ."""
    return F.left(F.sha2(F.encode(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), "UTF-8"), 256), F.lit(32))
