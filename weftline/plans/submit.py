"""SQL submitted over named frames; nothing leaks between calls."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def submit_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """The result of a SELECT over the given frames.  Empty text is an error.

    The frames are passed as arguments of the statement, so no view is registered and a
    later call can't see them.  ``limit`` caps the rows returned, where a caller wants that.
    """
    if not text or not text.strip():
        raise ValueError("empty SQL")
    names = {}
    for name, frame in tables.items():
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ValueError(f"not a table name: {name}")
        held = f"_{name}_{uuid.uuid4().hex[:12]}"
        frame.createOrReplaceTempView(held)
        names[name] = held
    bound = ", ".join(f"{name} AS (SELECT * FROM {held})" for name, held in names.items())
    body = text.strip().rstrip(";")
    opened = re.match(r"(?is)with\s+(?!recursive\b)", body)
    statement = (f"WITH {bound}, {body[opened.end():]}" if opened else f"WITH {bound} {body}") if bound else body
    try:
        out = spark.sql(statement)  # analysed here, so the views can go
    finally:
        for held in names.values():
            spark.catalog.dropTempView(held)
    return out.limit(limit) if limit is not None else out


def inline_rows(spark: SparkSession, rows: list[dict], schema: str | None = None) -> DataFrame:
    """A frame of inline rows; an empty set has the single column ``_empty``."""
    return spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema or "_empty string")
