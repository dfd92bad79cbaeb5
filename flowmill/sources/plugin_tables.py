"""Plugins that read a source page by page, or write a target in three steps.

A paged source has `schema` (a DDL string), `fetch(cursor, options)` -> (rows as a list of dicts, next
cursor or None), and may have `partitions(options)`, a list of first cursors: each is read by a task of its own,
the pages of one in turn. A stepped target has `prepare(table, mode, options)`, `write_batch(table, batch,
number)` with a pandas frame and a number that is the same whenever the batch is written again, and
`finalize(table, ok)`. Batches are written by the tasks; a task that is lost writes its batches again,
with the same numbers, so a plugin keeps the last of equal numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 10_000


def paged(spark: SparkSession, plugin: Any, options: dict[str, Any]) -> DataFrame:
    """The rows of all pages. Cursors travel as they are (numbers, texts or null)."""
    starts = list(plugin.partitions(options)) if hasattr(plugin, "partitions") else [None]
    schema = T._parse_datatype_string(plugin.schema) if isinstance(plugin.schema, str) else plugin.schema
    names = schema.fieldNames()

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for place in part["id"]:
                cursor, more = starts[int(place)], True
                while more:
                    rows, cursor = plugin.fetch(cursor, options)
                    more = cursor is not None
                    if rows:
                        yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return spark.range(0, len(starts), 1, max(1, len(starts))).mapInPandas(read, schema)


def stepped(df: DataFrame, plugin: Any, table: str, mode: str, options: dict[str, Any]) -> None:
    """Prepares, lets the tasks write their batches, and finalizes, whether or not that went well."""
    if hasattr(plugin, "prepare"):
        plugin.prepare(table, mode, options)
    ok = False

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, task = 0, TaskContext.get().partitionId()
        for part in parts:
            for at in range(0, len(part), BATCH):
                plugin.write_batch(table, part.iloc[at : at + BATCH].reset_index(drop=True), (task << 32) + number)
                number += 1
        yield pd.DataFrame({"batches": [number]})

    try:
        df.mapInPandas(write, "batches long").agg(F.sum("batches")).collect()
        ok = True
    finally:
        if hasattr(plugin, "finalize"):
            plugin.finalize(table, ok)
