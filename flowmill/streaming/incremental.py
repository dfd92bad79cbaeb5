"""Pipelines over folders that grow: each run takes the files that are new, then stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from flowmill.operators.flow import Flow
from flowmill.sources import sinks
from flowmill.sources.registry import Connection


def load_new(source: Connection, folder: str, schema, flow: Flow, target: Connection, table: str, checkpoint: str, on_conflict: str | None = None, dead: Callable[[DataFrame], None] | None = None) -> int:
    """Runs the flow over files not seen before and writes what passes; gives the number of batches.

    A batch that is run again after a failure writes the same rows: with `on_conflict` and a primary
    key it leaves no repeats.
    """
    done = 0

    def batch(rows: DataFrame, number: int) -> None:
        nonlocal done
        outcome = flow.build(rows, source.read)
        sinks.write(target, table, outcome.ok, on_conflict=on_conflict)
        if dead is not None:
            dead(outcome.dead)
        done += 1

    stream = source.spark.readStream.schema(schema).parquet(folder)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done
