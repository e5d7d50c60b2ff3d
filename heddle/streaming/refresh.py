"""Appending a stream's batches to a table, with the views made from it refreshed after each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from heddle.engine import Engine


def follow(engine: Engine, stream: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Insert every batch into the engine's table, under its constraints, and refresh what became stale.

    A batch's number is committed with its rows, under the checkpoint's name, so a batch that a restart gives again isn't
    inserted twice, by another engine on the same folder either.
    """

    def batch(df: DataFrame, number: int) -> None:
        # a stream runs in a session of its own
        df.createOrReplaceGlobalTempView("_batch")
        columns = ", ".join(f"`{c}`" for c in df.columns)
        engine.once(checkpoint, number, lambda: engine.sql(f"INSERT INTO {table} ({columns}) SELECT * FROM global_temp._batch"))
        engine.refresh_stale()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
