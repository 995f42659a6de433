"""Structured Streaming into a store: one commit per micro-batch, each at most once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..edit import Writer
from ..plans.files import Files
from ..plans.manifest import Catalog


def append_batch(path: str, device: str, frame: DataFrame, batch: int, query: str, time_column: str | None = None, unit=None, order_by: str | None = None) -> bool:
    """Commit one micro-batch; False if a commit has it already, as after a restart."""
    spark = frame.sparkSession
    if Catalog.open(Files(spark, path)).streams().get(query, -1) >= batch:
        return False
    with Writer.open(path, spark=spark) as w:
        w.write_table(device, frame, time_column=time_column, unit=unit, order_by=order_by, create=True)
        w.mark_stream(query, batch)
        w.commit(f"{query}: batch {batch}")
    return True


def collect_stream(stream: DataFrame, path: str, device: str, checkpoint: str, query: str = "collector", time_column: str | None = None, unit=None, order_by: str | None = None, available_now: bool = False, interval: str | None = None) -> StreamingQuery:
    """Start a query that appends a stream to a device.

    Late rows are ordinary writes: any time is accepted, and the newest write of a time wins, so no watermark is
    needed.  The checkpoint and the batch numbers in the commits together make every batch count once.
    """

    def write(frame: DataFrame, batch: int) -> None:
        append_batch(path, device, frame, batch, query, time_column, unit, order_by)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(query)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start()
