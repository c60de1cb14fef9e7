"""Calls as they arrive: each micro-batch of whole calls is checked and its summary appended.

The roll-up's outliers need all calls, so it is computed from the appended summaries, as ``summarize_only`` does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start(calls: DataFrame, check: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """``check`` turns a batch of calls into rows that are written to a folder for the batch, so a batch that is done again replaces its rows."""

    def each(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = calls.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
