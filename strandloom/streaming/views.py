"""The operators over streams.

k-mers, hash samples, minimizers and syncmers work on each row alone and apply to
a streaming DataFrame unchanged. Distinct elements keep state until a watermark
passes; views that need an order run per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def distinct_stream(df: DataFrame, item: str, time: str, delay: str) -> DataFrame:
    """First row of each item; an item is forgotten when the watermark has passed it."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([item])


def per_batch(df: DataFrame, view: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Apply an ordered view to every micro-batch and write it under its batch number, so that a rerun replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        view(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
