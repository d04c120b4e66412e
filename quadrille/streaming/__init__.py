"""Aggregates over streams, with the same code for batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(df: DataFrame, time: str, width: str, by: list[str], aggregates: dict[str, Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates by window and key. On a stream, rows later than ``late`` are dropped and state is bounded by it."""
    source = df.withWatermark(time, late) if df.isStreaming else df
    out = source.groupBy(F.window(time, width, slide), *by).agg(*(v.alias(k) for k, v in aggregates.items()))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, by: list[str], aggregates: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    source = df.withWatermark(time, late) if df.isStreaming else df
    out = source.groupBy(F.session_window(time, gap), *by).agg(*(v.alias(k) for k, v in aggregates.items()))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, *aggregates)


def latest_cells(edits: DataFrame, key: list[str], seq: str, value: str) -> DataFrame:
    """The current content of cells from a log of edits: the value of the last edit of each key."""
    return edits.groupBy(*key).agg(F.max_by(value, seq).alias(value))


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is there through a memory sink and stop (for tests and small refreshes)."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
