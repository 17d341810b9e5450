"""Fitted features on a streaming DataFrame.

The reference has no streaming operators.  What carries over unchanged is the
fitted part of the feature catalogue: every fitted state is a static
DataFrame, so applying it to a stream is a set of stream-static joins that
Structured Streaming runs per micro-batch without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.features import Fitted, apply_all


def apply_to_stream(stream: DataFrame, fitted: list[Fitted]) -> DataFrame:
    """Append the fitted feature columns to a streaming (or batch) DataFrame."""
    return apply_all(stream, fitted)


def run_to_memory(stream: DataFrame, name: str, checkpoint: str):
    """Drive a stream to completion into an in-memory table (local checks and tests)."""
    q = (stream.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", checkpoint).start())
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)
