"""Releases as a stream: later releases supersede earlier rows of one key.

An extension: the batch form is ``operators.cleaning.keep_last``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest ``order`` of each key so far, as a streaming
    aggregate (complete or update mode); its state is one row for each key."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def start(stream: DataFrame, key: str, order: str, name: str, checkpoint: str):
    return latest_by_key(stream, key, order).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
