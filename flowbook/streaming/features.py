"""Streaming use of the stateless operators.

The reference has no streams, but its feature maps (sets A/A+/B), row
statistics, log interactions and the sanitiser are pure projections, so
they apply unchanged to a streaming DataFrame.  This module wires them into
Structured Streaming: a file source with a fixed schema, the feature
projection, and a sink (any ``writeStream`` format, or ``foreachBatch`` for
idempotent batch writes keyed by ``epoch_id``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowbook.operators.features_a import add_features_a
from flowbook.operators.features_b import add_features_b
from flowbook.operators.rowstats import add_log_interactions, add_row_stats


def read_market_stream(spark: SparkSession, path: str, schema: T.StructType,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def stream_features(stream: DataFrame, feature_set: str = "a", **kw) -> DataFrame:
    """Apply a feature set to a streaming frame (no state, no watermark needed)."""
    if feature_set == "a":
        return add_features_a(stream, **kw)
    if feature_set == "a_plus":
        return add_features_a(stream, plus=True, **kw)
    if feature_set == "b":
        return add_features_b(stream, **kw)
    if feature_set == "row_stats":
        return add_row_stats(stream, **kw)
    if feature_set == "interactions":
        return add_log_interactions(stream, **kw)
    raise ValueError(feature_set)


def start_parquet_sink(df: DataFrame, path: str, checkpoint: str, trigger_once: bool = True) -> StreamingQuery:
    """Append features to a Parquet folder; the checkpoint gives exactly-once
    file output across restarts."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.outputMode("append").start()


def start_foreach_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to ``fn(batch_df, epoch_id)``."""
    return (df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
