"""Scoring a stream into a sink that a replayed batch cannot double.

``foreachBatch`` runs at least once per micro-batch: after a failure the same
batch, with the same id and rows, comes again.  The sink keeps every batch in a
folder named by its id and replaces that folder as a whole, so a replay leaves
the sink as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowbook.streaming.features import start_foreach_batch

Scorer = Callable[[DataFrame], DataFrame]


def batch_writer(score: Scorer, path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: scores a batch and replaces its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return write


def start_scoring(stream: DataFrame, score: Scorer, path: str, checkpoint: str) -> StreamingQuery:
    """Score everything that is there, batch by batch; a second start with the
    same checkpoint goes on after the last batch that ended."""
    return start_foreach_batch(stream, batch_writer(score, path), checkpoint)


def read_scored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All scored rows, with the id of their batch."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
