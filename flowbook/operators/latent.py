"""The latent flow (L5, L6, M7): scaling, encoding and decoding whole vectors.

One array column holds a row's features, however many there are.  The scaler's
statistics are one vector summary (not two aggregates per column), PCA stands
for the linear auto-encoder, and decoding multiplies the latent vector with the
component matrix, which is broadcast, in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbook.operators.scaling import _nonzero

LATENT = 128


@dataclass
class ArrayScaler:
    """(x - center) / scale for every element of an array column."""

    center: list[float]
    scale: list[float]

    def expr(self, x: Column) -> Column:
        center, scale = F.lit(self.center), F.lit(self.scale)
        return F.transform(x, lambda v, i: (v - F.get(center, i)) / F.get(scale, i))


def fit_scaler(df: DataFrame, array: str) -> ArrayScaler:
    """G1 of every element by one vector summary: mean and population std, zero
    variance to scale 1.  The array has no missing elements."""
    stats = df.select(array_to_vector(F.col(array)).alias("v")).select(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("s.*").first()
    n = int(stats["count"])
    if not n:
        raise ValueError("no rows to fit a scaler on")
    population = stats["variance"].toArray() * (n - 1) / n
    return ArrayScaler(stats["mean"].toArray().tolist(), [_nonzero(s) for s in np.sqrt(np.maximum(population, 0.0)).tolist()])


def encoder(k: int, vector: str = "scaled", out: str = "latent") -> PCA:
    return PCA(k=k, inputCol=vector, outputCol=out)


def decoded(df: DataFrame, model: PCAModel, latent: str = "latent", out: str = "reconstructed") -> DataFrame:
    """``df`` with the latent vector projected back, as an array."""
    parts = df.sparkSession.sparkContext.broadcast(model.pc.toArray())
    k = parts.value.shape[1]

    def load():
        components = parts.value.T

        def run(z: np.ndarray) -> np.ndarray:
            return z.reshape(-1, k) @ components

        return run

    back = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=4096, input_tensor_shapes=[[k]])
    return df.withColumn(out, back(vector_to_array(latent)))
