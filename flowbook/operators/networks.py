"""Batch scoring with a trained network of another library.

The network is a written table: one row per layer with its weights, bias, batch
normalisation, activation and skip connection.  ``load`` reads it back through
Spark from wherever it lies (its size is the model's, never the rows'), the
layers are broadcast, each Python worker unpacks them once, and rows go through
the layers in Arrow batches as matrix products.  Scoring is in evaluation mode:
dropout does nothing and normalisation uses the stored statistics.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbook.session import ship_package

INPUT = -1
BATCH = 4096
NORM_EPSILON = 1e-5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700.0, 700.0)))


ACTIVATIONS = {
    "linear": lambda x: x,
    "sigmoid": sigmoid,
    "swish": lambda x: x * sigmoid(x),
    "relu": lambda x: np.maximum(x, 0.0),
}


@dataclass
class Layer:
    """y = activation(norm(W x + b)) + the output of layer ``skip`` (``INPUT``
    for the network's input, None for nothing).  ``norm`` is (mean, variance,
    gamma, beta) of a batch normalisation, or empty."""

    weights: list[list[float]]   # one row per output
    bias: list[float]
    activation: str = "linear"
    norm: list[list[float]] = field(default_factory=list)
    skip: int | None = None


@dataclass
class Network:
    layers: list[Layer]

    def __post_init__(self) -> None:
        width = [len(self.layers[0].weights[0])]
        for i, layer in enumerate(self.layers):
            if layer.activation not in ACTIVATIONS:
                raise ValueError(f"layer {i}: unknown activation {layer.activation!r}")
            if any(len(row) != width[-1] for row in layer.weights) or len(layer.bias) != len(layer.weights):
                raise ValueError(f"layer {i} does not fit {width[-1]} inputs")
            if layer.norm and [len(n) for n in layer.norm] != [len(layer.bias)] * 4:
                raise ValueError(f"layer {i}: a normalisation has mean, variance, gamma and beta")
            if layer.skip is not None and not (INPUT <= layer.skip < i and width[layer.skip + 1] == len(layer.bias)):
                raise ValueError(f"layer {i} cannot add layer {layer.skip}")
            width.append(len(layer.bias))

    @property
    def inputs(self) -> int:
        return len(self.layers[0].weights[0])

    @property
    def outputs(self) -> int:
        return len(self.layers[-1].bias)


class Forward:
    """A network's layers as matrices, normalisation folded in."""

    def __init__(self, network: Network):
        self.steps = []
        for layer in network.layers:
            weights, bias = np.array(layer.weights).T, np.array(layer.bias)
            if layer.norm:
                mean, variance, gamma, beta = map(np.array, layer.norm)
                scale = gamma / np.sqrt(variance + NORM_EPSILON)
                weights, bias = weights * scale, (bias - mean) * scale + beta
            self.steps.append((weights, bias, ACTIVATIONS[layer.activation], layer.skip))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        done = [x]
        for weights, bias, activation, skip in self.steps:
            y = activation(done[-1] @ weights + bias)
            done.append(y if skip is None else y + done[skip + 1])
        return done[-1]


SCHEMA = "layer int, weights array<array<double>>, bias array<double>, activation string, norm array<array<double>>, skip int"


def save(spark: SparkSession, network: Network, path: str) -> str:
    """Write the network as a table, one row per layer."""
    rows = [(i, layer.weights, layer.bias, layer.activation, layer.norm, layer.skip) for i, layer in enumerate(network.layers)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load(spark: SparkSession, path: str) -> Network:
    rows = spark.read.schema(SCHEMA).parquet(path).orderBy("layer").collect()
    if [r["layer"] for r in rows] != list(range(len(rows))) or not rows:
        raise ValueError(f"{path} holds no whole network")
    return Network([Layer([list(w) for w in r["weights"]], list(r["bias"]), r["activation"], [list(n) for n in r["norm"]], r["skip"]) for r in rows])


def scorer(spark: SparkSession, network: Network, batch_size: int = BATCH):
    """The network as a function of one ``array<double>`` column: a double for
    one output, else an array of doubles."""
    ship_package(spark)
    shared, single = spark.sparkContext.broadcast(network), network.outputs == 1

    def make():
        forward = Forward(shared.value)

        def predict(x: np.ndarray) -> np.ndarray:
            y = forward(x)
            return y[:, 0] if single else y

        return predict

    return predict_batch_udf(make, return_type=T.DoubleType() if single else T.ArrayType(T.DoubleType()),
                             batch_size=batch_size, input_tensor_shapes=[[network.inputs]])


def score_network(df: DataFrame, path: str, features: Sequence[str] | Column, out: str = "prediction") -> DataFrame:
    """``df`` with the output of the network stored under ``path``.  Rows
    with a missing feature get none."""
    network = load(df.sparkSession, path)
    x = F.array(*[F.col(c).cast("double") for c in features]) if not isinstance(features, Column) else features
    known = x.isNotNull() & ~F.exists(x, lambda v: v.isNull())
    filled = F.when(known, x).otherwise(F.array_repeat(F.lit(float("nan")), network.inputs))
    value = scorer(df.sparkSession, network)(filled)
    return df.withColumn(out, F.when(known, value))
