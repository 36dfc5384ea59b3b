"""Counts, means and second moments of many columns in one pass.

One aggregate function per column and statistic does not scale to a thousand
columns: the generated code passes the compiler's limits.  Here a task reads
Arrow batches, keeps the moments of each column (centred, merged batch by
batch) and sends one row per column; a column's rows are merged by the same
formula.  With ``against``, only rows where both columns are present count, and
the moments of the pair come along.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbook.operators.clean import _numbers
from flowbook.session import ship_package

PARTS = "i int, n long, x double, y double, xx double, yy double, xy double"


def _of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """n, means of x and y, centred sums of xx, yy and xy over the complete pairs."""
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    if not len(x):
        return np.zeros(6)
    dx, dy = x - x.mean(), y - y.mean()
    return np.array([len(x), x.mean(), y.mean(), dx @ dx, dy @ dy, dx @ dy])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / n
    return np.array([n, a[1] + dx * b[0] / n, a[2] + dy * b[0] / n, a[3] + b[3] + w * dx * dx, a[4] + b[4] + w * dy * dy, a[5] + b[5] + w * dx * dy])


def moments(df: DataFrame, cols: Iterable[str], against: str | None = None) -> DataFrame:
    """(column, n, mean, variance, y_variance, covariance), population ones, in
    the order of ``cols``; NULL and NaN left out, NULL where no value is left."""
    cols = list(cols)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, n long, mean double, variance double, y_variance double, covariance double")
    ship_package(spark)
    width = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((width, 6))
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                y = _numbers(batch.column(width)) if against else np.zeros(batch.num_rows)
                for i in range(width):
                    held[i] = _merged(held[i], _of(_numbers(batch.column(i)), y))
        own = np.flatnonzero(held[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(held[own, 0], pa.int64()), *(pa.array(held[own, k]) for k in range(1, 6))], ["i", "n", "x", "y", "xx", "yy", "xy"])

    read = [F.col(c).alias(f"c{i}") for i, c in enumerate(cols)] + ([F.col(against).cast("double").alias("y")] if against else [])
    parts = df.select(*read).mapInArrow(run, PARTS)
    whole = parts.groupBy("i").agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "x", "y", "xx", "yy", "xy")).alias("p"))  # a part per task

    def total(each) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda acc, p: acc + each(p))

    whole = whole.select("i", "n", "p", (total(lambda p: p["n"] * p["x"]) / F.col("n")).alias("mx"), (total(lambda p: p["n"] * p["y"]) / F.col("n")).alias("my"))
    mx, my, n = F.col("mx"), F.col("my"), F.col("n")
    sums = whole.select(
        "i", "n", mx.alias("mean"),
        (total(lambda p: p["xx"] + p["n"] * (p["x"] - mx) * (p["x"] - mx)) / n).alias("variance"),
        (total(lambda p: p["yy"] + p["n"] * (p["y"] - my) * (p["y"] - my)) / n).alias("y_variance"),
        (total(lambda p: p["xy"] + p["n"] * (p["x"] - mx) * (p["y"] - my)) / n).alias("covariance"),
    )
    names = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(cols)), "array<string>")).alias("i", "column"))
    return names.join(sums, "i", "left").orderBy("i").select("column", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean", "variance", "y_variance", "covariance")
