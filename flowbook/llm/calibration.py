"""Isotonic calibration from binned scores, and the folds of the labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbook.llm.common import ship

ship(__name__)

BINS = 1024


def remainder(doc_id: str, parts: int) -> Column:
    """crc32(doc_id as text) mod ``parts``; null ids count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(parts)).cast("int")


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label: one row per id, repeated labels averaged, null ones left out."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.avg(label).alias("label"))


def curve(scored: DataFrame, score: str, label: str, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over ``BINS`` equal bins of ``score`` between
    ``low`` and ``high``: points (score, rate) to interpolate between.  The
    driver gets one row per bin; each pool is shrunk by half a row of either
    label, so that no rate is exactly 0 or 1."""
    width = (high - low) / BINS
    at = F.least(F.greatest(F.floor((F.col(score) - low) / width), F.lit(0)), F.lit(BINS - 1))
    rows = scored.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("y"), F.avg(score).alias("x")).orderBy("bin").collect()
    if not rows:
        return np.array([low, high]), np.array([0.5, 0.5])
    pools: list[list[float]] = []  # rows, sum of labels, sum of scores
    for r in rows:
        pools.append([r["n"], r["y"], r["n"] * r["x"]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    xs = np.array([p[2] / p[0] for p in pools])
    rates = np.maximum.accumulate([(p[1] + 0.5) / (p[0] + 1.0) for p in pools])
    return xs, rates


def calibrated(scores: np.ndarray, points: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.interp(scores, *points)
