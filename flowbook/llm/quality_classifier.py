"""Quality scores: ridge regression on random Fourier features of document
statistics, with isotonic calibration.

``statistics`` reads each text once into ``STATS`` numbers (character shares,
word and line lengths, repetition).  The features cos(w x + b) of the
standardised statistics approximate a Gaussian kernel; the draws are fixed by
``SEED``.  Every task sums its part of the normal equations, the parts are
summed row by row of the matrix, and the driver solves a system whose size is
the number of features, whatever the corpus.  Another fold of the labelled
rows, cut into score bins, gives the isotonic curve.

Learned from: rows with a label whose crc32(doc_id as text) mod 5 is not 0
(1 to 3 fit the weights, 4 the curve).  Labels, language, source and doc_id are
no inputs.

Defined results: null text is an empty text, and empty texts get a score from
the same curve; repeated rows get equal scores; a null doc_id has no label; no
labelled row at all gives 0.5 everywhere; an empty table gives no rows.  Other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm.calibration import calibrated, curve, labelled, remainder
from flowbook.llm.common import keep, ship, table

ship(__name__)

FEATURES = 384
RIDGE = 1e-3
SEED = 7
FOLDS = 5
CUT = 0.3
CLIP = 6.0
STATS = 28

_GROUPS = [b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b";:'\"()-", b"#*$%&|<>@^_=+~`/\\[]{}", bytes(range(48, 58)), bytes(range(65, 91)), bytes(range(97, 123)), b"aeiou", bytes(range(128, 192)), bytes(range(192, 256)), b"|"]
GROUPS = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS):
    GROUPS[list(_g), _i] = 1


def statistics(text: str | None) -> np.ndarray:
    """The numbers that describe a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.split(b"\n")
    n, size = max(1, len(words)), max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:])))
    return np.concatenate([
        counts @ GROUPS / size,
        [
            np.log1p(size), np.log1p(len(words)), np.log1p(len(lines)),
            lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 3).mean(),
            len(set(words)) / n, pairs / max(1, len(words) - 1), len(set(lines)) / len(lines),
            -(share * np.log2(share)).sum(), sum(map(len, lines)) / len(lines) / size,
        ],
    ])


def described(docs: DataFrame) -> DataFrame:
    """doc_id, stats; one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "stats": pa.array(stats, pa.list_(pa.float64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>")


class Kernel:
    """Random Fourier features of standardised statistics, and their weights."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = draw.normal(0, 1 / np.sqrt(STATS), (STATS, FEATURES))
        self.b = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -CLIP, CLIP)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b), np.ones(len(x))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["stats"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), STATS)


def fit_kernel(train: DataFrame) -> Kernel | None:
    """Weights from the normal equations of ``train`` (stats, label)."""
    if train.isEmpty():
        return None
    both = Summarizer.metrics("mean", "std").summary(array_to_vector("stats"))
    moments = train.agg(both.alias("m")).first()["m"]
    kernel = Kernel(moments["mean"].toArray(), moments["std"].toArray())
    width = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, width + 1))
        for batch in batches:
            z = kernel(_matrix(batch))
            sums += z.T @ np.column_stack([z, batch["label"].to_numpy(zero_copy_only=False)])
        if sums.any():
            yield pa.RecordBatch.from_pydict({"row": pa.array(range(width), pa.int32()), "cells": pa.array(list(sums), pa.list_(pa.float64()))})

    def total(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "cells": [np.sum(part["cells"].to_list(), axis=0)]})

    parts = train.select("stats", "label").mapInArrow(partial, "row int, cells array<double>")
    rows = parts.groupBy("row").applyInPandas(total, "row int, cells array<double>").collect()
    sums = np.array([r["cells"] for r in sorted(rows)])
    kernel.weights = np.linalg.solve(sums[:, :width] + RIDGE * sums[-1, -2] * np.eye(width), sums[:, -1])
    return kernel


def raw_scores(rows: DataFrame, kernel: Kernel, *also: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = kernel(_matrix(batch)) @ kernel.weights
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in also} | {"raw": pa.array(raw, pa.float64())})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("stats", *also).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in also) + ", raw double")


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of ``docs``."""
    rows = keep(described(docs), "quality-statistics")
    known = rows.join(labelled(labels, label), F.col("doc_id") == F.col("l_id"))
    train = keep(known.select("stats", "label", remainder("doc_id", FOLDS).alias("fold")).where("fold > 0"), "quality-train")
    kernel = fit_kernel(train.where("fold < 4"))
    held = (remainder("doc_id", FOLDS) == 0).alias("held_out")
    if kernel is None:
        return rows.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    points = curve(raw_scores(train.where("fold = 4"), kernel, "label"), "raw", "label", -0.5, 1.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = calibrated(kernel(_matrix(batch)) @ kernel.weights, points)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(score, pa.float64())})

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
