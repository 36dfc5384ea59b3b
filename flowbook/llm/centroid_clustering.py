"""Centroid clustering (k-means rounds) with a PCA-rotated distance filter.

Vectors become integers floor(scale * x).  A principal component analysis of
them (Spark's, over all rows) gives an orthonormal basis of ``LEADING``
directions, and every vector is stored once with its leading rotated
coordinates and the norm of what they leave.  For a centroid with the same
numbers,

    |p - q|^2 + (|rest p| - |rest q|)^2  <=  |x - c|^2

whatever the basis, so the filter needs 17 numbers where a distance needs 64.
The centroid of the least bound is measured in integers; only centroids whose
bound does not exceed that distance (with a margin for rounding) survive and
are measured too.  Distances, ties and means are exact integers, so a result
does not depend on how rows are dealt out.

A round is one pass over the stored table: each task sends one row of sums for
each centroid, and the driver gets k rows of them.

Start: the k kept vectors with the smallest hex sha256 of ``1:<id>``.  Each
round replaces every centroid that has vectors by their componentwise
floor(sum / count).  Ties go to the smaller number.

Defined results: vectors of another length, or with a null, NaN or infinite
component, are left out, and so are those with an integer of 2^27 or more, whose
distances a long could not hold; null vectors too.  A null id counts as an
empty text; equal hashes (repeated ids) order by the vector.  Repeated rows are
clustered once each.  Fewer than k vectors make as many centroids; an empty
table gives no rows.  Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm.common import keep, ship, table

ship(__name__)

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
LEADING = 16
LARGEST = 1 << 27
#: Relative margin of the filter; rounding stays under 1e-12.
MARGIN = 1e-9


class Basis(NamedTuple):
    """A shift and orthonormal columns."""

    shift: np.ndarray
    axes: np.ndarray

    def rotated(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates of each row, and the norm of the rest."""
        centred = v - self.shift
        near = centred @ self.axes
        return near, np.linalg.norm(centred - near @ self.axes.T, axis=1)


def integers(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """id, v: the kept vectors."""
    def fits(x: Column) -> Column:
        return F.coalesce(F.abs(x.cast("double") * scale) < LARGEST, F.lit(False))  # NaN is above any number

    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    kept = vectors.where((F.size(vector_col) == dimensions) & F.forall(vector_col, fits))
    return kept.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def starting(rows: DataFrame, clusters: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in rows.orderBy(key, "v").limit(clusters).collect()], np.int64)


def basis(rows: DataFrame, dimensions: int, leading: int) -> Basis:
    """The mean and the leading principal directions of all rows."""
    vector = rows.select(array_to_vector(F.col("v").cast("array<double>")).alias("x"))
    n, mean = vector.select(Summarizer.metrics("count", "mean").summary(F.col("x")).alias("s")).select("s.count", "s.mean").first()
    if n < 2:  # no covariance: any directions will do
        return Basis(mean.toArray(), np.eye(dimensions)[:, :leading])
    return Basis(mean.toArray(), PCA(k=leading, inputCol="x", outputCol="y").fit(vector).pc.toArray())


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def rotated(rows: DataFrame, turn: Basis, dimensions: int) -> DataFrame:
    """id, v, near (leading coordinates), rest (norm of the others)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, rest = turn.rotated(_matrix(batch["v"], dimensions, np.float64))
            offsets = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "v": batch["v"], "near": pa.ListArray.from_arrays(offsets, near.ravel()), "rest": rest})

    return rows.mapInArrow(run, "id long, v array<int>, near array<double>, rest double")


def nearest(v: np.ndarray, near: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: Basis) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each row, the exact squared distance,
    and how many distances were measured."""
    c_near, c_rest = turn.rotated(centroids.astype(np.float64))
    size, c_size = (near**2).sum(1) + rest**2, (c_near**2).sum(1) + c_rest**2
    bound = (near**2).sum(1)[:, None] + (c_near**2).sum(1) - 2 * near @ c_near.T + (rest[:, None] - c_rest) ** 2
    at = np.arange(len(v))
    first = bound.argmin(1)
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[at, first] = ((v - centroids[first]) ** 2).sum(1)
    alive = bound <= (exact[at, first] + MARGIN * (size + c_size.max() + 1))[:, None]
    alive[at, first] = False
    row, number = np.nonzero(alive)
    exact[row, number] = ((v[row] - centroids[number]) ** 2).sum(1)
    best = exact.argmin(1)  # the first of equal ones
    return best, exact[at, best], len(at) + len(row)


def replaced(rows: DataFrame, centroids: np.ndarray, turn: Basis) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            v = _matrix(batch["v"], width, np.int64)
            best, _, _ = nearest(v, _matrix(batch["near"], turn.axes.shape[1], np.float64), batch["rest"].to_numpy(), centroids, turn)
            n += np.bincount(best, minlength=k)
            np.add.at(sums, best, v)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(k), pa.int32()), "n": n, "sums": pa.array(sums.tolist(), pa.list_(pa.int64()))})

    parts = rows.mapInArrow(run, "cluster int, n long, sums array<long>").where("n > 0")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums"))
    out = centroids.copy()
    for r in total.collect():
        out[r["cluster"]] = np.array(r["sums"], np.int64) // r["n"]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray, turn: Basis) -> DataFrame:
    """id, cluster, distance."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance, _ = nearest(_matrix(batch["v"], width, np.int64), _matrix(batch["near"], turn.axes.shape[1], np.float64), batch["rest"].to_numpy(), centroids, turn)
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "cluster": best.astype(np.int32), "distance": distance})

    return rows.mapInArrow(run, "id long, cluster int, distance long")


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: int = SCALE, leading: int = LEADING,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector as a written table, and the
    final centroids."""
    plain = keep(integers(vectors, id_col, vector_col, dimensions, scale), "centroids-integers")
    centroids = starting(plain, clusters)
    if not len(centroids):
        return plain.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    turn = basis(plain, dimensions, leading)
    rows = keep(rotated(plain, turn, dimensions), "centroids-rotated")
    for _ in range(rounds):
        centroids = replaced(rows, centroids, turn)
    return keep(assigned(rows, centroids, turn), "centroids-assigned"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("cluster")) if values else F.lit(None)

    return rows.select(
        F.col("id").alias("vec_id"), "cluster", "distance", of([sums.get(i, 0) for i in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of(digests).cast("string").alias("centroid_sha256"),
    )


def _round_sql(i: int) -> str:
    return f"""
a{i} AS (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS m FROM (
  SELECT k.vec_id, k.row, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k, c{i} c) GROUP BY vec_id, row),
s{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c),"""


QUERY_SQL = f"""
WITH kept AS (SELECT vec_id, row_number() OVER () AS row, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x) AND abs({SCALE} * x::DOUBLE) < {LARGEST}]) = {DIMENSIONS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY sha256('1:' || vec_id), v LIMIT {CLUSTERS}),
{"".join(map(_round_sql, range(ROUNDS)))}
last AS (SELECT k.vec_id, k.row, min(struct_pack(d := list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := c.c)) AS m FROM kept k, c{ROUNDS} c GROUP BY k.vec_id, k.row)
SELECT l.vec_id, l.m.c::INTEGER AS cluster, l.m.d AS distance, sum(l.m.d) OVER (PARTITION BY l.m.c)::BIGINT AS cluster_inertia,
  sum(l.m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last l JOIN c{ROUNDS} c ON c.c = l.m.c
"""
