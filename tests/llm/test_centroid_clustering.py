"""Clusters against plain integer k-means and SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np

from flowbook.llm import centroid_clustering as cc
from flowbook.llm import queries

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def expected(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and abs(64 * x) < 2**27 for x in v)]
    ranked = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in ranked[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    return sorted(((-1 if i is None else i), n, d) for i, n, d in out), centres


def collected(df):
    return sorted(((-1 if r.id is None else r.id), r.cluster, r.distance) for r in df.collect())


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(queries.SQL["op11_pca_filtered_clustering"]).fetchall()
    got = queries.REGISTRY["op11_pca_filtered_clustering"](spark, SF)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 500


def test_ties_large_values_and_left_out_rows(spark):
    draw = random.Random(5)
    rows = [(i, [float(draw.choice([0, 0, 1, -1])) / 64 for _ in range(64)]) for i in range(150)]  # many ties
    rows += [(200 + i, [draw.uniform(-2e6, 2e6) for _ in range(64)]) for i in range(40)]
    rows += [(300, [0.5] * 63), (301, [0.5] * 65), (302, None), (303, [NAN] + [0.0] * 63), (304, [INF] + [0.0] * 63), (305, [None] + [0.0] * 63), (306, [2.0**21] + [0.0] * 63), (307, [])]
    rows += [(None, [0.25] * 64), (0, rows[0][1]), (0, rows[3][1])]
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, near int").repartition(5)
    want, centres = expected(rows)
    found, centroids = cc.cluster(vectors)
    assert collected(found) == want and centroids.tolist() == centres


def test_few_equal_and_no_vectors(spark):
    kinds = "vec_id long, embedding array<float>"
    for rows in ([(1, [0.5] * 64)], [(i, [0.5] * 64) for i in range(30)], [(1, [0.1] * 64), (2, [-0.1] * 64)]):
        want, _ = expected([(i, np.float32(v).astype(float).tolist()) for i, v in rows])
        assert collected(cc.cluster(spark.createDataFrame(rows, kinds))[0]) == want
    assert cc.cluster(spark.createDataFrame([], kinds))[0].count() == 0


def test_the_filter_skips_distances_and_loses_none():
    draw = np.random.default_rng(2)
    centres = draw.integers(-400, 400, (16, 64))
    v = centres[draw.integers(0, 16, 5000)] + draw.integers(-20, 20, (5000, 64))
    turn = cc.Basis(v.mean(0), np.linalg.eigh(np.cov(v.T))[1][:, ::-1][:, :16])
    best, distance, measured = cc.nearest(v, *turn.rotated(v.astype(float)), centres, turn)
    plain = ((v[:, None, :] - centres[None]) ** 2).sum(2)
    assert (best == plain.argmin(1)).all() and (distance == plain.min(1)).all() and measured < 1.2 * len(v)
