"""Moments of many columns, NaN at scan, and prediction files byte by byte."""

import os

import numpy as np
import pytest

from flowbook.operators.moments import moments
from flowbook.operators.ordering import kth_values_multi
from flowbook.operators.scaling import robust_fit, standard_fit
from flowbook.sources import files as S

NAN = float("nan")


def test_moments_of_complete_pairs(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 3)) * [1, 1e6, 1e-3] + [0, 1e9, 5]
    y = x[:, 0] + draw.normal(size=200)
    rows = [(*(None if (i + j) % 11 == 0 else NAN if (i + j) % 13 == 0 else float(v) for j, v in enumerate(r)), i % 7, None if i % 17 == 0 else float(y[i])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k int, y double").repartition(6)
    got = {r["column"]: r for r in moments(df, ["a", "b", "c", "k"], "y").collect()}
    for j, c in enumerate(("a", "b", "c", "k")):
        pairs = np.array([(r[j], r[4]) for r in rows if r[j] is not None and r[j] == r[j] and r[4] is not None], float)
        assert got[c]["n"] == len(pairs) and got[c]["mean"] == pytest.approx(pairs[:, 0].mean(), rel=1e-12)
        assert got[c]["variance"] == pytest.approx(pairs[:, 0].var(), rel=1e-9) and got[c]["y_variance"] == pytest.approx(pairs[:, 1].var(), rel=1e-9)
        assert got[c]["covariance"] == pytest.approx(np.cov(pairs.T, ddof=0)[0, 1], rel=1e-6, abs=1e-12)
    none = moments(df.limit(0), ["a"]).first()
    assert (none["n"], none["mean"]) == (0, None)
    assert standard_fit(df.limit(0), ["a"]).scale["a"] == 1.0


def test_many_columns_take_as_many_jobs_as_one(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, 40)).round(2)
    df = spark.createDataFrame(x.tolist(), [f"c{i}" for i in range(40)]).repartition(4).cache()
    df.count()
    got = kth_values_multi(df, {f"c{i}": [0, 750, 1500, 2999] for i in range(40)}, direct_limit=50)
    s = np.sort(x, axis=0)
    assert all(got[f"c{i}", r] == s[r, i] for i in range(40) for r in (0, 750, 1500, 2999))

    def jobs(cols):
        group = f"width-{len(cols)}"
        spark.sparkContext.setJobGroup(group, group)
        robust_fit(df, cols)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(df.columns) <= jobs(["c0"]) + 4


def test_nan_becomes_null_at_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, NAN, 2.0), (2, 1.5, NAN)], "row_id long, a double, b float").write.parquet(path)
    rows = S.parquet_load(spark, path, path, ["row_id", "a", "b"]).train.orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [(1, None, 2.0), (2, 1.5, None)]
    raw = S.parquet_load(spark, path, path, nan_as_null=False).valid.orderBy("row_id").first()
    assert raw.a != raw.a


def test_one_named_file_with_cr_lf(spark, tmp_path):
    df = spark.createDataFrame([(3, 0.5), (1, -1.0), (2, 2.25)], "ID long, prediction double").repartition(3)
    path = S.write_predictions(df, str(tmp_path / "out.csv"), single_file=True)
    assert open(path, "rb").read() == b"ID,prediction\r\n1,-1.0\r\n2,2.25\r\n3,0.5\r\n" and not os.path.exists(path + ".parts")
    S.write_predictions(df.limit(0), path, single_file=True)
    assert S.read_template(spark, path).count() == 0
    with pytest.raises(FileExistsError):
        S.write_predictions(df, path, single_file=True, mode="error")
    folder = S.write_predictions(df, str(tmp_path / "folder"))
    parts = [open(os.path.join(folder, f), "rb").read() for f in os.listdir(folder) if f.startswith("part-")]
    assert all(p.startswith(b"ID,prediction\r\n") and p.endswith(b"\r\n") for p in parts)
    assert sorted(map(tuple, S.read_template(spark, folder).collect())) == [(1, -1.0), (2, 2.25), (3, 0.5)]
