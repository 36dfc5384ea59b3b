import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbook.operators import metrics as M
from flowbook.operators import scaling as S
from flowbook.operators import weights as W


@pytest.mark.parametrize("n", [1, 2, 10, 1000, 100003])
def test_decay_weights_sum_to_n(n):
    if n == 1:
        assert W.decay_sum(1, 0.95) == 1.0
        return
    pos = np.arange(n)
    w = 0.95 ** (1.0 - pos / (n - 1))
    assert W.decay_sum(n, 0.95) == pytest.approx(w.sum(), rel=1e-12)


def test_decay_weight_column(spark):
    df = spark.range(50).withColumnRenamed("id", "pos")
    w = [r["weight"] for r in W.time_decay_weights(df, "pos", 50).orderBy("pos").collect()]
    assert sum(w) == pytest.approx(50.0) and w == sorted(w) and w[-1] / w[0] == pytest.approx(1 / 0.95)


def test_outlier_downweight(spark):
    res = [0.1, 0.2, 0.3, 5.0, 9.0, 9.0]    # ties at the top
    df = spark.createDataFrame([(i, r, 1.0) for i, r in enumerate(res)], "id long, residual double, weight double")
    out = {r["id"]: r["weight"] for r in W.downweight_outliers(df, "residual", "weight", fraction=0.34).collect()}
    # n_out = int(0.34*6) = 2 -> threshold 9.0, both tied rows are outliers with equal residual -> 0.8
    assert out[4] == pytest.approx(0.8) and out[5] == pytest.approx(0.8) and out[3] == 1.0
    out2 = {r["id"]: r["weight"] for r in W.downweight_outliers(df, "residual", "weight", fraction=0.5).collect()}
    # threshold 5.0: min 5 -> 0.8, max 9 -> ~0.2
    assert out2[3] == pytest.approx(0.8) and out2[4] == pytest.approx(0.2, abs=1e-6)


def test_metrics_edges(spark):
    perfect = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "t double, p double")
    r = M.evaluation(perfect, "t", "p").first()
    assert r["pearson"] == pytest.approx(1.0) and r["r2"] == 1.0 and r["mae"] == 0.0
    const = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "t double, p double")
    r = M.evaluation(const, "t", "p").first()
    assert r["pearson"] is None and r["r2"] == pytest.approx(0.0)
    bad = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)], "t double, p double")
    assert M.evaluation(bad, "t", "p").first()["r2"] < 0
    one = spark.createDataFrame([(1.0, 1.5)], "t double, p double")
    r = M.evaluation(one, "t", "p").first()
    assert r["n"] == 1 and r["rmse"] == pytest.approx(0.5)


def test_standard_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (2.0, 5.0, "b"), (4.0, 5.0, "c")], "x double, c double, s string")
    m = S.standard_fit(df, ["x", "c"])
    out = m.transform(df)
    assert out.columns == ["x", "c", "s"]
    xs = np.array([r["x"] for r in out.collect()])
    assert xs.mean() == pytest.approx(0.0, abs=1e-12) and xs.std() == pytest.approx(1.0)
    assert m.scale["c"] == 1.0 and all(r["c"] == 0.0 for r in out.collect())


def test_robust_and_minmax(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rb = S.robust_fit(df, ["x"])
    assert rb.center["x"] == pytest.approx(np.median(vals))
    assert rb.scale["x"] == pytest.approx(np.percentile(vals, 75) - np.percentile(vals, 25))
    mm = S.minmax_fit(df, ["x"])
    got = [r["x"] for r in mm.transform(df).collect()]
    assert min(got) == 0.0 and max(got) == 1.0


def test_batch_mean_loss(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "pos long, loss double")
    r = M.batch_mean_loss(df, "loss", "pos", 2).first()
    # batches {0,1}, {2,3}, {4}: means 0.5, 2.5, 4 -> 7/3
    assert r["loss"] == pytest.approx(7 / 3) and r["batches"] == 3
