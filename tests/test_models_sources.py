import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbook.operators import treeshap as TS
from flowbook.operators.models import assemble, fit_ridge, selection_gbt
from flowbook.operators.selection import f_scores, with_critical
from flowbook.sources import files as S


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = 2 * x[:, 0] - x[:, 1] * (x[:, 2] > 0) + 0.1 * rng.normal(size=300)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(300)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, label double")


def test_treeshap_exact(spark, small):
    feats = ["a", "b", "c", "d"]
    model = selection_gbt(max_iter=4, max_depth=3).fit(assemble(small, feats))
    exp = TS.Explainer(TS.trees_from_model(model), len(feats))
    pdf = small.orderBy("row_id").toPandas()
    phi = exp.shap(pdf[feats].to_numpy())
    pred = np.array([r["prediction"] for r in model.transform(assemble(small, feats)).orderBy("row_id").collect()])
    # local accuracy
    np.testing.assert_allclose(phi.sum(1) + exp.base_value(), pred, atol=1e-10)

    def cond(t, xr, S_):
        def rec(n):
            if t.left[n] < 0:
                return t.value[n]
            if t.feature[n] in S_:
                return rec(t.left[n] if xr[t.feature[n]] <= t.threshold[n] else t.right[n])
            return (t.cover[t.left[n]] * rec(t.left[n]) + t.cover[t.right[n]] * rec(t.right[n])) / t.cover[n]
        return rec(0)

    x = pdf[feats].to_numpy()
    for r in range(0, 300, 50):
        brute = np.zeros(4)
        for t in exp.trees:
            for i in range(4):
                others = [j for j in range(4) if j != i]
                for k in range(4):
                    for Sx in itertools.combinations(others, k):
                        w = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                        brute[i] += t.weight * w * (cond(t, x[r], set(Sx) | {i}) - cond(t, x[r], set(Sx)))
        np.testing.assert_allclose(phi[r], brute, atol=1e-10)
    imp = {r["feature"]: r["importance"] for r in TS.shap_importance(small, model, feats).collect()}
    np.testing.assert_allclose([imp[f] for f in feats], np.abs(phi).mean(0), rtol=1e-9)


def test_ridge_closed_form(spark, small):
    lr = fit_ridge(small, ["a"], "label", alpha=0.1).stages[-1]
    pdf = small.toPandas()
    xc = pdf["a"] - pdf["a"].mean()
    yc = pdf["label"] - pdf["label"].mean()
    w = (xc * yc).sum() / ((xc * xc).sum() + 0.1)
    assert lr.coefficients[0] == pytest.approx(w, rel=1e-9)
    assert lr.intercept == pytest.approx(pdf["label"].mean() - w * pdf["a"].mean(), rel=1e-9, abs=1e-12)


def test_f_scores_and_critical(spark, small):
    got = {r["feature"]: r["f_score"] for r in f_scores(small, ["a", "b"], "label").collect()}
    pdf = small.toPandas()
    r = np.corrcoef(pdf["a"], pdf["label"])[0, 1]
    assert got["a"] == pytest.approx(r * r / (1 - r * r) * 298, rel=1e-9)
    assert with_critical(["volume", "x"], ["volume", "kyle_lambda", "x"]) == ["volume", "x", "kyle_lambda"]


def test_csv_template_roundtrip(spark, tmp_path):
    tmpl = tmp_path / "tmpl.csv"
    tmpl.write_bytes(b"ID,prediction\r\n1,-0.5\r\n2,1.25\r\n3,0.0")   # CRLF, no final newline
    df = S.read_template(spark, str(tmpl))
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [(1, -0.5), (2, 1.25), (3, 0.0)]
    new = spark.createDataFrame([(1, -1.0), (2, 2.5), (3, 0.0)], "ID long, prediction double")
    path = S.write_stamped(new, df, str(tmp_path / "out"))
    assert os.path.basename(path) == "pred_piereson_cor1.000000.csv"
    back = spark.read.option("header", True).schema(S.TEMPLATE_SCHEMA).csv(path)
    assert back.count() == 3
    assert S.stamped_name(0.1234567) == "pred_piereson_cor0.123457.csv"


def test_model_save_load(spark, small, tmp_path):
    model = fit_ridge(small, ["a", "b"], "label")
    p = S.save_model(model, str(tmp_path / "m"))
    again = S.load_pipeline(p)
    a = [r["prediction"] for r in model.transform(small).orderBy("row_id").collect()]
    b = [r["prediction"] for r in again.transform(small).orderBy("row_id").collect()]
    assert a == b
