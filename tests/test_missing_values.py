"""NULL and NaN in metrics, selection, scalers, packed arrays and order keys."""

import math
from decimal import Decimal

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from flowbook.operators import clean as C
from flowbook.operators import metrics as M
from flowbook.operators import ordering as O
from flowbook.operators import scaling as S
from flowbook.operators.scoring import ensemble_mean, score
from flowbook.operators.selection import f_scores

NAN = float("nan")
PAIRS = [(1.0, 2.0), (2.0, None), (None, 9.0), (3.0, 1.0), (4.0, 5.0), (NAN, 100.0)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "a double, b double")


def complete():
    return [(a, b) for a, b in PAIRS if a is not None and b is not None and a == a]


def correlation(rows):
    n, (ma, mb) = len(rows), (sum(x) / len(rows) for x in zip(*rows))
    cov = sum((a - ma) * (b - mb) for a, b in rows) / n
    return cov / math.sqrt(sum((a - ma) ** 2 for a, _ in rows) / n * sum((b - mb) ** 2 for _, b in rows) / n)


def test_pearson_counts_complete_pairs(pairs):
    assert M.pearson(pairs, "a", "b") == pytest.approx(correlation(complete()))
    row = M.evaluation(pairs, "a", "b").first()
    assert row.n == 3 and row.mae == pytest.approx(sum(abs(a - b) for a, b in complete()) / 3)


def test_f_score_counts_complete_pairs(pairs):
    r = correlation(complete())
    row = f_scores(pairs, ["a"], "b").first()
    assert row.r == pytest.approx(r) and row.f_score == pytest.approx(r * r / (1 - r * r) * 1)


def test_scalers_leave_missing_values_out(pairs):
    standard, minmax = S.standard_fit(pairs, ["a"]), S.minmax_fit(pairs, ["a"])
    assert standard.center["a"] == 2.5 and standard.scale["a"] == pytest.approx(math.sqrt(1.25))
    assert (minmax.center["a"], minmax.scale["a"]) == (1.0, 3.0)


def test_cleaning_looks_into_packed_arrays(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, None]), (3, [NAN, 2.0]), (4, None), (5, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "row_id long, x array<double>")
    assert [r.row_id for r in C.drop_null_rows(df).collect()] == [1, 5]
    assert {r.row_id: r.x for r in C.fill_null(df, 0.0).collect()} == {1: [1.0, 2.0], 2: [1.0, 0.0], 3: [0.0, 2.0], 4: None, 5: [float("inf"), 0.0]}
    assert {r.row_id: r.x for r in C.inf_to_null(df).collect()}[5] == [None, 0.0]


@pytest.mark.parametrize("kind", ["double", "decimal(12,3)"])
def test_positions_of_missing_keys_are_dealt_over_buckets(spark, kind):
    keys = [None if i % 3 == 0 else NAN if i % 3 == 1 and kind == "double" else float(i * 7919 % 1000) for i in range(3000)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "row_id long, k double").withColumn("k", F.col("k").cast(kind))
    out = O.with_position(df, ["k", "row_id"], buckets=16)
    assert out.buckets == 16
    want = sorted(range(3000), key=lambda i: ((0, 0) if keys[i] is None else (2, 0) if keys[i] != keys[i] else (1, keys[i]), i))
    got = {r.pos: r.row_id for r in out.df.select("pos", "row_id").collect()}
    assert [got[p] for p in range(3000)] == want


def test_split_keys_sort_as_spark_does():
    rows = [(Decimal("2"),), (None,), (Decimal("-1"),)]
    assert sorted(rows, key=O._sort_key) == [(None,), (Decimal("-1"),), (Decimal("2"),)]


def test_ensemble_of_pipelines(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "a double, label double")
    models = [Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), LinearRegression()]).fit(df) for _ in range(2)]
    out = ensemble_mean(models, df)
    assert out.columns == ["a", "label", "prediction"]
    assert all(r.prediction == pytest.approx(r.label, abs=1e-6) for r in out.collect())
    assert "mine" in score(models[0], df, "mine").columns
