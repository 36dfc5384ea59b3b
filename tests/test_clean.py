import math

import pytest
from pyspark.sql import functions as F

from flowbook.operators import clean as C

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def missing(spark):
    rows = [
        (1, 1.0, None, None, 1.0),
        (2, NAN, 2.0, None, INF),
        (3, INF, -INF, None, 3.0),
        (4, 4.0, 4.0, None, 4.0),
    ]
    return spark.createDataFrame(rows, "id long, a double, b double, empty double, one_inf double")


def test_null_profile_counts_null_and_nan(spark, missing):
    prof = {r["column"]: r["nulls"] for r in C.null_profile(missing).collect()}
    assert prof == {"a": 1, "b": 1, "empty": 4}
    prof_inf = {r["column"]: r["nulls"] for r in C.null_profile(C.inf_to_null(missing)).collect()}
    assert prof_inf == {"a": 2, "b": 2, "empty": 4, "one_inf": 1}


def test_wide_vector_profile_matches_narrow(spark):
    cols = [f"X{i}" for i in range(40)]
    exprs = [F.when(F.col("id") % (i + 2) == 0, F.lit(None).cast("double"))
             .when(F.col("id") % (i + 3) == 0, F.lit(INF)).otherwise(F.col("id").cast("double")).alias(c)
             for i, c in enumerate(cols)]
    df = spark.range(200).select("id", *exprs)
    wide = C.null_counts(df, cols, inf_as_missing=True)
    for i, c in enumerate(cols):
        want = sum(1 for k in range(200) if k % (i + 2) == 0 or k % (i + 3) == 0)
        assert wide[c] == want


def test_drop_columns_rules(spark, missing):
    assert C.inf_columns(missing) == ["a", "b", "one_inf"]
    assert C.all_null_columns(missing) == ["empty"]
    assert C.drop_all_null_columns(missing).columns == ["id", "a", "b", "one_inf"]
    with pytest.raises(KeyError):
        C.drop_columns([missing.drop("a")], ["a"])


def test_row_rules(spark, missing):
    # NaN and NULL drop the row, inf does not
    assert [r["id"] for r in C.drop_null_rows(missing.drop("empty")).collect()] == [3, 4]
    filled = C.fill_null(missing, 0.0).orderBy("id").collect()
    assert filled[1]["a"] == 0.0 and filled[1]["one_inf"] == INF and filled[0]["empty"] == 0.0
    clean = C.sanitize(missing).orderBy("id").collect()
    assert [r["a"] for r in clean] == [1.0, 0.0, 0.0, 4.0]
    assert [r["b"] for r in clean] == [0.0, 2.0, 0.0, 4.0]


def test_finite_label_pushdown_form(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([(1.0,), (INF,), (NAN,), (None,), (-2.0,)], "label double").write.parquet(p)
    df = C.finite_label(spark.read.parquet(p))
    assert sorted(r["label"] for r in df.collect()) == [-2.0, 1.0]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(label" in plan


def test_narrow_types_strict_bounds(spark):
    df = spark.createDataFrame(
        [(126, -127, 127, 1.0, 65503.0, 1e39, None), (0, 0, 0, -1.0, 0.0, 0.0, None)],
        "a long, b long, c long, d double, e double, f double, g long")
    plan = {r["column"]: r["to_type"] for r in C.narrow_plan(df).collect()}
    # strict bounds: 127 is not < 127
    assert plan == {"a": "tinyint", "b": "tinyint", "c": "smallint", "d": "float", "e": "float",
                    "f": "double", "g": "bigint"}
    _, out = C.narrow_types(df)
    assert dict(out.dtypes)["a"] == "tinyint" and dict(out.dtypes)["f"] == "double"


def test_column_selection_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3.0, True)], "X1 long, X22 double, s string, Xa double, flag boolean")
    assert C.columns_like(df) == ["X1", "X22"]
    assert C.numeric_columns(df) == ["X1", "X22", "Xa", "flag"]
    assert C.ordered_distinct(["b", "a", "b", "c", "a"]) == ["b", "a", "c"]
    assert C.available(["s", "zz", "X1"], df) == ["s", "X1"]
    assert C.align_columns(df, ["s", "X1"]).columns == ["s", "X1"]
    with pytest.raises(KeyError):
        C.align_columns(df, ["nope"])
