"""Vectors of scalars, packed arrays and interactions, and the flows on them."""

import math

import pytest
from pyspark.sql import functions as F

from flowbook.functions import arrays as A
from flowbook.operators import clean as C
from flowbook.operators.feature_space import FeatureSpace, names_of_vector
from flowbook.operators.models import assemble, selection_gbt
from flowbook.operators.rowstats import INTERACTION_MARKETS, add_log_interactions
from flowbook.operators.treeshap import shap_importance
from flowbook.plans import pipelines as PL
from flowbook.sources import adapters as V

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, float(i % 7), 1.0 + i, [float(i % 3), float(i), -1.0 * (i % 5)]) for i in range(40)] + [(90, None, 0.0, [1.0, None, 2.0]), (91, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "row_id long, b double, volume double, x array<double>")
    return df.withColumn("x", A.with_names(F.col("x"), "x", ["X3", "X10", "X7"]))


def test_names_and_values(frame):
    space = FeatureSpace.of(frame, ["b", "volume"], ["x"], ["volume", "absent"])
    assert space.names == ["b", "volume", "X3", "X10", "X7", "X3_log_x_volume", "X10_log_x_volume", "X7_log_x_volume"]
    out = space.vector(frame)
    assert names_of_vector(out) == space.names
    got = {r.row_id: r.features.toArray().tolist() for r in out.collect()}
    assert got[8] == [1.0, 9.0, 2.0, 8.0, -3.0, 2 * math.log(9), 8 * math.log(9), -3 * math.log(9)]
    assert got[90][1:3] == [0.0, 1.0] and math.isnan(got[90][0]) and math.isnan(got[90][3]) and got[90][5:] == [0.0, 0.0, 0.0]
    assert all(math.isnan(v) for v in got[91][2:5]) and got[91][5:] == [0.0, 0.0, 0.0]


def test_a_selection_computes_only_its_own(frame):
    space = FeatureSpace.of(frame, ["b", "volume"], ["x"], ["volume"])
    part = space.select(["X7_log_x_volume", "b", "X10"])
    assert part.needs() == ["b", "x", "volume"] and space.select(["b"]).needs() == ["b"]
    whole = {r.row_id: r.features.toArray() for r in space.vector(frame).collect()}
    for r in part.vector(frame).collect():
        assert [v if v == v else None for v in r.features.toArray()] == [v if v == v else None for v in whole[r.row_id][[7, 0, 3]]]
    assert names_of_vector(assemble(frame, part)) == part.names
    with pytest.raises(KeyError):
        space.select(["X4"])
    # No array is walked: single elements alone are taken from it.
    assert "transform" not in str(space.array(part.names)) and "transform" in str(space.array())


def test_interactions_equal_the_stored_arrays(spark):
    rows = PL.boosted_tree_rows(V.market_signals(spark, SF))
    space = PL.boosted_tree_space(rows)
    stored = add_log_interactions(rows)
    names = [f"X5_log_x_{m}" for m in INTERACTION_MARKETS]
    got = space.select(names).vector(stored).select("features", *[F.col(f"x_log_x_{m}")[4].alias(m) for m in INTERACTION_MARKETS]).collect()
    assert len(got) == V.market_events(spark, SF).count()
    assert all(r.features.toArray().tolist() == [r[m] for m in INTERACTION_MARKETS] for r in got)


def test_all_features_reach_the_fit(spark):
    rows = PL.boosted_tree_rows(V.market_all_signals(spark, SF))
    space = PL.boosted_tree_space(rows)
    assert len(space.names) == 5 + 31 + 9 + 171 + 855 == len(set(space.names))
    data = space.vector(rows)
    model = selection_gbt(max_iter=2, max_depth=2).fit(data)
    importance = shap_importance(data, model).collect()
    assert {r.feature for r in importance} == set(space.names) and max(r.importance for r in importance) > 0


def test_flow_over_a_space(spark):
    rows = PL.boosted_tree_rows(V.market_signals(spark, SF))
    run = PL.selection_and_oof(rows, PL.boosted_tree_space(rows), top=6, selection_iter=2, selection_depth=3, k=3,
                               gbt_iter=4, gbt_depth=3, forest_trees=3, forest_depth=3, patience=2)
    n = rows.count()
    assert run.oof.count() == int(n * 0.8) and run.hold_out.count() == n - int(n * 0.8)
    history = run.history.collect()
    assert len(history) == 12 and {r.fold for r in history} == {0, 1, 2}
    assert [sum(r.kept for r in history if r.fold == f) for f in range(3)] and all(r.kept for r in history if r.round == 1)


def test_the_fit_does_not_follow_the_files(spark):
    rows = PL.boosted_tree_rows(V.market_signals(spark, SF)).select("row_id", "ts", "label", *PL.MARKET)
    one = PL.oof_training(rows.coalesce(1), PL.MARKET, k=2, gbt_iter=2, gbt_depth=3, forest_trees=2, forest_depth=2)
    many = PL.oof_training(rows.repartition(7), PL.MARKET, k=2, gbt_iter=2, gbt_depth=3, forest_trees=2, forest_depth=2)
    a, b = ({r.row_id: r.prediction for r in x.oof.collect()} for x in (one, many))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-9) for i in a)


def test_rows_are_dealt_before_their_vectors_and_once(spark, monkeypatch):
    """A selection's rows cross the shuffle without the vector of all features;
    the folds of a training share one deal."""
    from flowbook.operators import models as MO
    seen, deal = [], MO.dealt

    def watched(df, keys, n):
        seen.append(df.columns)
        return deal(df, keys, n)

    monkeypatch.setattr(MO, "dealt", watched)
    monkeypatch.setattr(PL, "dealt", watched)
    rows = PL.boosted_tree_rows(V.market_signals(spark, SF)).select("row_id", "ts", "label", *PL.MARKET)
    PL.shap_selection(rows, PL.MARKET, max_iter=1, max_depth=1)
    assert len(seen) == 1 and "features" not in seen[0]
    seen.clear()
    run = PL.oof_training(rows, PL.MARKET, k=3, gbt_iter=1, gbt_depth=1, forest_trees=2, forest_depth=2)
    assert len(seen) == 1 and run.oof.count() == rows.count() and len(run.models) == 3


def test_profile_drops_elements(spark):
    inf = float("inf")
    rows = [(1, [1.0, None, inf, None], "a"), (2, [2.0, 5.0, 1.0, None], None), (3, None, "b"), (4, [1.0], "c")]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, s string")
    df = df.withColumn("x", A.with_names(F.col("x"), "x", ["X1", "X2", "X3", "X4"]))
    got = {(r.column, r.element): (r.rows, r.nulls, r.infs, r.min, r.max) for r in C.profile(df).collect()}
    assert got["s", None] == (4, 1, 0, None, None) and got["row_id", None] == (4, 0, 0, 1.0, 4.0) and got["x", None][:2] == (4, 1)
    assert got["x", "X1"] == (4, 1, 0, 1.0, 2.0) and got["x", "X3"] == (4, 2, 1, 1.0, inf) and got["x", "X4"][:2] == (4, 4)
    assert C.inf_columns(df) == ["X3"] and C.all_null_columns(df) == ["X4"]
    left = C.unfit(df, C.HAS_INF, C.ALL_MISSING).drop(df)[0]
    assert A.names_of(left, "x") == ["X1", "X2"] and [r.x for r in left.orderBy("row_id").collect()] == [[1.0, None], [2.0, 5.0], None, [1.0, None]]
    assert [(r.rows, r.nulls) for r in C.profile(df.limit(0)).collect()] == [(0, 0)] * 7
    assert C.sanitize(df).orderBy("row_id").first().x == [1.0, 0.0, 0.0, 0.0]
    assert A.names_of(C.sanitize(df), "x") == A.names_of(df, "x")


def test_arrays_are_narrowed(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [1e39])], "row_id long, x array<double>, y array<double>")
    df = df.select("row_id", A.with_names(F.col("x"), "x", ["X1", "X2"]), A.with_names(F.col("y"), "y", ["Y1"]))
    report, out = C.narrow_types(df)
    assert {r.column: r.to_type for r in report.collect()} == {"row_id": "tinyint", "x": "array<float>", "y": "array<double>"}
    assert dict(out.dtypes)["x"] == "array<float>" and A.names_of(out, "x") == ["X1", "X2"]


def test_policy_p3_on_wide_and_packed_tables(spark):
    packed = V.market_signals(spark, SF)
    wide = A.expand(packed, "x")
    base = ["row_id", *PL.MARKET, "label"]
    a = PL.policy_p3(packed, [*base, "x"], narrow=False)
    b = PL.policy_p3(wide, [*base, *A.names_of(packed, "x")], narrow=False)
    assert a.orderBy("row_id").first() == b.select(*a.columns).orderBy("row_id").first()
    dirty = packed.withColumn("bid_qty", F.when(F.col("row_id") % 3 > 0, F.col("bid_qty")))
    train, test = (PL.policy_p3(dirty, [*base, "x"], train=t, narrow=False) for t in (True, False))
    n = packed.count()
    assert test.count() == n and train.count() == dirty.where("bid_qty is not null").count() < n
    assert test.where("row_id % 3 = 0 and bid_qty <> 0").count() == 0
