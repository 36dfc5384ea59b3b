"""The boosted-tree flow from split to hold-out, and the fold loop's rows."""

import inspect
import random

from flowbook.operators.models import final_gbt
from flowbook.plans.pipelines import OOFResult, oof_training, refit_scaled, selection_and_oof


def test_selection_and_oof(spark):
    draw = random.Random(1)
    rows = []
    for i in range(250):
        a, b = draw.random(), draw.random()
        rows.append((i, float(i), a, b, draw.random(), 3 * a + b))
    df = spark.createDataFrame(rows, "row_id long, ts double, a double, b double, noise double, label double")
    run = selection_and_oof(df, ["a", "b", "noise"], test=df.drop("label"), top=2, selection_iter=3, k=3,
                            gbt_iter=3, gbt_depth=3, forest_trees=3, forest_depth=3)
    assert set(run.selected) == {"a", "b"}
    oof = run.oof.collect()
    assert sorted(r.row_id for r in oof) == list(range(200)) and {r.fold for r in oof} == {0, 1, 2}
    assert sorted(r.row_id for r in run.hold_out.collect()) == list(range(200, 250)) and run.test.count() == 250
    report = {r.part: r for r in run.report.collect()}
    assert report["out_of_fold"].n == 200 and report["last_fold"].n == 66 and report["hold_out"].n == 50
    assert report["hold_out"].pearson > 0


def test_defaults_are_the_reference_s(spark):
    model = final_gbt()
    assert (model.getMaxIter(), model.getMaxDepth()) == (1667, 20)
    for flow in (oof_training, refit_scaled):
        given = inspect.signature(flow).parameters
        assert (given["gbt_iter"].default, given["gbt_depth"].default) == (1667, 20)


def test_fold_queries_fit_all_rounds(spark, monkeypatch):
    """No query of whole folds passes fewer rounds than the reference's."""
    from flowbook.plans import queries as Q
    given = {}
    monkeypatch.setattr(Q, "_market_b", lambda *_: None)
    monkeypatch.setattr(Q, "_r6_all", lambda *_: None)

    monkeypatch.setattr(Q, "_lineitem_b", lambda *_: None)
    monkeypatch.setattr(Q.PL, "ensemble_scores", lambda *_: Q.SparkSession.getActiveSession().createDataFrame([], "l_returnflag string, prediction double"))

    def run(name):
        def training(df, features, *_, **kwargs):
            given[name] = kwargs
            return OOFResult(None, [], 0)
        monkeypatch.setattr(Q.PL, "oof_training", training)
        Q.REGISTRY[name](None, "")

    for name in ("gbt_oof", "fold_ensemble"):
        run(name)
        assert not {"gbt_iter", "gbt_depth", "settings", "folds"} & set(given[name])  # the defaults, held below
    run("regularised_folds")
    assert given["regularised_folds"]["settings"].rounds == 1667 and given["regularised_folds"]["settings"].depth == 20
