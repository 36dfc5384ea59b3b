"""End-to-end flows of the reference's three entry points, as Spark jobs.

* ``selection_and_oof`` (E2): features -> chronological 80/20 split ->
  tree-attribution selection on the 80 % -> contiguous k folds with decay and
  outlier-aware weights -> out-of-fold predictions -> fold-ensemble scoring
  of the hold-out (a true hold-out metric) and of the unlabelled table.
* ``refit_scaled`` (E3): scaled inputs and label, fit on all rows, score and
  un-scale.
* ``latent_flow`` (E1): policy P1 -> feature set A -> random split -> scaled
  features -> PCA latent -> ridge head -> composite loss on the split's test
  rows (arrays are compared before anything is stored) -> the unlabelled table scored and written under its correlation.

Features are column names or a ``FeatureSpace``, whose packed arrays and log
interactions reach the fits as vector elements with names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbook.functions import arrays as A
from flowbook.operators import metrics as M
from flowbook.operators import ordering as O
from flowbook.operators import scaling as S
from flowbook.operators.boosting import BoostSettings, HistogramBoost
from flowbook.operators.clean import sanitize
from flowbook.operators.feature_space import Features, FeatureSpace, Scalars, Selection, chosen_features, columns_of_features, names_of_features
from flowbook.operators.features_a import FEATURES_A, add_features_a
from flowbook.operators.features_b import FEATURES_B
from flowbook.operators.latent import LATENT, ArrayScaler, decoded, encoder, fit_scaler
from flowbook.operators.models import FOLDS_AT_ONCE, assemble, dealt, final_gbt, fold_training, quick_forest, ridge, selection_gbt
from flowbook.operators.ordering import top_k
from flowbook.operators.rowstats import INTERACTION_MARKETS, STAT_COLS
from flowbook.operators.scoring import attach_predictions, ensemble_mean
from flowbook.operators.selection import with_critical
from flowbook.operators.treeshap import shap_importance
from flowbook.plans.policies import policy_p1, policy_p3
from flowbook.session import ensure_checkpoint_dir, stored
from flowbook.sources.files import write_stamped

MARKET = ["bid_qty", "ask_qty", "buy_qty", "sell_qty", "volume"]


def boosted_tree_rows(df: DataFrame, train: bool = True, x: str = "x", label: str = "label") -> DataFrame:
    """P3 without the interaction columns, which a ``FeatureSpace`` makes unstored."""
    keys = [c for c in ("row_id", "ts") if c in df.columns]
    return policy_p3(df, [*keys, *MARKET, x, *([label] if label in df.columns else [])], train=train, x=x, label=label, narrow=False, interactions=False)


def boosted_tree_space(df: DataFrame, x: str = "x") -> FeatureSpace:
    """All features of E2 (P3's output): market columns, set B, row statistics,
    signals, and the signals' interactions, which need no columns."""
    return FeatureSpace.of(df, [*MARKET, *FEATURES_B, *STAT_COLS], [x], INTERACTION_MARKETS)


@dataclass
class SelectionResult:
    importance: DataFrame
    selected: list[str]


def shap_selection(train: DataFrame, features: Features, label: str = "label", k: int = 80,
                   max_iter: int = 100, max_depth: int = 6, keys: list[str] | None = None,
                   background: DataFrame | None = None, **estimator) -> SelectionResult:
    """Boosted trees on the training rows, mean |SHAP| per feature,
    top k plus the critical features that exist.  The rows are stored once and
    dealt by ``keys`` for the fit, before their vectors are made.  With ``background`` rows the attributions
    are interventional, else path-dependent."""
    keys = keys or ["row_id"]
    ensure_checkpoint_dir(train.sparkSession)
    columns = list(dict.fromkeys([*keys, label, *columns_of_features(features)]))
    rows = stored(train.select(*columns), "selection-rows")
    data = assemble(rows, features)
    model = selection_gbt(label, max_iter=max_iter, max_depth=max_depth, **estimator).fit(assemble(dealt(rows, keys, rows.count()), features))
    against = None if background is None else assemble(background, features)
    imp = stored(shap_importance(data, model, background=against), "importance")
    top = [r["feature"] for r in top_k(imp, "importance", k, tiebreak="feature").select("feature").collect()]
    return SelectionResult(imp, with_critical(top, names_of_features(features)))


@dataclass
class OOFResult:
    oof: DataFrame
    models: list
    n: int
    history: DataFrame | None = None


def oof_training(df: DataFrame, features: Features, label: str = "label", k: int = 5,
                 order: list[str] | None = None, gbt_iter: int = 1667, gbt_depth: int = 20,
                 forest_trees: int = 50, forest_depth: int = 10, outlier_fraction: float | None = 0.001,
                 folds: list[int] | None = None, patience: int | None = None, settings: BoostSettings | None = None,
                 **estimator) -> OOFResult:
    """L7/P2 with W1-W4: contiguous folds in time order, weighted fits, OOF;
    with ``patience`` early stopping on the held-out fold (L2).  Fits are
    ``final_gbt`` (``estimator`` goes to it), or with ``settings`` the boosted
    trees of ``boosting``, which have the reference's own parameters."""
    if settings is not None and patience is not None:
        raise ValueError("HistogramBoost watches held-out rows of its own: give it a held_out column instead")
    p = O.contiguous_kfold(df, k, order or ["ts", "row_id"])
    res = fold_training(
        p.df, p.n, k,
        make_estimator=lambda: HistogramBoost(settings, label, weight="weight") if settings else final_gbt(label, max_iter=gbt_iter, max_depth=gbt_depth, **estimator),
        features=features, label=label, keys=["row_id"],
        make_forest=lambda: quick_forest(label, num_trees=forest_trees, max_depth=forest_depth),
        outlier_fraction=outlier_fraction, folds=folds, patience=patience,
        at_once=k if settings else FOLDS_AT_ONCE)  # a fit of ``boosting`` is one task
    return OOFResult(res.oof, res.models, p.n, res.history)


@dataclass
class BoostedTreeRun:
    importance: DataFrame       # feature, importance: every feature
    selected: list[str]
    oof: DataFrame              # out-of-fold predictions on the first 80 %
    report: DataFrame           # metrics by part: out_of_fold, last_fold, hold_out
    hold_out: DataFrame         # fold-ensemble predictions on the last 20 %
    test: DataFrame | None      # fold-ensemble predictions on the unlabelled table
    history: DataFrame | None   # fold, round, train_loss, held_out_loss, kept; with patience


def selection_and_oof(df: DataFrame, features: Features, label: str = "label", test: DataFrame | None = None,
                      order: list[str] | None = None, top: int = 80, selection_iter: int = 100, selection_depth: int = 6,
                      k: int = 5, **training) -> BoostedTreeRun:
    """E2 as one flow: chronological 80/20 split, selection on the 80 %, weighted
    folds on the selected features, then the fold ensemble on the hold-out and on
    ``test``.  ``report`` scores the out-of-fold rows, the last fold alone and
    the hold-out that no model has seen."""
    train, held, _ = O.chrono_split(df, 0.8, order or ["ts", "row_id"])
    picked = shap_selection(train, features, label, k=top, max_iter=selection_iter, max_depth=selection_depth)
    chosen = chosen_features(features, picked.selected)
    run = oof_training(train, chosen, label, k=k, order=order, **training)
    hold = ensemble_scores(run.models, held, chosen)
    parts = {"out_of_fold": run.oof, "last_fold": run.oof.where(F.col("fold") == k - 1), "hold_out": hold}
    rows = [p.select(F.lit(name).alias("part"), label, "prediction") for name, p in parts.items()]
    report = M.evaluation(rows[0].unionByName(rows[1]).unionByName(rows[2]), label, "prediction", by=["part"])
    return BoostedTreeRun(picked.importance, picked.selected, run.oof, report, hold,
                          None if test is None else ensemble_scores(run.models, test, chosen), run.history)


def ensemble_scores(models: list, df: DataFrame, features: Features) -> DataFrame:
    """Mean prediction of the fold models on ``df``."""
    return ensemble_mean(models, assemble(df, features)).drop("features")


def refit_scaled(train: DataFrame, test: DataFrame, features: list[str], label: str = "label",
                 gbt_iter: int = 1667, gbt_depth: int = 20, keys: list[str] | None = None, **estimator) -> DataFrame:
    """P4 + G1/G3: scale features (fit on train) and label, fit on all rows,
    score ``test`` and return predictions in label units.  The scaled rows are
    stored and dealt by ``keys``."""
    keys = keys or ["row_id"]
    ensure_checkpoint_dir(train.sparkSession)
    xs = S.standard_fit(train, features)
    ys = S.standard_fit(train, [label])
    tr = xs.transform(train.select(*features, label, *keys), passthrough=True).withColumn(label, ys.expr(label))
    tr = stored(tr, "refit-rows")
    model = final_gbt(label, weight=None, max_iter=gbt_iter, max_depth=gbt_depth, **estimator).fit(dealt(assemble(tr, features), keys, tr.count()))
    te = xs.transform(test, passthrough=True)
    scored = model.transform(assemble(te, features)).drop("features")
    return scored.withColumn("prediction", ys.inverse_expr(F.col("prediction"), label))


@dataclass
class LatentRidge:
    """A scaler, a linear encoder and a ridge head over its latent vector."""

    features: Features
    scaler: ArrayScaler
    pca: object
    head: LinearRegressionModel
    label: str

    def encode(self, df: DataFrame) -> DataFrame:
        """``df`` with ``scaled`` (array) and ``latent`` (vector)."""
        rows = df.withColumn("scaled", self.scaler.expr(feature_array(self.features)))
        return self.pca.transform(rows.withColumn("scaled_vector", array_to_vector("scaled"))).drop("scaled_vector")

    def transform(self, df: DataFrame, reconstruct: bool = False) -> DataFrame:
        """``df`` with ``prediction``, ``scaled``, ``latent`` and, if asked,
        ``reconstructed`` (L6)."""
        scored = self.head.transform(self.encode(df))
        return decoded(scored, self.pca) if reconstruct else scored


def feature_array(features: Features):
    if isinstance(features, FeatureSpace):
        return features.array()
    if isinstance(features, Selection):
        return features.space.array(features.names)
    return Scalars(tuple(features)).whole()


def fit_latent_ridge(train: DataFrame, features: Features, label: str = "label", k: int = LATENT, alpha: float = 0.1) -> LatentRidge:
    """Standard-scaled features -> PCA(k) -> ridge.  The features are stored
    once; scaler, encoder and head are fitted on the stored rows."""
    ensure_checkpoint_dir(train.sparkSession)
    rows = stored(train.select(feature_array(features).alias("raw"), F.col(label).cast("double").alias(label)), "latent-rows")
    scaler = fit_scaler(rows, "raw")
    scaled = rows.select(array_to_vector(scaler.expr(F.col("raw"))).alias("scaled_vector"), label)
    pca = encoder(k, "scaled_vector").fit(scaled)
    latent = stored(pca.transform(scaled).select("latent", label), "latent-codes")
    st = latent.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("sd")).first()
    head = ridge(alpha, float(st["n"]), float(st["sd"] or 0.0), label, features="latent").fit(latent.where(F.col(label).isNotNull()))
    return LatentRidge(features, scaler, pca, head, label)


def latent_ridge(train: DataFrame, test: DataFrame, features: Features, label: str = "label",
                 k: int = LATENT, alpha: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Scored test rows (``prediction``, ``scaled``, ``latent``,
    ``reconstructed``) and the composite loss row on them."""
    scored = fit_latent_ridge(train, features, label, k, alpha).transform(test, reconstruct=True)
    return scored, M.composite_loss(scored, label, "prediction", "scaled", "reconstructed")


@dataclass
class LatentRun:
    model: LatentRidge
    dropped: list[str]          # columns and array elements with missing values in train
    report: DataFrame           # metrics on the split's test rows
    loss: DataFrame             # composite loss on them, over batches
    predictions: DataFrame      # ID, prediction for the unlabelled table
    path: str                   # where they were written


def latent_flow(train: DataFrame, valid: DataFrame, template: DataFrame, out_dir: str, label: str = "label",
                x: str = "x", k: int = LATENT, alpha: float = 0.1, order: list[str] | None = None, batch: int = 256) -> LatentRun:
    """E1 as one flow: P1 on both tables, feature set A, 70/30 random split by
    ``row_id``, scaling, PCA(k) and ridge fitted on the 70 %, metrics and the
    batch-mean composite loss on the 30 %, and ``valid`` scored, attached to the
    template and written under its correlation with it."""
    order = order or ["ts", "row_id"]
    clean = policy_p1(train, valid, label, keys=["row_id"], keep_label=True)
    numbers = [c for c in (*MARKET, *FEATURES_A, x) if c in clean.features.columns or c in FEATURES_A]
    left, right = (sanitize(add_features_a(d), cols=numbers) for d in (clean.features, clean.valid))
    scalars = [c for c in MARKET if c in left.columns] + list(FEATURES_A)
    space = FeatureSpace.of(left, scalars, [x] if x in left.columns and A.names_of(left, x) else [])
    split = O.random_split(left, 0.3, seed=42)
    model = fit_latent_ridge(split.where(F.col("split") == "train"), space, label, k, alpha)
    scored = stored(model.transform(split.where(F.col("split") == "test"), reconstruct=True).select(*order, label, "prediction", M.row_composite_loss(label, "prediction", "scaled", "reconstructed").alias("loss")), "latent-scored")
    loss = M.batch_mean_loss(O.global_position(scored, order), "loss", "pos", batch)
    done = stored(attach_predictions(model.transform(right), template, order).select("ID", "prediction"), "latent-predictions")
    return LatentRun(model, clean.dropped, M.evaluation(scored, label, "prediction"), loss, done, write_stamped(done, template, out_dir))
