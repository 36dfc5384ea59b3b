"""Model fitting on ``pyspark.ml`` (L1, L3, L4, L7; L2 in ``early_stopping``, L5 and L6 in ``latent``).

Tree ensembles and linear heads are ``pyspark.ml`` estimators: their
training loops are already distributed (per-iteration histogram aggregates),
so this module only maps the reference's hyper-parameters and wires folds,
weights and scoring together.  The fold loop keeps one base table, dealt by
key, and runs k fits over it; nothing is collected except fitted models.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbook.operators.early_stopping import stopped
from flowbook.operators.feature_space import Features, FeatureSpace, Selection, columns_of_features
from flowbook.operators.ordering import fold_bounds
from flowbook.session import ensure_checkpoint_dir, stored
from flowbook.operators.weights import decay_weight_expr, downweight_expr, train_positions


#: Spark's default for the split statistics that a task keeps, in MB.
TREE_MEMORY_MB = 256


def assembler(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def assemble(df: DataFrame, features: Features, out: str = "features") -> DataFrame:
    """``df`` with its feature vector: of columns, or of a feature space's blocks."""
    if isinstance(features, FeatureSpace | Selection):
        return features.vector(df, out=out)
    return assembler(features, out).transform(df)


# ---------------------------------------------------------------- estimators
def selection_gbt(label: str = "label", features: str = "features", seed: int = 37,
                  max_iter: int = 100, max_depth: int = 6, row_share: float = 0.8, feature_share: str = "0.8",
                  memory_mb: int = TREE_MEMORY_MB) -> GBTRegressor:
    """Selection model: 100 trees, depth 6, rate 0.1, row/column sample 0.8."""
    return GBTRegressor(labelCol=label, featuresCol=features, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=0.1, subsamplingRate=row_share, featureSubsetStrategy=feature_share, seed=seed,
                        maxMemoryInMB=memory_mb)


def final_gbt(label: str = "label", features: str = "features", weight: str | None = "weight",
              seed: int = 37, max_iter: int = 1667, max_depth: int = 20, row_share: float = 0.3,
              feature_share: str = "0.3628", memory_mb: int = TREE_MEMORY_MB) -> GBTRegressor:
    """L1: the reference's final boosted-tree configuration mapped onto
    GBTRegressor (rate 0.02213, row sample 0.3, node column sample 0.3628,
    min child weight 16).  L1/L2 penalties, leaf caps and per-tree/level column
    sampling have no equivalent.  Each round is a distributed job.  Early
    stopping (L2) is in ``early_stopping``."""
    if max_depth > 30:
        raise ValueError("GBTRegressor grows trees of at most depth 30")
    kw = dict(labelCol=label, featuresCol=features, maxIter=max_iter, maxDepth=max_depth,
              stepSize=0.02213, subsamplingRate=row_share, featureSubsetStrategy=feature_share,
              minInstancesPerNode=16, seed=seed, maxBins=64, checkpointInterval=10,
              maxMemoryInMB=memory_mb)
    if weight:
        kw["weightCol"] = weight
    return GBTRegressor(**kw)


def quick_forest(label: str = "label", features: str = "features", weight: str | None = "weight",
                 seed: int = 37, num_trees: int = 50, max_depth: int = 10,
                 memory_mb: int = TREE_MEMORY_MB) -> RandomForestRegressor:
    """The quick forest used to score residuals (50 trees, depth 10)."""
    kw = dict(labelCol=label, featuresCol=features, numTrees=num_trees, maxDepth=max_depth, seed=seed,
              maxMemoryInMB=memory_mb)
    if weight:
        kw["weightCol"] = weight
    return RandomForestRegressor(**kw)


def ridge(alpha: float, n: float, label_std: float, label: str = "label", features: str = "features",
          weight: str | None = None) -> LinearRegression:
    """L4: ridge ``||y - Xw - b||^2 + alpha ||w||^2`` as LinearRegression.

    Spark's normal-equation solver minimises ``1/(2n) sum r^2 + lambda/2 ||w||^2``
    in a label-standardised space, so ``lambda = alpha * std_pop(y) / n``."""
    reg = alpha * label_std / n if n > 0 else 0.0
    kw = dict(labelCol=label, featuresCol=features, solver="normal", elasticNetParam=0.0,
              standardization=False, regParam=reg, fitIntercept=True)
    if weight:
        kw["weightCol"] = weight
    return LinearRegression(**kw)


def fit_ridge(df: DataFrame, features: list[str], label: str = "label", alpha: float = 0.1) -> PipelineModel:
    st = df.agg(F.count(F.col(label)).alias("n"), F.stddev_pop(label).alias("sd")).first()
    pipe = Pipeline(stages=[assembler(features), ridge(alpha, float(st["n"]), float(st["sd"] or 0.0), label)])
    return pipe.fit(df)


# ---------------------------------------------------------------- fold loop
#: Rows of a fit go to one part per so many, and to at least LEAST_PARTS.
ROWS_PER_PART, LEAST_PARTS = 250_000, 32
#: Folds that are fitted at a time: the many short jobs of one fill the gaps of another.
FOLDS_AT_ONCE = 2


def dealt(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` rows dealt by key, in key order, into a number of parts that
    follows from n alone: what a fit samples then depends neither on the files
    nor on the cluster."""
    return df.repartition(max(LEAST_PARTS, -(-n // ROWS_PER_PART)), *keys).sortWithinPartitions(*keys)


@dataclass
class FoldResult:
    models: list = field(default_factory=list)
    oof: DataFrame | None = None
    history: DataFrame | None = None  # fold, round, train_loss, held_out_loss, kept; with patience


def fold_training(
    base: DataFrame,
    n: int,
    k: int,
    make_estimator: Callable[[], object],
    features: Features,
    label: str = "label",
    keys: list[str] | None = None,
    pos: str = "pos",
    fold: str = "fold",
    decay: float | None = 0.95,
    outlier_fraction: float | None = 0.001,
    make_forest: Callable[[], object] | None = None,
    folds: list[int] | None = None,
    patience: int | None = None,
    at_once: int = FOLDS_AT_ONCE,
) -> FoldResult:
    """L7 + P2: per fold, train on the other folds with time-decay weights
    (positions counted inside the training rows) optionally down-weighted by
    forest residuals, fit, and score the held-out fold.  ``base`` carries
    ``pos`` and ``fold`` (see ``ordering.contiguous_kfold``).  With ``patience``
    each fold's model is cut after its best round on the held-out fold (L2).
    The base rows are ``dealt`` by key and checkpointed, once for all folds: a
    fold's rows are the same parts without the held-out rows, so no fit shuffles
    rows.  Residuals and predictions are stored tables.  ``at_once`` folds are fitted
    at a time."""
    keys = keys or ["row_id"]
    ensure_checkpoint_dir(base.sparkSession)
    bounds = fold_bounds(n, k)
    wanted = list(folds if folds is not None else range(k))
    own = [*keys, pos, fold, label]
    if isinstance(features, FeatureSpace):  # its vector is longer than what it is made from
        rows = base.select(*dict.fromkeys([*own, *columns_of_features(features)]))
        data = assemble(dealt(rows, keys, n - n // k).checkpoint(), features)
    else:
        data = dealt(assemble(base, features).select(*dict.fromkeys([*own, "features"])), keys, n - n // k).checkpoint()

    def fitted(f: int) -> tuple[object, DataFrame | None, DataFrame]:
        start, end = bounds[f]
        n_tr = n - (end - start)
        train = data.where(F.col(fold) != f)
        if decay is not None:
            train = train.withColumn("weight", decay_weight_expr(train_positions(F.col(pos), start, end), n_tr, decay))
        else:
            train = train.withColumn("weight", F.lit(1.0))
        if outlier_fraction is not None and make_forest is not None:
            forest = make_forest().fit(train)
            scored = forest.transform(train).withColumn("_res", F.abs(F.col(label) - F.col("prediction"))).drop("prediction")
            residuals = stored(scored.select("_res"), "fold-residuals")
            weight = downweight_expr(residuals, "_res", "weight", outlier_fraction, n=n_tr)
            train = scored.withColumn("weight", weight).drop("_res")
        model = make_estimator().fit(train)
        val, history = data.where(F.col(fold) == f), None
        if patience is not None:
            cut = stopped(model, train, val, label, patience, "weight")
            model, history = cut.model, cut.history.select(F.lit(f).alias(fold), "*")
        return model, history, stored(model.transform(val).select(*keys, F.lit(f).alias(fold), label, "prediction"), "fold-predictions")

    with ThreadPool(at_once) as pool:
        done = pool.map(inheritable_thread_target(base.sparkSession)(fitted), wanted, chunksize=1)
    models, histories, preds = (list(x) for x in zip(*done))
    return FoldResult(models, reduce(DataFrame.unionByName, preds), reduce(DataFrame.unionByName, histories) if patience is not None else None)
