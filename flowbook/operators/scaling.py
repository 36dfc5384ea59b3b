"""Scalers (G1-G5).

Fitting is one pass whose result (two numbers per column) is bounded by the
table width; applying is one projection with the statistics
as literals, so scaling never shuffles.  The standard scaler divides by the
*population* standard deviation, with zero variance mapped to scale 1 (the
``pyspark.ml`` scaler uses the sample std, hence this operator).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbook.operators.clean import numeric_columns, profile
from flowbook.operators.moments import moments
from flowbook.operators.ordering import kth_values_multi


def _nonzero(scale: float | None) -> float:
    # near-zero spread behaves as no spread: scale 1, values only centred
    if scale is None or scale != scale or abs(scale) < 10 * 2.220446049250313e-16:
        return 1.0
    return float(scale)


@dataclass
class ScalerModel:
    """Per-column (center, scale); ``transform`` = (x - center) / scale."""

    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return list(self.center)

    def expr(self, c: str) -> Column:
        return (F.col(c).cast("double") - F.lit(self.center[c])) / F.lit(self.scale[c])

    def transform(self, df: DataFrame, passthrough: bool = True) -> DataFrame:
        """Scaled columns first, in fit order; the rest appended."""
        scaled = [self.expr(c).alias(c) for c in self.columns]
        rest = [F.col(c) for c in df.columns if c not in self.center] if passthrough else []
        return df.select(*scaled, *rest)

    def inverse_expr(self, c: Column, name: str) -> Column:
        return c * F.lit(self.scale[name]) + F.lit(self.center[name])


def _cols(df: DataFrame, cols: Iterable[str] | None) -> list[str]:
    return list(cols) if cols is not None else numeric_columns(df)


def standard_fit(df: DataFrame, cols: Iterable[str] | None = None) -> ScalerModel:
    """G1: mean and population std of each column (NULL and NaN left out), one
    pass whatever the number of columns."""
    m = ScalerModel()
    for r in moments(df, _cols(df, cols)).collect():
        m.center[r["column"]] = float(r["mean"]) if r["mean"] is not None else 0.0
        m.scale[r["column"]] = _nonzero(None if r["variance"] is None else r["variance"] ** 0.5)
    return m


def minmax_fit(df: DataFrame, cols: Iterable[str] | None = None) -> ScalerModel:
    """(x - min) / (max - min), NULL and NaN left out; zero range -> scale 1.
    One pass whatever the number of columns."""
    cols = _cols(df, cols)
    m = ScalerModel()
    for r in profile(df, cols).where("element is null").collect():
        lo, hi = r["min"], r["max"]
        m.center[r["column"]] = float(lo) if lo is not None else 0.0
        m.scale[r["column"]] = _nonzero(None if lo is None else hi - lo)
    return m


def robust_fit(df: DataFrame, cols: Iterable[str] | None = None,
               quantile_range: tuple[float, float] = (25.0, 75.0)) -> ScalerModel:
    """(x - median) / IQR with exact quantiles of every column resolved
    together (shared counting passes); zero IQR -> scale 1."""
    cols = _cols(df, cols)
    qs = [0.5, quantile_range[0] / 100.0, quantile_range[1] / 100.0]
    ns = {r["column"]: int(r["rows"] - r["nulls"]) for r in profile(df, cols).where("element is null").collect()}
    spots = {}
    for c in cols:
        n = ns[c]
        spots[c] = [((n - 1) * q, int(((n - 1) * q) // 1), min(int(((n - 1) * q) // 1) + 1, max(n - 1, 0)))
                    for q in qs]
    vals = kth_values_multi(df, {c: sorted({i for _, a, b in spots[c] for i in (a, b)}) for c in cols if ns[c] > 0},
                            {c: ns[c] for c in cols if ns[c] > 0})
    m = ScalerModel()
    for c in cols:
        if ns[c] == 0:
            m.center[c], m.scale[c] = 0.0, 1.0
            continue
        med, q1, q3 = [vals[(c, a)] + (vals[(c, b)] - vals[(c, a)]) * (h - a) for h, a, b in spots[c]]
        m.center[c] = med
        m.scale[c] = _nonzero(q3 - q1)
    return m


def scale_label(df: DataFrame, label: str = "label", out: str | None = None) -> tuple[DataFrame, ScalerModel]:
    """Z-score the label (population std); returns the model for inversion."""
    m = standard_fit(df, [label])
    return df.withColumn(out or label, m.expr(label)), m


def unscale(df: DataFrame, model: ScalerModel, col: str, name: str = "label", out: str | None = None) -> DataFrame:
    """G3 inverse: ``z * sd + mu``."""
    return df.withColumn(out or col, model.inverse_expr(F.col(col), name))
