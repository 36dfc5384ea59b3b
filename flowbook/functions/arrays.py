"""Row-wise statistics over the packed signal array.

The ~900 anonymous ``X<digits>`` columns are held as one ``array<double>``
column whose ordered column names live in the field metadata
(``{"names": [...]}``).  Row statistics and interactions are then a fixed,
small number of higher-order-function expressions instead of thousands of
generated columns, which keeps plans short and the projection inside
codegen limits.  Wide columns are produced only at output (``expand``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbook.functions.numeric import finite_or_zero, safe_ln

NAMES_KEY = "names"


def with_names(c: Column, alias: str, names: list[str]) -> Column:
    return c.alias(alias, metadata={NAMES_KEY: list(names)})


def names_of(df: DataFrame, array_col: str) -> list[str]:
    meta = df.schema[array_col].metadata or {}
    names = meta.get(NAMES_KEY)
    if names is None:
        raise ValueError(f"column {array_col!r} carries no ordered name list")
    return list(names)


def pack(df: DataFrame, cols: list[str], alias: str = "x") -> DataFrame:
    """Wide ``X*`` columns -> one named array column (other columns kept)."""
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    rest = [c for c in df.columns if c not in set(cols)]
    return df.select(*rest, with_names(arr, alias, cols))


def expand(df: DataFrame, array_col: str, fmt: str = "{name}", names: list[str] | None = None,
           keep: bool = False) -> DataFrame:
    """Named array -> one double column per element (output layout)."""
    names = names if names is not None else names_of(df, array_col)
    rest = [c for c in df.columns if keep or c != array_col]
    return df.select(*rest, *[F.col(array_col)[i].alias(fmt.format(name=n)) for i, n in enumerate(names)])


def numeric_suffix(name: str) -> float | None:
    """First run of digits in a column name, as a float (``X293`` -> 293.0)."""
    m = re.search(r"(\d+)", name)
    return float(m.group(1)) if m else None


def present(x: Column) -> Column:
    """Values that count for skip-missing statistics (NULL and NaN skipped)."""
    return F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))


def arr_mean(xs: Column) -> Column:
    total = F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(xs).cast("double"))


def arr_std(xs: Column, mean: Column, ddof: int = 1) -> Column:
    ss = F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return F.sqrt(F.try_divide(ss, (F.size(xs) - F.lit(ddof)).cast("double")))


def arr_quantile(sorted_xs: Column, q: float) -> Column:
    """Linear-interpolation quantile of an ascending array (NumPy 'linear')."""
    n = F.size(sorted_xs)
    h = (n - F.lit(1)).cast("double") * F.lit(float(q))
    lo = F.floor(h).cast("int")
    hi = F.ceil(h).cast("int")
    a = F.element_at(sorted_xs, lo + 1)
    b = F.element_at(sorted_xs, hi + 1)
    t = h - lo.cast("double")
    return F.when(n > 0, a + (b - a) * t)


def arr_median(sorted_xs: Column) -> Column:
    n = F.size(sorted_xs)
    mid = (n / F.lit(2)).cast("int")
    a = F.element_at(sorted_xs, mid + F.lit(1))
    b = F.element_at(sorted_xs, F.greatest(n - mid, F.lit(1)))
    # odd n: a == b; even n: mean of the two middle values
    return F.when(n > 0, (a + b) / F.lit(2.0))


def arr_argext_suffix(x: Column, xs: Column, suffixes: list[float | None], use_max: bool) -> Column:
    """Numeric suffix of the first column holding the row max / min."""
    ext = F.array_max(xs) if use_max else F.array_min(xs)
    pos = F.array_position(x, ext)
    lits = F.array(*[F.lit(s).cast("double") for s in suffixes])
    return F.when(pos > 0, F.element_at(lits, pos.cast("int")))


def log_interaction(x: Column, m: Column) -> Column:
    """``X * ln(m)`` for every element, non-finite -> 0 (I1 plus cleanup)."""
    lnm = safe_ln(m)
    return F.transform(x, lambda v: finite_or_zero(v * lnm))


def sanitize_array(x: Column) -> Column:
    return F.transform(x, lambda v: finite_or_zero(v))
