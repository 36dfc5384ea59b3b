"""Column-level numeric helpers shared by every operator.

Spark 4 runs with ANSI semantics, so a plain ``/`` raises on a zero
denominator.  The reference engine works in IEEE arithmetic and zeroes
every non-finite value afterwards; these helpers give the same end
result while staying inside whole-stage codegen (no Python UDFs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column, b: Column) -> Column:
    """IEEE-style division: NULL instead of an ANSI error on ``x / 0``."""
    return F.try_divide(a, b)


def finite_or_zero(c: str | Column) -> Column:
    """Sanitise: NULL, NaN, +inf, -inf -> 0.0 (operator C8)."""
    c = col(c)
    return F.when(F.abs(c) < F.lit(INF), c).otherwise(F.lit(0.0))


def finite_or_null(c: str | Column) -> Column:
    """+inf, -inf, NaN -> NULL (operator C1)."""
    c = col(c)
    return F.when(F.abs(c) < F.lit(INF), c)


def nan_to_null(c: str | Column) -> Column:
    """Normalise NaN to NULL (scan-time rule: NULL is the only missing value)."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def r6(c: str | Column, places: int = 6) -> Column:
    """Round half away from zero at ``places`` decimals, computed as
    ``round(x * 10^p) / 10^p`` in plain double arithmetic (the usual SQL
    engine formula; ``F.round`` goes through BigDecimal per value).
    ``rint`` rounds ties to even, so exact .5 ties are pushed away from zero.
    ``+ 0.0`` folds -0.0 into 0.0."""
    m = F.lit(float(10 ** places))
    y = col(c) * m
    z = F.abs(y)
    r = F.rint(z)
    away = r + F.when(z - r == F.lit(0.5), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.signum(y) * away / m + F.lit(0.0)


def r6_sql(expr: str, places: int = 6) -> str:
    """SQL text of ``r6`` (same formula), for wide projections built with one
    ``selectExpr`` call instead of thousands of Column objects."""
    m = f"{float(10 ** places)!r}D"
    y = f"(CAST({expr} AS DOUBLE) * {m})"
    z = f"abs({y})"
    return (f"(signum({y}) * (rint({z}) + CASE WHEN {z} - rint({z}) = 0.5D THEN 1.0D ELSE 0.0D END)"
            f" / {m} + 0.0D)")


def round_columns(df, cols: list[str], keys: list[str] | None = None, places: int = 6):
    """Project ``keys`` plus ``r6`` of each column in ``cols`` (one call)."""
    q = lambda c: "`" + c.replace("`", "``") + "`"
    return df.selectExpr(*[q(k) for k in (keys or [])], *[f"{r6_sql(q(c), places)} AS {q(c)}" for c in cols])


def safe_ln(c: str | Column) -> Column:
    """Natural log that is NULL (not an error) for non-positive input."""
    c = col(c)
    return F.when(c > F.lit(0.0), F.ln(c))
