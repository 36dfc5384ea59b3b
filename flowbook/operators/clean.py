"""Cleaning operators.

Column-level decisions (which columns to drop, which type to narrow to) come
from ``profile``: one pass over the rows, however many columns there are.  A
task reads Arrow batches, keeps a few numbers per column and per element of a
packed array, and sends them as one row each; their sums are bounded by the
table's width, never by its length.  The data itself is then rewritten by one
projection.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbook.functions import arrays as A
from flowbook.functions.numeric import INF, finite_or_null, finite_or_zero
from flowbook.session import ship_package


def _is_fractional(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def _is_signal(dt: T.DataType) -> bool:
    """A packed array of signals."""
    return isinstance(dt, T.ArrayType) and _is_fractional(dt.elementType)


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame) -> list[str]:
    """C14: columns of numeric or boolean kind, in schema order."""
    return [f.name for f in df.schema.fields if _is_numeric(f.dataType)]


def columns_like(df: DataFrame, pattern: str = r"^X\d+$") -> list[str]:
    """Columns whose name matches ``pattern`` (default ``X<digits>``)."""
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.match(c)]


def ordered_distinct(items: Iterable[str]) -> list[str]:
    """De-duplicate, first occurrence wins."""
    return list(dict.fromkeys(items))


def available(features: Iterable[str], df: DataFrame) -> list[str]:
    """The named features present in ``df``, in the given order."""
    have = set(df.columns)
    return [f for f in features if f in have]


def align_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """C11: project ``df`` onto ``cols`` in order; missing columns are an error."""
    cols = list(cols)
    missing = [c for c in cols if c not in set(df.columns)]
    if missing:
        raise KeyError(f"columns not found: {missing[:10]}")
    return df.select(*cols)


def inf_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """+/-inf (and NaN) -> NULL on fractional columns and in fractional arrays."""
    fields = {f.name: f for f in df.schema.fields}
    target = set(cols) if cols is not None else {c for c, f in fields.items() if _is_fractional(f.dataType) or _is_signal(f.dataType)}

    def fix(c: str) -> Column:
        if _is_signal(fields[c].dataType):
            return F.transform(c, lambda v: finite_or_null(v)).alias(c, metadata=fields[c].metadata)
        return finite_or_null(c).alias(c)

    return df.select(*[fix(c) if c in target else F.col(c) for c in df.columns])


class ColumnSums:
    """What a task keeps of one column, or of the elements of a packed array:
    missing (NULL and NaN) and infinite values, least and largest value."""

    def __init__(self, width: int):
        self.nulls, self.infs = np.zeros(width, np.int64), np.zeros(width, np.int64)
        self.low, self.high = np.full(width, np.nan), np.full(width, np.nan)

    def add(self, values: np.ndarray) -> None:
        """Rows of numbers, NaN where there is none."""
        if len(values):
            self.nulls += np.isnan(values).sum(0)
            self.infs += np.isinf(values).sum(0)
            self.low = np.fmin(self.low, np.fmin.reduce(values))
            self.high = np.fmax(self.high, np.fmax.reduce(values))


def _numbers(column: pa.Array) -> np.ndarray | None:
    """A numeric column as doubles, NaN where there is no value; None for other types."""
    if pa.types.is_boolean(column.type) or pa.types.is_decimal(column.type) or pa.types.is_integer(column.type):
        column = pc.cast(column, pa.float64(), safe=False)
    return column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) if pa.types.is_floating(column.type) else None


def _elements(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers; NaN where there is no value."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(sizes), width), np.nan)
    row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[place < width], place[place < width]] = flat[place < width]
    return out


def signal_columns(df: DataFrame) -> list[str]:
    """The packed arrays that carry element names."""
    return [f.name for f in df.schema.fields if _is_signal(f.dataType) and (f.metadata or {}).get(A.NAMES_KEY)]


def profile(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """(column, element, rows, nulls, infs, min, max), one row per column and,
    with ``element``, per element of a named packed array.  NULL and NaN count
    as nulls; min and max leave them out.  A NULL array misses all elements."""
    cols = list(cols) if cols is not None else df.columns
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, element string, rows long, nulls long, infs long, min double, max double")
    ship_package(spark)
    signals = set(signal_columns(df))
    widths = [(c, len(A.names_of(df, c)) if c in signals else 0) for c in cols]
    labels = [pair for c, width in widths for pair in ([(c, None)] + [(c, n) for n in (A.names_of(df, c) if width else [])])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [(ColumnSums(1), ColumnSums(width)) for _, width in widths], 0
        for batch in batches:
            rows += batch.num_rows
            for column, (_, width), (whole, parts) in zip(batch.columns, widths, held):
                numbers = None if width else _numbers(column)
                if numbers is None:
                    whole.nulls += column.null_count
                else:
                    whole.add(numbers[:, None])
                if width:
                    parts.add(_elements(column, width))
        if rows:
            every = [s for pair in held for s in pair]
            out = {k: np.concatenate([getattr(s, k) for s in every]) for k in ("nulls", "infs", "low", "high")}
            n = len(out["nulls"])
            yield pa.RecordBatch.from_pydict({"i": np.arange(n, dtype=np.int32), "rows": np.full(n, rows), "nulls": out["nulls"], "infs": out["infs"],
                                              "low": pa.array(out["low"], from_pandas=True), "high": pa.array(out["high"], from_pandas=True)})

    sums = df.select(*cols).mapInArrow(run, "i int, rows long, nulls long, infs long, low double, high double")
    total = sums.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("rows", "nulls", "infs")], F.min("low").alias("min"), F.max("high").alias("max"))
    # An empty table has no sums, and yet a row of zeros for every column.
    named = F.from_json(F.lit(json.dumps([{"column": c, "element": e} for c, e in labels])), "array<struct<column:string,element:string>>")
    names = spark.range(1).select(F.posexplode(named).alias("i", "n")).select("i", "n.column", "n.element")
    zero = F.lit(0).cast("long")
    return names.join(total, "i", "left").orderBy("i").select(
        "column", "element", *[F.coalesce(c, zero).alias(c) for c in ("rows", "nulls", "infs")], "min", "max")


def _missing_counts(df: DataFrame, cols: list[str], inf_as_missing: bool) -> DataFrame:
    """(column, element, rows, nulls), infinite values among the nulls if asked."""
    nulls = F.col("nulls") + F.col("infs") if inf_as_missing else F.col("nulls")
    return profile(df, cols).select("column", "element", "rows", nulls.alias("nulls"))


def null_counts(df: DataFrame, cols: Iterable[str] | None = None, inf_as_missing: bool = False) -> dict[str, int]:
    """Missing (NULL/NaN, optionally +/-inf) count per column in one pass;
    the result is bounded by the table width."""
    cols = list(cols) if cols is not None else df.columns
    return {r["column"]: int(r["nulls"]) for r in _missing_counts(df, cols, inf_as_missing).where("element is null").collect()}


def null_profile(df: DataFrame, cols: Iterable[str] | None = None, inf_as_missing: bool = False) -> DataFrame:
    """``(column, nulls)`` for columns with at least one missing value,
    most-missing first (ties by name).  Stays a DataFrame."""
    counts = _missing_counts(df, list(cols) if cols is not None else df.columns, inf_as_missing).where("element is null and nulls > 0")
    return counts.select("column", "nulls").orderBy(F.col("nulls").desc(), F.col("column").asc())


def array_null_profile(df: DataFrame, x: str = "x", inf_as_missing: bool = False) -> DataFrame:
    """C2 over a packed signal array: ``(column, nulls)`` per element name."""
    counts = _missing_counts(df, [x], inf_as_missing).where("element is not null and nulls > 0")
    return counts.select(F.col("element").alias("column"), "nulls").orderBy(F.col("nulls").desc(), F.col("column").asc())


@dataclass
class Unfit:
    """Columns, and elements by packed array, that a rule drops."""

    columns: list[str]
    elements: dict[str, list[str]]

    def drop(self, *dfs: DataFrame) -> list[DataFrame]:
        """Gone from every frame; each must have them."""
        out = drop_columns(dfs, self.columns)
        for c, names in self.elements.items():
            out = [drop_elements(d, c, names) for d in out]
        return out

    @property
    def names(self) -> list[str]:
        return self.columns + [n for names in self.elements.values() for n in names]


def unfit(df: DataFrame, *rules: str) -> Unfit:
    """What fulfils any of the ``rules`` over ``profile``'s columns, in one pass.
    A named packed array goes as a whole only if all its elements do."""
    signals = signal_columns(df)
    found = [(r["column"], r["element"]) for r in profile(df).where(" or ".join(f"({r})" for r in rules)).collect()]
    elements = {c: [e for k, e in found if k == c and e is not None] for c in signals}
    empty = [c for c in signals if elements[c] and len(elements[c]) == len(A.names_of(df, c))]
    return Unfit([c for c, e in found if e is None and c not in signals] + empty, {c: e for c, e in elements.items() if e and c not in empty})


#: Rules over a profile: any missing value (C2, C3), any infinite one (C4),
#: nothing but missing ones (C5; of an empty table, every column).
HAS_MISSING, HAS_INF, ALL_MISSING = "nulls > 0", "infs > 0", "nulls = rows"


def drop_elements(df: DataFrame, x: str, names: Iterable[str]) -> DataFrame:
    """``df`` with the packed array ``x`` without the named elements."""
    have, gone = A.names_of(df, x), set(names)
    if missing := gone - set(have):
        raise KeyError(f"elements of {x} not found: {sorted(missing)[:10]}")
    left = [i for i, n in enumerate(have) if n not in gone]
    kept = F.transform(F.array(*map(F.lit, left)), lambda i: F.get(F.col(x), i))
    return df.select(*[A.with_names(F.when(F.col(x).isNotNull(), kept), x, [have[i] for i in left]) if c == x else F.col(c) for c in df.columns])


def drop_columns(dfs: Iterable[DataFrame], cols: Iterable[str], strict: bool = True) -> list[DataFrame]:
    """Drop ``cols`` from every frame; with ``strict`` each frame must have them."""
    cols = list(cols)
    out = []
    for d in dfs:
        if strict:
            missing = [c for c in cols if c not in set(d.columns)]
            if missing:
                raise KeyError(f"columns not found: {missing[:10]}")
        out.append(d.drop(*cols))
    return out


def drop_columns_by_profile(profile: DataFrame, *dfs: DataFrame) -> list[DataFrame]:
    """Drop every profiled column (bounded by table width) from all frames."""
    cols = [r["column"] for r in profile.select("column").collect()]
    return drop_columns(dfs, cols)


def inf_columns(df: DataFrame) -> list[str]:
    return unfit(df, HAS_INF).names


def drop_inf_columns(df: DataFrame) -> DataFrame:
    """C4: drop columns, and elements of packed arrays, holding any +/-inf."""
    return unfit(df, HAS_INF).drop(df)[0]


def all_null_columns(df: DataFrame) -> list[str]:
    return unfit(df, ALL_MISSING).names


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns, and elements of packed arrays, with no non-missing value."""
    return unfit(df, ALL_MISSING).drop(df)[0]


def drop_null_rows(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Drop rows with any NULL or NaN, in a column or inside a packed array."""
    cols = list(cols) if cols is not None else df.columns
    out = df.na.drop("any", subset=cols)
    for c in cols:
        if _is_signal(df.schema[c].dataType):
            out = out.where(~F.exists(c, lambda v: v.isNull() | F.isnan(v)))
    return out


def fill_null(df: DataFrame, value: float = 0.0, cols: Iterable[str] | None = None) -> DataFrame:
    """NULL (and NaN) -> ``value`` on numeric columns and in packed arrays."""
    fields = {f.name: f for f in df.schema.fields}
    signals = [c for c in (list(cols) if cols is not None else df.columns) if _is_signal(fields[c].dataType)]
    subset = [c for c in (list(cols) if cols is not None else numeric_columns(df)) if c not in signals]
    out = df.na.fill(value, subset=subset)
    for c in signals:
        filled = F.transform(c, lambda v: F.coalesce(F.when(~F.isnan(v), v), F.lit(value)))
        out = out.select(*[filled.alias(c, metadata=fields[c].metadata) if x == c else F.col(x) for x in out.columns])
    return out


def sanitize(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """+/-inf, NaN and NULL -> 0 (fractional, also inside packed arrays);
    NULL -> 0 (integral)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    target = set(cols) if cols is not None else {*numeric_columns(df), *(c for c, dt in fields.items() if _is_signal(dt))}

    def fix(c: str) -> Column:
        dt = fields[c]
        if c not in target:
            return F.col(c)
        if _is_fractional(dt):
            return finite_or_zero(c).cast(dt).alias(c)
        if _is_signal(dt):
            return F.transform(c, lambda v: finite_or_zero(v).cast(dt.elementType)).alias(c, metadata=df.schema[c].metadata)
        if _is_numeric(dt) and not isinstance(dt, T.BooleanType):
            return F.coalesce(F.col(c), F.lit(0).cast(dt)).alias(c)
        return F.col(c)

    return df.select(*[fix(c) for c in df.columns])


def finite_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Keep rows whose label is finite.  Written as a range predicate so
    the Parquet reader can push it down (``abs()`` would not push)."""
    c = F.col(label)
    return df.where((c > F.lit(-INF)) & (c < F.lit(INF)))


def split_label(df: DataFrame, label: str = "label", keys: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Features and label as two projections sharing ``keys`` (keep them
    in one frame wherever possible; Spark frames have no positional alignment)."""
    keys = list(keys)
    return df.drop(label), df.select(*keys, label)


# The strict type bounds used to narrow numeric columns.
INT_BOUNDS = [
    ("tinyint", -128, 127),
    ("smallint", -32768, 32767),
    ("int", -2147483648, 2147483647),
    ("bigint", -9223372036854775808, 9223372036854775807),
]
HALF_MAX = 65504.0
FLOAT_MAX = float(np.finfo(np.float32).max)


def narrow_plan(df: DataFrame) -> DataFrame:
    """C16 report: ``(column, min, max, from_type, to_type)`` per numeric column
    and per packed array (over all its elements), from one pass.  Bounds are
    strict (``>min`` and ``<max``); integer columns step through
    tinyint..bigint, others through half->float->double.  Spark has no half
    type, so the half range maps to ``float``."""
    fields = [f for f in df.schema.fields if _is_numeric(f.dataType)] + [df.schema[c] for c in signal_columns(df)]
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, min double, max double, from_type string, to_type string")
    kinds = F.from_json(F.lit(json.dumps({f.name: f.dataType.simpleString() for f in fields})), "map<string,string>")
    stats = profile(df, [f.name for f in fields]).groupBy("column").agg(F.min("min").alias("min"), F.max("max").alias("max"))
    stats = stats.select("column", "min", "max", F.element_at(kinds, F.col("column")).alias("from_type"))
    lo, hi = F.col("min"), F.col("max")
    is_int = F.col("from_type").isin("tinyint", "smallint", "int", "bigint")
    int_rule = F.lit("bigint")
    for name, mn, mx in reversed(INT_BOUNDS[:-1]):
        int_rule = F.when((lo > F.lit(float(mn))) & (hi < F.lit(float(mx))), F.lit(name)).otherwise(int_rule)
    float_rule = F.when((lo > F.lit(-FLOAT_MAX)) & (hi < F.lit(FLOAT_MAX)), F.lit("float")).otherwise(F.lit("double"))
    packed = F.concat(F.lit("array<"), float_rule, F.lit(">"))
    to_type = (F.when(F.col("from_type").startswith("array<"), packed)
               .when(is_int & lo.isNull(), F.col("from_type"))
               .when(is_int, int_rule).otherwise(float_rule))
    return stats.select("column", "min", "max", "from_type", to_type.alias("to_type"))


def narrow_types(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (report, narrowed frame).  The report is collected (one row
    per column) to build a single casting projection."""
    report = narrow_plan(df)
    plan = {r["column"]: r["to_type"] for r in report.select("column", "to_type").collect()}
    out = df.select(*[F.col(c).cast(plan[c]).alias(c, metadata=df.schema[c].metadata) if c in plan else F.col(c) for c in df.columns])
    return report, out


def category_to_int(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """C17: categorical values -> integers by value cast (raises on non-numeric
    text under ANSI, as the reference does)."""
    target = set(cols)
    return df.select(*[F.col(c).cast("int").alias(c) if c in target else F.col(c) for c in df.columns])
