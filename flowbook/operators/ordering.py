"""Ordering operators: global position, chronological / random splits,
contiguous folds, top-k and exact k-th value.

Global position (O2) without a single-partition window
------------------------------------------------------
``row_number() over (order by k)`` with no partition key funnels every row
through one task.  Instead:

1. count ``n`` (metadata-only on an unfiltered Parquet scan);
2. sample the *full* order key (a bounded number of tuples, ``oversample``
   per bucket), sort on the driver and keep ``B - 1`` split tuples;
3. bucket id = number of split tuples <= row key, found by a binary search
   written as a higher-order ``aggregate`` over the split array (JVM-side,
   O(log B) per row).  Because the split points are fixed literals, the
   bucket of a row never changes on recomputation (executor loss, AQE);
4. per-bucket counts (key-only scan, map-side partial aggregate; at most B
   rows reach the driver) -> prefix sums -> a constant offsets array;
5. ``offsets[bucket] + row_number() over (partition by bucket order by key) - 1``:
   one shuffle (hash on bucket), no join.

Ties in a leading key (e.g. one timestamp holding a third of all rows) are
still split across buckets because split points are whole key tuples; the
order must be total, so pass a unique tiebreaker (``row_id``) last.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbook.session import ship_package


@dataclass
class Positioned:
    df: DataFrame
    n: int
    buckets: int


def _orderable(df: DataFrame, c: str) -> Column:
    """Order-preserving primitive form of a key column (exact in JSON)."""
    dt = df.schema[c].dataType
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(c))
    if isinstance(dt, T.TimestampNTZType):
        return F.unix_micros(F.col(c).cast("timestamp"))
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(c))
    if isinstance(dt, T.BooleanType):
        return F.col(c).cast("int")
    return F.col(c)


def _split_tuples(keyed: DataFrame, n: int, buckets: int, oversample: int, seed: int) -> list[tuple]:
    target = buckets * oversample
    frac = min(1.0, target / max(n, 1))
    sample = keyed
    if frac < 1.0:
        sample = sample.sample(withReplacement=False, fraction=frac, seed=seed)
    rows = sorted((tuple(r) for r in sample.collect()), key=_sort_key)
    if not rows:
        return []
    picks: list[tuple] = []
    for i in range(1, buckets):
        t = rows[min(len(rows) - 1, (i * len(rows)) // buckets)]
        if not picks or _sort_key(t) > _sort_key(picks[-1]):
            picks.append(t)
    return picks


def _sort_key(row: tuple) -> list[tuple]:
    """Spark's ascending order of key tuples: NULL first, NaN last."""
    return [(0, 0) if v is None else (2, 0) if v != v else (1, v) for v in row]


#: So many boundaries are compared one after the other.
FEW_SPLITS = 4


def _constant(key_types: list[T.DataType], splits: list[tuple]) -> Column:
    """Key tuples as a foldable literal: parsed once by constant folding, shipped in the task binary."""
    st = T.StructType([T.StructField(f"k{i}", t, True) for i, t in enumerate(key_types)])
    payload = json.dumps([{f"k{i}": v for i, v in enumerate(tup)} for tup in splits], default=str)  # decimals as text
    return F.from_json(F.lit(payload), T.ArrayType(st, False), {"allowNonNumericNumbers": "true"})


def _reached(key_types: list[T.DataType], key: Column, split: tuple) -> Column:
    """Whether ``split <= key``."""
    return F.coalesce(F.element_at(_constant(key_types, [split]), 1) <= key, F.lit(False))


def _bucket_expr(key_types: list[T.DataType], key: Column, splits: list[tuple]) -> Column:
    """Number of split tuples <= ``key`` by binary search over a constant array."""
    if not splits:
        return F.lit(0)
    m = len(splits)
    if m <= FEW_SPLITS:  # plain comparisons, which are compiled
        return sum((_reached(key_types, key, s).cast("int") for s in splits), F.lit(0))
    split_col = _constant(key_types, splits)
    steps = max(1, math.ceil(math.log2(m + 1)))
    init = F.struct(F.lit(0).alias("lo"), F.lit(m).alias("hi"))

    def step(acc: Column, _i: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        mid = ((lo + hi + F.lit(1)) / F.lit(2)).cast("int")
        up = F.coalesce(F.element_at(split_col, F.greatest(mid, F.lit(1))) <= key, F.lit(False))
        active = lo < hi
        return F.struct(
            F.when(active & up, mid).otherwise(lo).alias("lo"),
            F.when(active & ~up, mid - F.lit(1)).otherwise(hi).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)["lo"]


def choose_buckets(n: int, parallelism: int, rows_per_bucket: int,
                   min_rows_per_bucket: int = 4096) -> int:
    by_size = math.ceil(n / rows_per_bucket)
    by_par = min(2 * parallelism, math.ceil(n / min_rows_per_bucket))
    return int(max(1, by_size, by_par))


@dataclass
class Buckets:
    """Rows dealt by split tuples of the order key, and where each bucket begins."""

    bucket: Column
    key: Column
    key_types: list[T.DataType]
    offsets: list[int]
    n: int
    splits: list[tuple]

    def holds(self, i: int) -> Column:
        """Whether bucket ``i`` holds a row, by its two bounds alone."""
        low = _reached(self.key_types, self.key, self.splits[i - 1]) if i else F.lit(True)
        return low & ~_reached(self.key_types, self.key, self.splits[i]) if i < len(self.splits) else low


def bucketed(
    df: DataFrame,
    order: list[str],
    rows_per_bucket: int = 1 << 20,
    oversample: int = 8,
    seed: int = 7,
    n: int | None = None,
    buckets: int | None = None,
) -> Buckets:
    """Buckets of ``df`` by the order key: a sample and one key-only count."""
    spark = df.sparkSession
    n = df.count() if n is None else n
    if buckets is None:
        buckets = choose_buckets(n, spark.sparkContext.defaultParallelism, rows_per_bucket)
    key_cols = [_orderable(df, c).alias(f"k{i}") for i, c in enumerate(order)]
    key_types = [df.select(kc).schema[0].dataType for kc in key_cols]
    splits = (_split_tuples(df.select(*key_cols), n, buckets, oversample, seed) if buckets > 1 else [])
    bcol = "_bucket"
    key = F.struct(*key_cols)
    bucket = _bucket_expr(key_types, key, splits)

    # per-bucket counts: a key-only scan with map-side partial counts; at most
    # B rows reach the driver, where the prefix sums are formed
    counts = {int(r[0]): int(r[1]) for r in
              df.select(bucket.alias(bcol)).groupBy(bcol).count().collect()}
    offsets, run = [], 0
    for b in range(len(splits) + 1):
        offsets.append(run)
        run += counts.get(b, 0)
    return Buckets(bucket, key, key_types, offsets, n, splits)


def with_position(df: DataFrame, order: list[str], pos_col: str = "pos", **kw) -> Positioned:
    """Attach a 0-based global position in ``order`` (ascending, NULLs first)."""
    b, bcol = bucketed(df, order, **kw), "_bucket"
    off_col = F.from_json(F.lit(json.dumps(b.offsets)), T.ArrayType(T.LongType(), False))
    w = Window.partitionBy(bcol).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    out = (
        df.withColumn(bcol, b.bucket)
        .repartition(len(b.offsets), bcol)  # as many tasks as buckets
        .withColumn(pos_col, (F.element_at(off_col, F.col(bcol) + F.lit(1))
                              + F.row_number().over(w) - F.lit(1)).cast("long"))
        .drop(bcol)
    )
    return Positioned(out, b.n, len(b.offsets))


def parts_by_rank(df: DataFrame, order: list[str], ranks_of, **kw) -> tuple[Column, int]:
    """The part (0-based) of each row when ``df`` is cut in ``order`` at the
    ranks ``ranks_of(n)``, and n.  No row is shuffled: the buckets' counts tell
    which bucket holds a rank, that bucket's keys alone are numbered, and the
    part is the number of boundary keys up to the row's.  The order must be
    total (end it with a unique column)."""
    b = bucketed(df, order, **kw)
    ranks = [r for r in ranks_of(b.n) if 0 < r < b.n]
    if not ranks:
        return F.lit(sum(1 for r in ranks_of(b.n) if r <= 0)), b.n
    want = {(bisect_right(b.offsets, r) - 1, r) for r in ranks}
    at = [F.struct(F.lit(i).alias("b"), F.lit(r - b.offsets[i] + 1).alias("rn")) for i, r in sorted(want)]
    own = F.coalesce(*[F.when(b.holds(i), F.lit(i)) for i in sorted({i for i, _ in want})])
    keys = df.select(own.alias("b"), b.key.alias("key")).where(F.col("b").isNotNull())
    numbered = keys.withColumn("rn", F.row_number().over(Window.partitionBy("b").orderBy("key")))
    found = numbered.where(F.struct("b", "rn").isin(at)).orderBy("key").collect()
    low = sum(1 for r in ranks_of(b.n) if r <= 0)
    return _bucket_expr(b.key_types, b.key, [tuple(r["key"]) for r in found]) + low, b.n


def global_position(df: DataFrame, order: list[str], pos_col: str = "pos", **kw) -> DataFrame:
    """O2: 0-based position of each row in ``order``."""
    return with_position(df, order, pos_col, **kw).df


def sort_by_time(df: DataFrame, ts: str = "ts", tiebreak: str = "row_id") -> DataFrame:
    """O1: ascending time order (range-partitioned sort)."""
    return df.orderBy(F.col(ts).asc_nulls_first(), F.col(tiebreak).asc_nulls_first())


def chrono_split(df: DataFrame, frac: float = 0.8, order: list[str] | None = None,
                 **kw) -> tuple[DataFrame, DataFrame, int]:
    """O3: first ``int(frac*n)`` rows (in ``order``) vs the rest, as two filters on
    the order key (no shuffle of rows).  Returns (train, validation, split_index)."""
    part, n = parts_by_rank(df, order or ["ts", "row_id"], lambda n: [int(n * frac)], **kw)
    return df.where(part == 0), df.where(part == 1), int(n * frac)


def hash_order_key(id_col: str, seed: int) -> Column:
    """Deterministic pseudo-random order key, reproducible in SQL engines."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def random_split(df: DataFrame, test_size: float = 0.3, seed: int = 42, id_col: str = "row_id",
                 split_col: str = "split", **kw) -> DataFrame:
    """Exact-size shuffled split: ``ceil(test_size*n)`` rows get
    ``split='test'``, the rest ``'train'``; membership by md5 rank."""
    keyed = df.withColumn("_h", hash_order_key(id_col, seed))
    part, _ = parts_by_rank(keyed, ["_h", id_col], lambda n: [math.ceil(test_size * n)], **kw)
    return keyed.withColumn(split_col, F.when(part == 0, "test").otherwise("train")).drop("_h")


def fold_of(pos: Column, n: int, k: int) -> Column:
    """Contiguous k-fold id (0-based) of position ``pos``; the first ``n % k``
    folds hold one extra row (scikit-learn KFold without shuffle)."""
    q, r = divmod(n, k)
    big = r * (q + 1)
    if q == 0:
        return pos.cast("int")
    return F.when(pos < big, (pos / F.lit(q + 1)).cast("int")).otherwise(
        (F.lit(r) + ((pos - F.lit(big)) / F.lit(q)).cast("int"))).cast("int")


def fold_bounds(n: int, k: int) -> list[tuple[int, int]]:
    q, r = divmod(n, k)
    out, start = [], 0
    for f in range(k):
        size = q + (1 if f < r else 0)
        out.append((start, start + size))
        start += size
    return out


def contiguous_kfold(df: DataFrame, k: int = 5, order: list[str] | None = None, fold_col: str = "fold",
                     pos_col: str | None = "pos", **kw) -> Positioned:
    """Contiguous folds in ``order``.  With ``pos_col`` the position is kept
    too (one shuffle); without, folds are cut by boundary keys and no row moves."""
    if pos_col is None:
        part, n = parts_by_rank(df, order or ["ts", "row_id"], lambda n: [a for a, _ in fold_bounds(n, k)][1:], **kw)
        if n < k:
            raise ValueError(f"cannot split {n} rows into {k} folds")
        return Positioned(df.withColumn(fold_col, part.cast("int")), n, 0)
    p = with_position(df, order or ["ts", "row_id"], pos_col, **kw)
    if p.n < k:
        raise ValueError(f"cannot split {p.n} rows into {k} folds")
    return Positioned(p.df.withColumn(fold_col, fold_of(F.col(pos_col), p.n, k)), p.n, p.buckets)


def shuffled_kfold(df: DataFrame, k: int = 5, seed: int = 37, id_col: str = "row_id",
                   fold_col: str = "fold", **kw) -> DataFrame:
    """Folds over an md5-shuffled order."""
    keyed = df.withColumn("_h", hash_order_key(id_col, seed))
    return contiguous_kfold(keyed, k, ["_h", id_col], fold_col, None, **kw).df.drop("_h")


def fold_filter(df: DataFrame, k: int, fold_col: str = "fold") -> DataFrame:
    """Rows of one fold."""
    return df.where(F.col(fold_col) == k)


def top_k(df: DataFrame, by: str, k: int, tiebreak: str | None = None) -> DataFrame:
    """K largest by ``by`` (ties by ``tiebreak`` ascending).  Planned as
    TakeOrderedAndProject: per-partition top-k, then a k*partitions merge."""
    keys = [F.col(by).desc_nulls_last()] + ([F.col(tiebreak).asc()] if tiebreak else [])
    return df.orderBy(*keys).limit(k)


@dataclass
class _Rank:
    """An open rank of a column: ``rank`` among the ``size`` values strictly
    between ``low`` and ``high`` (None: no bound)."""

    rank: int
    size: int
    low: float | None = None
    high: float | None = None


def _between(x: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    own = ~np.isnan(x)
    if low is not None:
        own &= x > low
    if high is not None:
        own &= x < high
    return own


def _column(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _probe_counts(df: DataFrame, probes: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every column of ``df`` (doubles) and its ascending ``probes``: how
    many values lie below each, and at or below each.  One pass; a task sends a
    row per column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, upto = ([np.zeros(len(p) + 1, np.int64) for p in probes] for _ in range(2))
        for batch in batches:
            for i, p in enumerate(probes):
                x = _column(batch, i)
                x = x[~np.isnan(x)]
                below[i] += np.bincount(np.searchsorted(p, x, side="right"), minlength=len(p) + 1)
                upto[i] += np.bincount(np.searchsorted(p, x, side="left"), minlength=len(p) + 1)
        rows = [(i, k, int(lt), int(le)) for i in range(len(probes)) for k, (lt, le) in enumerate(zip(below[i], upto[i])) if lt or le]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["i", "k", "lt", "le"])

    sums = df.mapInArrow(run, "i int, k int, lt long, le long").groupBy("i", "k").agg(F.sum("lt").alias("lt"), F.sum("le").alias("le"))
    steps = [(np.zeros(len(p) + 1, np.int64), np.zeros(len(p) + 1, np.int64)) for p in probes]
    for r in sums.collect():  # the probes' number, whatever the rows'
        steps[r["i"]][0][r["k"]], steps[r["i"]][1][r["k"]] = r["lt"], r["le"]
    return [(np.cumsum(lt)[:-1], np.cumsum(le)[:-1]) for lt, le in steps]


def _values_between(df: DataFrame, wanted: list[tuple[int, float | None, float | None]]) -> list[np.ndarray]:
    """The values of column i between two bounds, sorted, for each (i, low, high);
    few by the callers' choice.  One pass."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {i: _column(batch, i) for i, _, _ in wanted}
            found = [columns[i][_between(columns[i], low, high)] for i, low, high in wanted]
            yield pa.RecordBatch.from_pydict({"k": np.repeat(np.arange(len(found), dtype=np.int32), list(map(len, found))), "v": np.concatenate(found)})

    rows = df.mapInArrow(run, "k int, v double").collect()
    out: list[list[float]] = [[] for _ in wanted]
    for r in rows:
        out[r["k"]].append(r["v"])
    return [np.sort(np.array(v)) for v in out]


def kth_values_multi(df: DataFrame, requests: dict[str, list[int]], ns: dict[str, int] | None = None,
                     rel_err: float = 1e-3, direct_limit: int = 4096) -> dict[tuple[str, int], float | None]:
    """Exact values at 0-based ascending ranks, for several columns and ranks
    at once (NULL/NaN excluded per column).

    A round takes the same three passes whatever the number of columns: one
    ``approxQuantile`` call over all open brackets sketches them on a grid of
    ``rel_err``; one counting pass checks, for each rank, the grid's values
    around it; and brackets of at most ``direct_limit`` values are gathered
    together.  A probe whose value spans the rank is the answer - a hot value
    is accepted without touching its rows.  Otherwise the rank's bracket
    shrinks from both sides to a few ``rel_err`` of its size.  Nothing
    unbounded reaches the driver and no single task gathers a group."""
    cols = list(requests)
    if not cols:
        return {}
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    if ns is None:
        every = _probe_counts(data, [np.array([np.inf])] * len(cols))
        ns = {c: int(every[i][1][0]) for i, c in enumerate(cols)}
    out: dict[tuple[str, int], float | None] = {}
    todo: dict[tuple[str, int], _Rank] = {}
    for c, ranks in requests.items():
        for r in set(ranks):
            if 0 <= r < ns[c]:
                todo[c, r] = _Rank(r, ns[c])
            else:
                out[c, r] = None

    at = {c: i for i, c in enumerate(cols)}
    for _ in range(64):
        small = sorted({(at[c], st.low, st.high) for (c, _), st in todo.items() if st.size <= direct_limit}, key=repr)
        if small:
            values = dict(zip(small, _values_between(data, small)))
            for (c, r), st in list(todo.items()):
                if (key := (at[c], st.low, st.high)) in values:
                    out[c, r] = float(values[key][st.rank])
                    del todo[c, r]
        if not todo:
            return out
        brackets = sorted({(at[c], st.low, st.high) for (c, _), st in todo.items()}, key=repr)
        place = {b: i for i, b in enumerate(brackets)}

        def inside(i: int, low: float | None, high: float | None) -> Column:
            x, own = F.col(f"c{i}"), ~F.isnan(f"c{i}")
            own = own if low is None else own & (x > F.lit(low))
            return F.when(own if high is None else own & (x < F.lit(high)), x)

        grid = int(round(1 / rel_err))
        need = {k: (max(0, int(((st.rank + 0.5) / st.size) * grid) - 2), min(grid, int(((st.rank + 0.5) / st.size) * grid) + 3)) for k, st in todo.items()}
        steps = sorted({g for lo, hi in need.values() for g in range(lo, hi + 1)})
        sketched = data.select(*[inside(*b).alias(f"b{i}") for i, b in enumerate(brackets)]).approxQuantile([f"b{i}" for i in range(len(brackets))], [g / grid for g in steps], rel_err)
        step_at = {g: i for i, g in enumerate(steps)}
        tried = {k: [sketched[place[at[k[0]], todo[k].low, todo[k].high]][step_at[g]] for g in range(lo, hi + 1)] for k, (lo, hi) in need.items()}
        probes = [np.unique([v for k, vs in tried.items() if at[k[0]] == i for v in vs] + [x for k, st in todo.items() if at[k[0]] == i for x in (st.low, st.high) if x is not None]) for i in range(len(cols))]
        counted = _probe_counts(data, probes)
        for k, vs in tried.items():
            st, i = todo[k], at[k[0]]
            # Ranks below are counted from the bracket's beginning.
            base = 0 if st.low is None else int(counted[i][1][np.searchsorted(probes[i], st.low)])
            low, off, high, top = st.low, 0, st.high, st.size
            for v in sorted(set(vs)):
                j = np.searchsorted(probes[i], v)
                lt, le = int(counted[i][0][j]) - base, int(counted[i][1][j]) - base
                if lt <= st.rank < le:
                    out[k] = float(v)
                    break
                if le <= st.rank and le >= off:
                    low, off = float(v), le
                if lt > st.rank and lt <= top:
                    high, top = float(v), lt
            else:
                todo[k] = _Rank(st.rank - off, top - off, low, high)
                continue
            del todo[k]
    raise RuntimeError("kth_values did not converge")


def kth_values(df: DataFrame, c: str, ranks: list[int], n: int | None = None, rel_err: float = 1e-3,
               direct_limit: int = 4096) -> dict[int, float | None]:
    """Exact values at 0-based ranks of one column (see ``kth_values_multi``)."""
    res = kth_values_multi(df, {c: list(ranks)}, None if n is None else {c: n}, rel_err, direct_limit)
    return {r: res[(c, r)] for r in ranks}


def kth_smallest(df: DataFrame, c: str, r: int, n: int | None = None, rel_err: float = 1e-3,
                 direct_limit: int = 4096) -> float | None:
    """Exact value at 0-based rank ``r`` of column ``c`` (see ``kth_values``)."""
    return kth_values(df, c, [r], n, rel_err, direct_limit)[r]


def nth_largest(df: DataFrame, c: str, k: int, n: int | None = None) -> float | None:
    """The k-th largest value (1-based) of ``c``."""
    col = F.col(c)
    if n is None:
        n = df.where(col.isNotNull() & ~F.isnan(col)).count()
    return kth_smallest(df, c, n - k, n=n)
