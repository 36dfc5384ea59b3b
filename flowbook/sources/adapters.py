"""Views that reshape the driver's tables into order-book form.

Nothing in the test data is order-book shaped, so these deterministic,
plain-arithmetic views stand in for the labelled/unlabelled market tables.
Every formula is simple enough for DuckDB to repeat exactly (see
``oracle_sql.py``).  Integer ``%`` results are cast to double explicitly so
both engines add in the same order and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.functions.arrays import with_names

SCAN_PARTITIONS = "flowbook.scan.partitions"
MARKET_COLS = ("bid_qty", "ask_qty", "buy_qty", "sell_qty", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A plain scan; its splits follow from ``spark.sql.files.*``.  Only where the
    user asks for it (``SCAN_PARTITIONS``, for tables of one row group, which no
    split size can divide) the rows are dealt out anew."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = int(spark.conf.get(SCAN_PARTITIONS, "0"))
    return df.repartition(parts) if parts else df


def _mod(c: str, m: int) -> Column:
    return (F.col(c) % F.lit(m)).cast("double")


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` -> ordered market snapshots (unique ``row_id`` and ``ts``)."""
    ev = table(spark, sf_dir, "events")
    buy = F.col("value") * F.lit(0.4) + _mod("user_id", 13)
    sell = F.col("value") * F.lit(0.3) + _mod("event_id", 11)
    base = ev.select(
        F.col("event_id").alias("row_id"),
        "ts",
        F.col("value").alias("bid_qty"),
        (_mod("event_id", 97) + F.lit(0.5)).alias("ask_qty"),
        buy.alias("buy_qty"),
        sell.alias("sell_qty"),
        (buy + sell + _mod("user_id", 7)).alias("volume"),
    )
    label = F.try_divide(
        F.col("buy_qty") - F.col("sell_qty"), F.col("volume") + F.lit(1.0)
    )
    return base.select("*", label.alias("label"))


def market_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` -> bulk, order-insensitive market rows."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_quantity").alias("bid_qty"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("ask_qty"),
        (F.col("l_quantity") * (F.lit(1.0) - F.col("l_discount"))).alias("buy_qty"),
        (F.col("l_quantity") * (F.lit(1.0) - F.col("l_tax"))).alias("sell_qty"),
        (F.col("l_extendedprice") / F.lit(100.0)).alias("volume"),
        (F.col("l_discount") - F.col("l_tax")).alias("label"),
        "l_returnflag",
    )


def signals(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """``embeddings`` -> anonymous signal columns.

    Array layout (default): ``row_id long, x array<double>`` with the ordered
    names ``X1..Xd`` stored in the column metadata.  ``wide=True`` expands to
    ``X1..Xd`` double columns (the reference's own layout).
    """
    emb = table(spark, sf_dir, "embeddings")
    width = _embedding_width(emb)
    names = [f"X{i + 1}" for i in range(width)]
    x = F.transform("embedding", lambda v: v.cast("double"))
    out = emb.select(F.col("vec_id").alias("row_id"), with_names(x, "x", names))
    if wide:
        out = out.select("row_id", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    return out


def _embedding_width(emb: DataFrame) -> int:
    # The parquet schema does not carry the fixed length; one aggregate over the
    # whole table finds it and refuses ragged rows.
    n = F.size("embedding")
    row = emb.where(F.col("embedding").isNotNull()).agg(F.min(n).alias("low"), F.max(n).alias("high")).first()
    if row["low"] != row["high"]:
        raise ValueError(f"embeddings of {row['low']} to {row['high']} elements")
    return int(row["high"] or 0)


def market_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every market event with one of the ``signals``: vector ``row_id mod n`` of
    the n vectors, whose ids run from 0 (an equi-join, one vector to many events)."""
    vectors = signals(spark, sf_dir)
    return _with_vectors(market_events(spark, sf_dir), vectors, vectors.count())


def _with_vectors(events: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    keyed = vectors.withColumnRenamed("row_id", "_vec")
    return events.withColumn("_vec", F.col("row_id") % F.lit(max(n, 1))).join(keyed, "_vec").drop("_vec")


#: Signals of the boosted-tree flow's tables.
ALL_SIGNALS = 171


def market_all_signals(spark: SparkSession, sf_dir: str, width: int = ALL_SIGNALS) -> DataFrame:
    """``market_signals`` with ``width`` signals: the vector's elements, then
    products of each with the one 1, 2, ... places on."""
    vectors = signals(spark, sf_dir)
    own = len(vectors.schema["x"].metadata["names"])
    x = F.col("x")

    def product(i: Column) -> Column:
        return F.get(x, i % own) * F.get(x, (i + (i / own).cast("int")) % own)

    more = F.transform(F.sequence(F.lit(own), F.lit(width - 1)), product)
    longer = with_names(F.concat(x, more) if width > own else F.slice(x, 1, width), "x", [f"X{i + 1}" for i in range(width)])
    return _with_vectors(market_events(spark, sf_dir), vectors.select("row_id", longer), vectors.count())


def dirty(df: DataFrame, cols: list[str], id_col: str = "row_id") -> DataFrame:
    """Inject missing / infinite / NaN values deterministically by id:
    ``id % 50 = 0`` -> NULL, ``% 51`` -> +inf, ``% 53`` -> NaN (first wins)."""
    rid = F.col(id_col)

    def inject(c: str) -> Column:
        return (
            F.when(rid % 50 == 0, F.lit(None).cast("double"))
            .when(rid % 51 == 0, F.lit(float("inf")))
            .when(rid % 53 == 0, F.lit(float("nan")))
            .otherwise(F.col(c).cast("double"))
            .alias(c)
        )

    return df.select(*[inject(c) if c in cols else F.col(c) for c in df.columns])
