"""Sources and sinks (S1-S5): Parquet tables, the prediction template CSV,
the prediction CSV sink with a metric-stamped name, and model persistence.

Reads declare their columns so the Parquet scan is pruned; writes are
distributed (one part file per partition) unless a single file is asked
for explicitly, which coalesces to one task and is only meant for small
submission files.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbook.functions.numeric import nan_to_null
from flowbook.operators.metrics import pearson

CRLF = "\r\n"
TEMPLATE_SCHEMA = T.StructType([
    T.StructField("ID", T.LongType(), True),
    T.StructField("prediction", T.DoubleType(), True),
])


@dataclass
class MarketTables:
    train: DataFrame
    valid: DataFrame


def parquet_load(spark: SparkSession, train_path: str, valid_path: str,
                 columns: Iterable[str] | None = None, nan_as_null: bool = True) -> MarketTables:
    """Read the labelled and unlabelled tables; with ``columns`` the scan
    reads only those columns (missing ones are an error).  NaN becomes NULL, the
    engine's only missing value; without ``nan_as_null`` filters reach the scan."""
    tables = [spark.read.parquet(p) for p in (train_path, valid_path)]
    if columns is not None:
        cols = list(columns)
        tables = [t.select(*cols) for t in tables]
    if nan_as_null:
        tables = [t.select(*[nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, T.FloatType | T.DoubleType) else F.col(f.name) for f in t.schema.fields]) for t in tables]
    return MarketTables(*tables)


def read_template(spark: SparkSession, path: str, schema: T.StructType = TEMPLATE_SCHEMA) -> DataFrame:
    """The (ID, prediction) template, header line, explicit schema (no
    inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_predictions(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> str:
    """S3: write (ID, prediction) as CSV with a header and CR LF line ends: a
    folder of part files, or with ``single_file`` one file of that name, written
    by one task in the order of ID (bounded outputs only)."""
    out = df.select("ID", "prediction")
    if not single_file:
        out.write.mode(mode).option("header", True).option("lineSep", CRLF).csv(path)
        return path
    spark = df.sparkSession
    folder = f"{path}.parts"
    out.coalesce(1).sortWithinPartitions("ID").write.mode("overwrite").option("header", True).option("lineSep", CRLF).csv(folder)
    # Renamed through Hadoop's file system, so that any store Spark writes to will do.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, parts = hadoop.Path(path), hadoop.Path(folder)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = [s.getPath() for s in store.listStatus(parts) if s.getPath().getName().startswith("part-")]
    if store.exists(target):
        if mode != "overwrite":
            raise FileExistsError(path)
        store.delete(target, True)
    store.rename(written[0], target)
    store.delete(parts, True)
    return path


def stamped_name(r: float | None, prefix: str = "pred_piereson_cor", suffix: str = ".csv") -> str:
    """S4 naming rule: the correlation with six decimals in the file name."""
    return f"{prefix}{(r if r is not None else float('nan')):0.6f}{suffix}"


def write_stamped(df: DataFrame, previous: DataFrame, out_dir: str, single_file: bool = False) -> str:
    """Correlate new predictions with the template's (joined on ID), name
    the output by that correlation and write it."""
    j = df.select("ID", F.col("prediction").alias("_new")).join(
        previous.select("ID", F.col("prediction").alias("_old")), "ID")
    r = pearson(j, "_old", "_new")
    path = f"{out_dir.rstrip('/')}/{stamped_name(r)}"
    write_predictions(df, path, single_file=single_file)
    return path


def save_model(model, path: str) -> str:
    """Persist a fitted Spark model or pipeline (overwrite)."""
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    """Load a saved ``PipelineModel``."""
    return PipelineModel.load(path)
