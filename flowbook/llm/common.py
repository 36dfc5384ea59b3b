"""What the operators share: reading a table, keeping an intermediate table in
the cluster's shared folder, and shipping task functions to workers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.session import scratch_path

#: ASCII white space that separates words.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(module: str) -> None:
    """Pickle this module's functions by value, so that workers need no copy
    of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back:
    the lineage ends there, and any executor can read the rows again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_md5(text: str | Column = "text") -> Column:
    """md5 of the text, null as the empty text: with doc_id, the identity of a
    document when ids repeat."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
