"""Session helpers: a tuned local session for tests/bench and the
lineage-cutting rule used by iterative operators.

On a cluster the session comes from the platform; ``get_session`` is only a
convenience for local runs.  ``checkpoint_dir`` reads ``spark.checkpoint.dir``
from the running session and falls back to a private scratch folder only
when the setting is absent (local tests).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None


def get_session(
    master: str | None = None,
    app_name: str = "flowbook",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS") or "8"
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FLOWBOOK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune_session(spark)
    ensure_checkpoint_dir(spark)
    return spark


# Runtime SQL settings the feature maps rely on for speed.  Wide projections
# (58-100 formulas) generate Java methods beyond HotSpot's 8000-byte JIT
# limit; capping whole-stage methods there makes Spark fall back to
# per-operator code with split methods, which the JIT does compile.
RECOMMENDED_SQL_CONF = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune_session(spark: SparkSession) -> SparkSession:
    """Apply ``RECOMMENDED_SQL_CONF`` entries the user has not set."""
    for k, v in RECOMMENDED_SQL_CONF.items():
        try:
            current = spark.conf.get(k, None)
        except Exception:  # noqa: BLE001
            current = None
        if current is None or current == "65535":
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if
    the session has none configured (tests / single machine)."""
    global _LOCAL_DIR
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="flowbook-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", _LOCAL_DIR)
    spark.sparkContext.setCheckpointDir(_LOCAL_DIR)
    return spark.sparkContext.getCheckpointDir() or _LOCAL_DIR


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder (for model files and
    written intermediate tables that must survive executor loss)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its lineage
    cut, readable again after the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``flowbook`` importable in Python workers (what ``--py-files``
    does): zip the package once per session and ``addPyFile`` it."""
    key = spark.sparkContext.applicationId
    with _SHIPPING:  # folds are fitted in threads
        if key in _SHIPPED:
            return
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        out = tempfile.mkdtemp(prefix="flowbook-pkg-", dir="/tmp")
        archive = shutil.make_archive(os.path.join(out, "flowbook"), "zip", root_dir=root, base_dir="flowbook")
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(key)
