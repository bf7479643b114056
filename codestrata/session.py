"""Session settings and the shared folder that lineage is cut into."""

from __future__ import annotations

import atexit
import glob
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(cores: str | int = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """Session for one machine; on a cluster pass your own session to the operators instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codestrata")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Where that is unset and all runs in one process
    (tests, one machine), a folder of this process takes its place; on a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _process_dir()
    return f"{named.rstrip('/')}/codestrata-{spark.sparkContext.applicationId}"


_own: list[str] = []


def _process_dir() -> str:
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="codestrata-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def clear(spark: SparkSession) -> None:
    """Remove all tables that lineage was cut into by this application, once their readers are done: results that were not written
    elsewhere cannot be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later stages, and retries after
    a lost executor, start from the files instead of recomputing what led to them."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, limit_bytes: int = 32 << 20, row_bytes: int = 64) -> bool:
    """True if ``df`` is proven to have at most ``limit_bytes``: it is counted up to that bound only."""
    most = limit_bytes // row_bytes
    return df.limit(most + 1).count() <= most


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that they need not find it by their path."""
    context = spark.sparkContext
    if getattr(context, "_codestrata_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="codestrata-code-"), "codestrata.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in glob.glob(f"{PACKAGE_ROOT}/codestrata/**/*.py", recursive=True):
            z.write(f, os.path.relpath(f, PACKAGE_ROOT))
    context.addPyFile(path)
    context._codestrata_shipped = True
