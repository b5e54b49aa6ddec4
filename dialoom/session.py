"""Session helpers."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "dialoom") -> SparkSession:
    """A local session for tests and benchmarks; a cluster session is passed in by the caller."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a session on this machine alone (``local`` master) gets a temporary folder; on a cluster, whose
    executors would each write to their own disk, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/dialoom/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Lets Python tasks of this session get at most about ``size`` bytes of rows at a time, whatever the length of the texts.

    Every operator with Python tasks calls this, so batches do not depend on which one ran before. The setting stays, as results are computed later
    than the operator returns; a smaller one is left as it is.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("bB"))
    if now <= 0 or now > size:
        spark.conf.set(name, f"{size}b")


@contextlib.contextmanager
def one_file_a_task(spark: SparkSession):
    """While it lasts, a task reads one file (of a large one a part), so a table keeps the pieces in which it was written, without a shuffle."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the files of shuffles that nothing refers to any more. It does so when the driver's garbage is collected, which may take half an hour."""
    spark.sparkContext._jvm.System.gc()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="dialoom-")
