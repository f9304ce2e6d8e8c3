"""Session helpers: a local session for tests, the shared folder for intermediate tables, code for executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, pass its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mailsift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.openCostInBytes", "262144")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate data.

    Read from the session. Only in a local run without the setting is a temporary folder used; a
    cluster without it is an error, because its executors would each write to their own disk.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mailsift-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from the stored copy.

    A reliable checkpoint in the shared folder: it outlives any executor, and everything read from
    it afterwards starts from the stored rows.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from its files.

    For small results that a large table is joined to: Spark knows the size of the files when it plans
    the join, so it broadcasts them by its own threshold and shuffles beyond it.
    """
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; its functions run there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="mailsift-"), "mailsift_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "mailsift")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold ``BATCH_BYTES``, unless it sets a size of its own.

    A batch is held by the executor's JVM and by the worker at once, and texts are long.
    """
    if int(spark.conf.get(_BATCH_SETTING).rstrip("b")) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


_DROP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries made inside go when the query ends, not at some later garbage collection.

    For a job of many rounds that stores each round. Nothing made inside may be read a second time
    from its shuffle, or by ``toLocalIterator``, unless it was stored.
    """
    before = spark.conf.get(_DROP_SETTING)
    spark.conf.set(_DROP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SETTING, before)
