"""Session set-up, and the folder where plans are cut."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "notespark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on.

    Cluster settings (shuffle partitions, memory, checkpoint folder) are left to the
    submitter; only result-relevant ones are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_spark(cores: int = 8, app: str = "notespark-local") -> SparkSession:
    """A local session for tests and the benchmark, with a checkpoint folder of its own."""
    return get_spark(
        app,
        master=f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": str(cores),
            "spark.sql.files.maxPartitionBytes": "4m",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="notespark-checkpoint-"),
            "spark.ui.enabled": "false",
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
        },
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named a session that is one process takes a temporary folder of its own; on a cluster
    that is an error, since no folder is known to be shared.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="notespark-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, for costly work on each of few bytes.

    A small file, or a shuffle of little data, is one task whatever its rows cost later on.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(tasks)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder as Parquet, for several reads of some of its columns."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy.

    Survives the loss of executors, and keeps plans of iterative operators short.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_copy(df: DataFrame) -> None:
    """Delete the copy that :func:`cut_lineage` wrote, once nothing reads ``df`` any more."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What is run and ended inside leaves no shuffle files; else they lie on the disk until the driver collects its garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def batches_of(spark: SparkSession, size: int) -> contextlib.AbstractContextManager[None]:
    """What runs inside sends Arrow batches of ``size`` bytes at most, or of one row, to Python."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))
