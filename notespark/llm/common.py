"""What the operators on training documents share: reading, staging, and batches of rows.

Every operator takes a DataFrame of documents and gives each input row back whole, as a struct
column ``row``, beside its own result columns, so that extra input columns never clash with them.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def as_rows(docs: DataFrame) -> DataFrame:
    """The documents with each row in one struct column ``row``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of the cluster."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    A later stage that loses an executor reads the files again and computes nothing twice.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    reader = spark.read if partition_by else spark.read.schema(df.schema)
    return reader.parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside sends Arrow batches of ``BATCH_BYTES`` at most, or of one row, to Python.

    A batch lies in memory several times: as it is built and grown, in the worker, and as what is made of it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more, so that its disk is free again."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(conf).delete(target, True)


def task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` that always gets its batches."""
    return df.mapInArrow(work, schema)


def batch_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
