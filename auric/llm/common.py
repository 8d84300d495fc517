"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir, ship_package

# The white-space set of all contracts, as a regular expression
# class (bytes.split() without arguments splits on the same six characters).
SPACE_CLASS = r"[\x20\x09-\x0D]"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, readable by every executor."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new shared table and read it back.

    Cuts the lineage with replicated storage (a lost executor costs no
    recomputation) and gives later joins a plain scan, so that AQE can split
    skewed partitions on both sides."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    # The table replaces the job's shuffle files: have them removed when the write ends.
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(table: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    spark = table.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_of(col: str = "text") -> Column:
    """The text as string; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package available on the executors. A batch is
    bounded in rows and bytes by ``spark.sql.execution.arrow.max*PerBatch``."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def kind_of(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def to_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
