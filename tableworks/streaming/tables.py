"""File streams in and out, for one table of a folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .keyed import ROCKSDB

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A Parquet table of ``folder``, one file or a folder of files, as a stream of its files."""
    reader, path = spark.readStream.schema(schema), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(path.toString())
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)  # a stream cannot start from a single file


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)


def as_instant(col: str) -> Column:
    """Zone-free time stamp as an instant, read as UTC whatever the session zone is."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', `{col}`))")


@contextmanager
def state_store(spark: SparkSession):
    """The store that keyed state needs, for the queries started inside; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_available(sdf: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Run an append stream over all waiting input into a Parquet sink; its rows, and the checkpoint that holds its state."""
    spark = sdf.sparkSession
    path = scratch_path(spark, name)
    writer = sdf.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").outputMode("append")
    with state_store(spark):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(f"{path}/data"), f"{path}/state"


def write_available(sdf: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all waiting input into a Parquet sink and read the result."""
    return run_available(sdf, name)[0]
