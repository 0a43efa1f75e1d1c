"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset, as in tests, a folder in the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{found or spark.conf.get('spark.sql.warehouse.dir')}/ledgerloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_records: list[list[str]] = []


@contextmanager
def recording() -> Iterator[list[str]]:
    """Lists the paths of all tables that written() makes meanwhile."""
    made: list[str] = []
    _records.append(made)
    try:
        yield made
    finally:
        _records.remove(made)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once, written as Parquet and read again: this cuts lineage, and what reads the
    result survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    for made in _records:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete these tables. What still reads them fails afterwards. Spark removes the shuffle files and broadcasts of plans
    that nothing refers to any more."""
    for path in paths:
        _delete(spark, path)
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has written. Results that still read them fail afterwards."""
    _delete(spark, shared_folder(spark))
