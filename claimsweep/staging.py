"""Stage tables: intermediate results written once to shared storage and read by several consumers."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import shared_dir

_written: dict[str, list[str]] = {}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the cluster's shared folder and reads it back.

    The copy outlives lost executors, is read column by column, and has known sizes for join planning.
    It stays until :func:`release`.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_result(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stages what ``make()`` returns, then removes the tables staged on the way to it: nothing else may read them."""
    written = _written.setdefault(spark.sparkContext.applicationId, [])
    first = len(written)
    out = stage(make(), name)
    passed = written[first:-1]
    del written[first:-1]
    _remove(spark, passed)
    return out


def _remove(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Removes every table that :func:`stage` wrote for this session; results made from them must be written before."""
    _remove(spark, _written.pop(spark.sparkContext.applicationId, []))
