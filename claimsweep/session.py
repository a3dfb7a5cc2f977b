"""Session settings the jobs are written for. A session made elsewhere works as well."""

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # outer joins keep their partitioning; a hot partition is still split when it is far off the median
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # methods beyond 8000 bytes are never compiled by the JVM; let Spark generate smaller ones instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Applies the settings to a session made elsewhere, as far as they can change at run time."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def build_session(name: str = "claimsweep", master: str | None = None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only a session on one machine may do without that setting; it gets one temporary folder. Elsewhere
    executors would write to disks of their own, so a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = _temporary.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="claimsweep-")
        _temporary[context.applicationId] = root
    return f"{root.rstrip('/')}/{purpose}-{os.urandom(6).hex()}"
