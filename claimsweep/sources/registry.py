"""The invoice registry as a stored table, laid out so that a batch touches only what it brings.

Rows are partitioned by a hash of the invoice number (a shard) and inside it bucketed and sorted by the number. An upsert
reads and rewrites the shards of its own numbers; lookups and merges by number find the registry's rows where they are,
without a shuffle of its side.
"""

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.duplicates import registry_latest
from ..staging import stage

#: Shards of a registry, and buckets of each: a lookup runs in as many tasks as there are buckets.
SHARDS, BUCKETS = 16, 8
COLUMNS = ("claim_id", "invoice_number", "invoice_date", "invoice_amount", "created_at")


def _shard(number: str) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(SHARDS)).cast("int")


@contextmanager
def _settings(spark: SparkSession, **values):
    """Session settings that hold for what runs inside."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Buckets by the number serve keys that hold the number and more.
BY_NUMBER = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
#: An insert replaces the shards that it brings and no others.
BY_SHARD = {"spark.sql.sources.partitionOverwriteMode": "dynamic"}


def create_registry(spark: SparkSession, table: str, path: str, buckets: int = BUCKETS) -> None:
    """An empty registry in a folder that all workers reach."""
    spark.sql(f"""create table {table} (claim_id string, invoice_number string, invoice_date string, invoice_amount string,
        created_at timestamp_ntz, shard int) using parquet partitioned by (shard)
        clustered by (invoice_number) sorted by (invoice_number) into {buckets} buckets location '{path}'""")


def _touched(spark: SparkSession, table: str, numbers: DataFrame) -> DataFrame:
    shards = [r[0] for r in numbers.select(_shard("invoice_number")).distinct().collect()]  # at most SHARDS numbers
    return spark.table(table).where(F.col("shard").isin(shards))


def known_numbers(spark: SparkSession, table: str, numbers: DataFrame) -> DataFrame:
    """The registrations of ``numbers(invoice_number)``."""
    asked = numbers.select("invoice_number").distinct()
    return _touched(spark, table, asked).join(asked, "invoice_number", "left_semi").select(*COLUMNS)


def merged(spark: SparkSession, table: str, rows: DataFrame) -> DataFrame:
    """The touched shards after an upsert of ``rows``: of each (claim, number) the latest registration."""
    new = registry_latest(rows)
    record = lambda side: F.when(F.col(f"{side}.claim_id").isNotNull(), F.struct(
        *[F.col(f"{side}.{c}").alias(c) for c in ("created_at", "invoice_date", "invoice_amount")]))
    known = _touched(spark, table, new).alias("k")
    both = known.join(new.alias("n"), (F.col("k.invoice_number") == F.col("n.invoice_number")) & (
        F.col("k.claim_id") == F.col("n.claim_id")), "full")
    either = lambda c: F.coalesce(f"k.{c}", f"n.{c}").alias(c)
    # greatest() passes over nulls: a side that is not there
    rows = both.select(either("claim_id"), either("invoice_number"), F.greatest(record("k"), record("n")).alias("r"))
    return rows.select("claim_id", "invoice_number", "r.invoice_date", "r.invoice_amount", "r.created_at", _shard("invoice_number").alias("shard"))


def upsert(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """Writes ``rows`` (as :func:`registry_rows` gives them) into the registry; a repeated upsert changes nothing."""
    with _settings(spark, **BY_NUMBER):
        after = stage(merged(spark, table, stage(rows.select(*COLUMNS), "registry-new")), "registry-merged")
    with _settings(spark, **BY_SHARD):
        after.select(*COLUMNS, "shard").repartition("shard").write.mode("overwrite").insertInto(table)
    spark.catalog.refreshTable(table)
