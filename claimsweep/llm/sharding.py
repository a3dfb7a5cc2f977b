"""Contiguous shards of near equal bytes: global prefix sums of sizes, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .common import fresh, with_row_id


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = 8) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, a row for each row of ``docs``.

    Documents are put in the order of their ids (null ids first; rows with one id in the order of the
    stored files and of the rows in them, the same in every run). ``docs`` is a plain read of Parquet files. A
    document lies in the shard in which the bytes before it end, so a shard is a run of that order and
    misses the equal target by less than one document at each end; slot counts from 0 inside the shard.
    size is the text's UTF-8 bytes plus ``overhead``. A null text has no bytes and the CRC of an empty
    one; repeated rows stay; no rows give no rows; other columns are ignored.

    Only ids, sizes and checksums move. They are range-partitioned, so a repeated id is split by input
    position, and written once: the partition numbers then hold for every later read. Totals are one row
    for each partition.
    """
    text, row = F.coalesce(F.col(text_col), F.lit("")), fresh(docs, "place")
    own = with_row_id(docs, row).select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
                      F.crc32(text).alias("text_crc32"), F.col(row).alias("place"))
    dealt = own.repartitionByRange(F.col("doc_id"), F.col("place")).sortWithinPartitions("doc_id", "place")
    rows = stage(dealt.withColumn("part", F.spark_partition_id()), "shard-rows")

    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    total = rows.agg(F.sum("size")).first()[0] or 1
    inside = Window.partitionBy("part").orderBy("doc_id", "place")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition: bounded whatever the table's size
    placed = rows.select(
        "*", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("bytes_in_part"),
        (F.row_number().over(inside) - 1).alias("rows_in_part")).join(F.broadcast(starts), "part")
    start = (F.col("bytes_before") + F.col("bytes_in_part")).cast("decimal(30,0)")
    shard = F.call_function("div", start * n_shards, F.lit(total).cast("decimal(30,0)"))
    placed = placed.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"),
                           (F.col("rows_before") + F.col("rows_in_part")).alias("rank"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return placed.join(F.broadcast(first), "shard").select(  # n_shards rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first_rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
