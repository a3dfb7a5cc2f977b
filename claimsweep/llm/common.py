"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
WHITE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet (Spark compares names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds the row's place in the stored files: a hash of the file's path, and the row's number in that file.

    ``df`` has to be a plain read of Parquet files. The place is a fact of the file, not of the read, so it
    stays the same however a read packs files into tasks, and when executors join or are lost between two reads.
    """
    return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"),
                                   F.col("_metadata.row_index").alias("at")).alias(name))


def words_of(text: Column) -> Column:
    """Words of a text separated by ASCII white space; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of single bytes take the quicker lower(), which does the same there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once for each row: the only element of an array has a name."""
    return F.element_at(F.transform(F.array(value), use), 1)


def window_hashes(words: Column, k: int) -> Column:
    """64-bit hashes of all runs of k words, in order; an empty array for shorter texts.

    Hashes of runs are doubled in length, from pairs of their halves; a last step joins two overlapping
    runs where k is no power of two.
    """
    def joined(hashes: Column, by: int) -> Column:
        return bound(hashes, lambda a: F.transform(
            F.slice(a, 1, F.greatest(F.size(a) - by, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(a, i + by))))

    out, have = F.transform(words, lambda w: F.xxhash64(w)), 1
    while have < k:
        step = min(have, k - have)
        out, have = joined(out, step), have + step
    return out


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so that they can import its functions."""
    context = spark.sparkContext
    if getattr(context, "_claimsweep_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "claimsweep.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(top):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)  # Spark copies it to each executor; the temporary file is only its source
    context._claimsweep_shipped = True
