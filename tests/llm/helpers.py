"""Small awkward tables for the tests of the pipeline operators."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns whose names the operators use themselves
    T.StructField("row", T.StringType()), T.StructField("score", T.StringType()), T.StructField("fp", T.StringType()),
    T.StructField("copies", T.StringType()), T.StructField("size", T.StringType()), T.StructField("Words", T.StringType())])


def stored(spark, rows, path):
    """A stored table of (doc_id, text[, source]) rows with extra columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]), "x", "y", "z", "c", "s", "w") for r in rows]
    spark.createDataFrame(full, SCHEMA).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def awkward(seed=0):
    """Nulls everywhere, empty and very long texts, ties and repeated rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60))), r.choice(["a", "b", None])) for i in range(40)]
    rows += [(None, None, None), (None, None, None), (100, None, "a"), (101, "", "b"), (102, " \n\t\n ", "b"), (None, "one two", None),
             (103, "x", "c"), (104, " ".join(r.choice(words) for _ in range(20000)), "a"), (105, "y" * 5000, "a"),
             (106, "Ünïcode ßtraße 日本 \x00 ½", "b"), (7, "other text of the same id", "b")]
    rows += [rows[3], rows[3], rows[5]]
    return rows
