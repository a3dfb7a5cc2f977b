"""Exact top-k by inner product with vector-approximation files.

Each component is kept as the number of a cell between its smallest and largest value over all vectors; a file of
these cells is all that the scan moves and reads. From cells alone a query bounds every candidate's score. Candidates
whose upper bound is below the k-th best lower bound over the whole table are out. The exact vectors of the others are
then fetched in the order of their upper bounds: the first ones of each query, and of the rest those whose bound still
reaches the k-th best exact score of these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .common import ship

#: Cells of a component, 256 at most: with 32 about one vector in 60 is left after the scan of unstructured vectors, with 16
#: one in four.
CELLS = 32
#: Rows of a block of candidates (as cells) and of queries, and candidates that a task unpacks at a time.
CANDIDATES, QUERIES, SLICE = 1 << 16, 1024, 8192
#: Exact vectors that are read first, times k.
READ = 2
#: Shares into which copies of one vector are dealt.
SHARES = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1

RESULT = "query_id long, rank int, vec_id long, score long"


def integers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null where the vector, or a component, is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)),
                  F.transform(vector, lambda x: F.floor(F.greatest(F.least(scale * x.cast("double"), F.lit(9.2e18)), F.lit(-9.2e18)))))


class Cells:
    """Marks of the cells of each component, and the cells of vectors, a byte each."""

    def __init__(self, low: list[int], high: list[int], cells: int):
        self.cells, self.size = cells, len(low)
        self.low, self.high = np.array(low, np.float64), np.array(high, np.float64)
        self.width = (self.high - self.low + 1) / cells
        # how far a bound computed in double precision may be off, for each unit of a query's largest component
        reach = np.maximum(np.abs(self.low), np.abs(self.high)).sum() if low else 0.0
        self.exact = reach * max(map(abs, [0, *low, *high])) < 2.0 ** 52
        self.slack = 0.0 if self.exact else reach * 2.0 ** -44

    def pack(self, vectors: np.ndarray) -> list[bytes]:
        code = np.clip((vectors - self.low) // self.width, 0, self.cells - 1).astype(np.uint8)
        return [row.tobytes() for row in code]

    def unpack(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(middle, half) of the values that the vectors' components lie between."""
        code = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), self.size).astype(np.float64)
        low, high = self.low + code * self.width, self.low + (code + 1) * self.width
        if self.exact:  # a cell holds the whole numbers from its lower to below its upper mark
            low, high = np.ceil(low), np.ceil(high) - 1
        return (low + high) / 2, (high - low) / 2

    def bounds(self, queries: np.ndarray, middle: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the products of each query with each vector."""
        about, off = queries @ middle.T, np.abs(queries) @ half.T
        off += self.slack * np.abs(queries).max(axis=1, initial=0.0)[:, None]
        return np.clip(about - off, LEAST, MOST), np.clip(about + off, LEAST, MOST)


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value; less than all if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def products(left: pd.Series, right: pd.Series) -> pd.Series:
    """Exact inner products; those beyond a long are its ends."""
    a, b = np.stack([np.zeros(0, np.int64), *left][1:]), np.stack([np.zeros(0, np.int64), *right][1:])
    top = max(1, a.shape[1]) * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if top < 2.0 ** 62:
        return pd.Series(np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64)))
    return pd.Series([min(max(sum(x * y for x, y in zip(u, v)), LEAST), MOST) for u, v in zip(a.tolist(), b.tolist())], dtype="int64")


def top_k(vectors: DataFrame, k: int = 20, is_query: Column | None = None, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 64, cells: int = CELLS, candidates: int = CANDIDATES,
          queries: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest inner products over all other rows.

    Scores are exact inner products of floor(scale * x); ties go to the smaller id; fewer than k candidates give
    fewer rows. Vectors that are null or hold null or non-finite components take no part, nor do rows without an id,
    nor vectors of another length than most (of equally frequent lengths the longest). Every row that asks is a query of
    its own, and only that row is no candidate of it: rows of a repeated id ask and are found one by one. Components beyond a
    long are taken as its ends, scores too. No rows give no rows; other columns are ignored.

    Queries (default: ids divisible by 20) and candidates are dealt into blocks of bounded size, and each
    pair of blocks is one task's group: what a task holds does not grow with the table.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"),
                         (F.col(id_col) % 20 == 0 if is_query is None else is_query).alias("asks"))
    own = own.where("v is not null and id is not null").withColumn("asks", F.coalesce("asks", F.lit(False)))
    # one number for each row, given once in a table that is written once
    own = stage(own.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    length = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], RESULT)
    own = own.where(F.size("v") == length["d"])
    # marks of the cells: smallest and largest value of each component, two numbers each
    ends = own.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    ends = {r["d"]: (r["a"], r["b"]) for r in ends.collect()}
    marks = Cells([ends[d][0] for d in range(len(ends))], [ends[d][1] for d in range(len(ends))], cells)

    # of copies of one vector only those with the smallest ids can be found, and one more for a query among them
    share = F.pmod(F.xxhash64("row"), F.lit(SHARES))
    few = own.withColumn("n", F.row_number().over(Window.partitionBy("v", share).orderBy("id", "row"))).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id", "row"))).where(F.col("n") <= k + 1)

    def packed(batches):
        for batch in batches:
            if len(batch):
                v = np.stack([np.asarray(x, np.int64) for x in batch["v"]])
                yield pd.DataFrame({"row": batch["row"], "id": batch["id"], "cells": marks.pack(v)})

    file = stage(few.select("row", "id", "v").mapInPandas(packed, "row long, id long, cells binary"), "topk-cells")
    asking = own.where("asks").select("row", "v")
    n, n_asking = file.count(), asking.count()
    n_c, n_q = max(1, -(-n // candidates)), max(1, -(-n_asking // queries))

    def dealt(name: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(name)), F.lit(blocks)).cast("int").alias(name)

    def every(name: str, blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)

    def bounded(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """For each query: the candidates of the block that could be among its first k, with their bounds."""
        out = {"query": [], "rows": [], "ids": [], "lows": [], "highs": []}
        if len(left) and len(right):
            asked = np.stack([np.asarray(x, np.float64) for x in left["v"]])
            mine, rows, ids = left["row"].to_numpy(), right["row"].to_numpy(), right["id"].to_numpy()
            held: list[list[tuple]] = [[] for _ in mine]
            for at in range(0, len(rows), SLICE):
                middle, half = marks.unpack(right["cells"].iloc[at:at + SLICE].tolist())
                some, names = rows[at:at + SLICE], ids[at:at + SLICE]
                for first in range(0, len(mine), 128):  # a few MB of bounds at a time
                    low, high = marks.bounds(asked[first:first + 128], middle, half)
                    for i in range(len(low)):
                        other = some != mine[first + i]
                        lows = np.where(other, low[i], -np.inf)
                        sure = _kth(np.concatenate([lows, *[h[2] for h in held[first + i]]]), k)
                        keep = other & (high[i] >= sure)
                        held[first + i].append((some[keep], names[keep], low[i][keep], high[i][keep]))
            for q, parts in zip(mine.tolist(), held):
                columns = [np.concatenate(x) for x in zip(*parts)]
                keep = columns[3] >= _kth(columns[2], k)
                out["query"].append(q)
                for name, x in zip(("rows", "ids", "lows", "highs"), columns):
                    out[name].append(x[keep].tobytes())
        return pd.DataFrame(out)

    met = asking.select("row", "v", dealt("q", n_q), every("c", n_c)).groupBy("q", "c").cogroup(
        file.select("row", "id", "cells", dealt("c", n_c), every("q", n_q)).groupBy("q", "c")).applyInPandas(
        bounded, "query long, rows binary, ids binary, lows binary, highs binary")

    def left_over(group: pd.DataFrame) -> pd.DataFrame:
        """A query's candidates after the threshold over all blocks, in the order in which they are read."""
        rows, ids = (np.concatenate([np.frombuffer(x, np.int64) for x in group[c]]) for c in ("rows", "ids"))
        lows, highs = (np.concatenate([np.frombuffer(x, np.float64) for x in group[c]]) for c in ("lows", "highs"))
        keep = np.nonzero(highs >= _kth(lows, k))[0]
        keep = keep[np.lexsort((ids[keep], -highs[keep]))]
        return pd.DataFrame({"query": group["query"].iloc[0], "row": rows[keep], "high": highs[keep], "place": np.arange(len(keep))})

    able = stage(met.groupBy("query").applyInPandas(left_over, "query long, row long, high double, place long"), "topk-able")
    asked = own.where("asks").select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("q"))
    product = F.pandas_udf(products, "long")

    def read(some: DataFrame) -> DataFrame:
        """Exact scores: only here are vectors of candidates fetched."""
        pairs = some.join(own.select("row", F.col("id").alias("vec_id"), "v"), "row").join(asked, "query")
        return pairs.select("query", "query_id", "vec_id", "row", product("q", "v").alias("score"))

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    first = stage(read(able.where(F.col("place") < READ * k).select("query", "row")), "topk-first")
    certain = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query", F.col("score").alias("certain"))
    rest = able.where(F.col("place") >= READ * k).join(certain, "query").where(F.col("high") >= F.col("certain"))
    found = first.union(read(rest.select("query", "row")))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
