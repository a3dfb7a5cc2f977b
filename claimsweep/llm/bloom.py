"""A Bloom filter of one fixed size over a column of 64-bit hashes, built in parallel.

It is sent to all workers, so its size never grows with the data: with more keys it lets more strangers
pass. It may only leave out work whose result would be dropped anyway, never decide a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import ship

#: Bits of the filter (8 MB), probes of a key, bytes of a slice that is put together on its own.
BITS, PROBES, SLICE = 1 << 26, 4, 1 << 16


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Well mixed 64-bit numbers from 64-bit numbers, one to one for each seed."""
    x = np.asarray(x, np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ALL = (1 << 64) - 1


def _mixed_one(x: int, seed: int) -> int:
    x = x + (seed + 1) * 0x9E3779B97F4A7C15 & _ALL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


def _places(keys: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (mixed(keys, 7 + probe) & np.uint64(bits - 1)).astype(np.int64)


class Bloom:
    def __init__(self, data: bytes):
        self.raw, self.data = data, np.frombuffer(data, np.uint8)

    def __contains__(self, key: int) -> bool:
        last = 8 * len(self.raw) - 1
        for probe in range(PROBES):
            at = _mixed_one(key, 7 + probe) & last
            if not self.raw[at >> 3] >> (at & 7) & 1:
                return False
        return True

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for probe in range(PROBES):
            at = _places(keys, probe, 8 * len(self.data))
            found &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def bloom(keys: DataFrame, bits: int = BITS) -> Broadcast:
    """The filter of the only column of ``keys`` (long, no nulls), as bytes for :class:`Bloom` on the workers."""
    spark = keys.sparkSession
    ship(spark)

    def marks(batches):
        """The filter of a task's keys: the slices of it that are not empty."""
        packed = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for probe in range(PROBES):
                at = _places(values, probe, bits)
                np.bitwise_or.at(packed, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for at in range(0, len(packed), SLICE):
            part = packed[at:at + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part.tobytes()])], ["at", "part"])

    def either(group: pd.DataFrame) -> pd.DataFrame:
        part = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["part"]])
        return pd.DataFrame({"at": group["at"].iloc[:1], "part": [part.tobytes()]})

    kind = "at long, part binary"
    data = np.zeros(bits // 8, np.uint8)
    for row in keys.mapInArrow(marks, kind).groupBy("at").applyInPandas(either, kind).collect():  # 8 MB at most
        data[row["at"]:row["at"] + len(row["part"])] = np.frombuffer(row["part"], np.uint8)
    return spark.sparkContext.broadcast(data.tobytes())
