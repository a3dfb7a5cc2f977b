"""Vocabulary files: read once on the driver, sent to the workers as bytes, parsed once in each of them."""

from __future__ import annotations

import hashlib
import os

from pyspark import Broadcast
from pyspark.sql import SparkSession

_held: dict = {}


def held(key, make):
    """``make()``, kept in this worker process until another key is asked for: one model and its caches at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """``path`` is a file, or the name of one of the installed public tokenizers. A few MB at most."""
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def parsed(kind: type, data: bytes):
    """One object of ``kind`` for a vocabulary; its caches serve all tasks of a worker process."""
    return held((kind.__name__, hashlib.md5(data).digest()), lambda: kind(data))


class Cache(dict):
    """Remembers ``make(key)`` for short keys; emptied between texts when it has grown to its limit."""

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def trim(self):
        if len(self) > self.limit:
            self.clear()
