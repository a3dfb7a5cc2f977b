"""Token counts of byte-level BPE vocabularies, by merging with a heap and a linked list."""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import ship
from .vocab import Cache, parsed, vocabulary

# Fixed value: the pattern by which byte-level vocabularies cut text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words remembered in a worker.
CACHED = 800_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary: printable ones for themselves, then from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteCounter:
    """Counts tokens from the merges of a tokenizers file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        vocab, letters = model["vocab"], byte_letters()
        self.first = [vocab[c] for c in sorted(letters, key=letters.get)]
        self.merges = {}  # left id and right id in one number -> rank and merged id in one number
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = vocab[left] << 32 | vocab[right]
            self.merges.setdefault(key, rank << 32 | vocab[left + right])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(PATTERN)
        self.cache = Cache(self.word, CACHED)

    def word(self, word: str) -> int:
        """Tokens of one word: its bytes minus the merges made, lowest rank first, leftmost of a rank."""
        merges, first = self.merges.get, self.first
        symbols = [first[b] for b in word.encode("utf-8")]
        n = left = len(symbols)
        # queued[i]: the merge of the pair that starts at i, None where none is left
        queued = [merges(a << 32 | b) for a, b in zip(symbols, symbols[1:])]
        heap = [found >> 32 << 32 | i for i, found in enumerate(queued) if found is not None]
        if not heap:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n))
        queued.append(None)
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            found = queued[i]
            if found is None or found >> 32 != entry >> 32:
                continue  # the pair that was queued here has changed since
            j = after[i]
            symbols[i] = merged = found & 0xFFFFFFFF
            queued[j], queued[i] = None, None
            left -= 1
            k = after[i] = after[j]
            before[k] = i
            if k < n and (found := merges(merged << 32 | symbols[k])) is not None:
                queued[i] = found
                heappush(heap, found >> 32 << 32 | i)
            h = before[i]
            if h >= 0:
                queued[h] = found = merges(symbols[h] << 32 | merged)
                if found is not None:
                    heappush(heap, found >> 32 << 32 | h)
        return left

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1  # each special string in the text is one token
        count, find = self.cache.__getitem__, self.words.findall
        for part in parts:
            total += sum(map(count, find(part)))
        self.cache.trim()
        return total


def count_tokens(docs: DataFrame, path: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, a row for each row of ``docs``.

    Counts are those of the tokenizers library for the file, without begin, end or added tokens; special
    strings in a text count as one token each. Null texts count as empty (0 tokens); ids may be null or
    repeated; other columns are ignored; no rows give no rows. Whole texts are counted, of any length:
    a word of n bytes takes O(n log n) steps.
    """
    spark = docs.sparkSession
    ship(spark)
    data = vocabulary(spark, path)

    @F.pandas_udf(LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(parsed(ByteCounter, data.value).count, na_action=None)

    text = F.col(text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"),
                      tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
