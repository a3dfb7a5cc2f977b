"""Alignment of two tokenizers over a corpus: a byte-level BPE vocabulary (A) and a SentencePiece BPE model (B).

Both cut the same bytes, so places where tokens of both end split a text into groups. The distinct pairs of
ids that end together get numbers of their own from a minimal perfect hash; tasks count into dense vectors
indexed by it, the vectors are summed over a tree, and a second pass aligns the documents again and looks
their pairs up. Two tokens that end at one byte are suffixes of each other, so however large the corpus is,
there are never more pairs than the vocabularies' tokens have suffixes: vectors and hash have a fixed bound.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import ship
from .tokens import PATTERN, byte_letters
from .vocab import held, vocabulary

MARK = "▁"
#: Units remembered in a worker, the characters that these may hold, and the characters encoded at a time.
CACHED, CACHED_CHARS, CHUNK = 300_000, 8_000_000, 1 << 16
#: Characters of a unit that is encoded on its own.
LONG = 1000
#: Documents whose groups a worker holds at once.
ROWS = 200
#: Counters of a slice of the dense vectors, and the branches of their summation.
SLICE, BRANCHES = 1 << 15, 16

ALIGNED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                     ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])
ALIGNED_SQL = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
               "groups string")


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalHash:
    """A minimal perfect hash of distinct 64-bit keys: 0 .. n-1, each once; -1 for every other key.

    Keys are thrown at a bit table; those alone in their place keep it, the others go on to a smaller table with
    another seed. A key's number is the rank of its bit over all tables. The keys are kept by number: a lookup
    is right only if it finds the key it asked for.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        left = keys = np.ascontiguousarray(keys, np.uint64)
        self.sizes, bits = [], []
        while len(left):
            size = max(64, int(gamma * len(left)) + 7 & ~7)
            place = (_mixed(left, len(self.sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            self.sizes.append(size)
            bits.append(alone)
            left = left[~alone[place]]
        flat = np.concatenate(bits) if bits else np.zeros(8, bool)
        self.bits = np.packbits(flat, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits))]).astype(np.int32)
        self.keys = keys
        number = self._number(keys)
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[number] = keys

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            place = (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64) + start
            byte, bit = self.bits[place >> 3], (place & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            out[open_[hit]] = (self.before[place >> 3] + below)[hit]
            open_ = open_[~hit]
            start += size
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(keys, np.uint64)
        number = self._number(keys)
        if len(self.keys):
            number[self.keys[number] != keys] = -1
        return number


class Encoders:
    """Both tokenizers over units, stretches of a text that no token of either crosses.

    A unit starts with a blank or a line end after something that is no white space. A's words never hold
    white space after other characters; B's pieces hold the blank mark at their start only and no line end
    (checked here). So both libraries give a text the tokens of its units, one unit after the other.
    """

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(a)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = [b""] * (1 + max(spec["model"]["vocab"].values()))
        for token, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        # A quicker library for the same merges. It joins neighbours by the rank of what they make, not by a list of
        # pairs. That is the same if each token, taken alone, is made by its merges, and merges are listed by id:
        # a token's place starts and ends clean until it is made, and inside it all goes as when it stands alone.
        made = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        same = made == sorted(set(made)) and all(len(self.a.model.tokenize(t)) == 1 for t in spec["model"]["vocab"])
        ranks = {x: i for i, x in enumerate(self.a_bytes) if x}
        self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if same else None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a model whose pieces hold the blank mark only at their start is needed")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else
                        b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        ends = " " if any("\n" in p for p in pieces) else " \n"
        self.units = re.compile(rf"[{ends}]\s*(?:\S+(?:[^\S{ends}]\s*\S*)*)?").findall
        self.blank = self.b.piece_to_id(MARK)
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)

    def most_pairs(self) -> int:
        """Pairs of tokens of which one ends with the other: more can never be linked."""
        ends_a, ends_b = Counter(self.a_bytes), Counter(self.b_bytes)
        return (sum(ends_b[t[i:]] for t in self.a_bytes for i in range(len(t)))
                + sum(ends_a[t[i:]] for t in self.b_bytes for i in range(1, len(t))))

    def encode(self, text: str, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text that starts with a blank or a line end; ``short``: of no long stretch without these."""
        if short and self.quick:
            first = self.quick.encode_ordinary(text)
        else:
            first = self.a.encode(text, add_special_tokens=False).ids
        if text == " ":
            return np.array(first, np.int64), np.array([self.blank], np.int64)
        second = self.b.encode(text[1:] if text[0] == " " else text)  # the library puts a blank first
        return np.array(first, np.int64), np.array(second if text[0] == " " else second[1:], np.int64)

    def spelled(self, ids_a: np.ndarray, ids_b: np.ndarray, data: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, ids_a)) == data == b"".join(map(self.b_bytes.__getitem__, ids_b))


class Units:
    """Units seen by a worker: their numbers, and what alignment says of each, by number."""

    def __init__(self, encoders: Encoders, look=None):
        self.encoders, self.look = encoders, look
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.good, self.n_a, self.n_b, self.n_links = array("b"), array("q"), array("q"), array("q")
        self.n_best, self.count_sum, self.links, self.chars = array("q"), array("q"), array("q"), 0
        self.written: list[str] = []

    def trim(self):
        """Between batches of documents: forgets all units if these are too many."""
        if len(self.index) > CACHED or self.chars > CACHED_CHARS:
            self.clear()

    def numbers(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The units' numbers of each document; new units are encoded together."""
        index = self.index
        new = [u for u in dict.fromkeys(chain.from_iterable(docs)) if u not in index]
        part, size = [], 0
        for unit in new:
            # on their own: the end of a text, what B does not tell from a blank, and long stretches
            if unit[-1].isspace() or MARK in unit or len(unit) > LONG:
                self._add([unit])
                continue
            part.append(unit)
            size += len(unit)
            if size >= CHUNK:
                self._add(part)
                part, size = [], 0
        if part:
            self._add(part)
        return [np.fromiter(map(index.__getitem__, doc), np.int64, len(doc)) for doc in docs]

    def _add(self, units: list[str]):
        e = self.encoders
        data = [u.encode() for u in units]
        ends = np.cumsum([len(x) for x in data])
        whole = b"".join(data)
        ids_a, ids_b = e.encode("".join(units), len(units) > 1)
        at_a, at_b = np.cumsum(e.a_len[ids_a]), np.cumsum(e.b_len[ids_b])
        if not e.spelled(ids_a, ids_b, whole):
            if len(units) > 1:  # find those that are not spelled as they are written
                half = len(units) // 2
                self._add(units[:half])
                self._add(units[half:])
                return
            self._keep(units, np.zeros(1, bool), *np.zeros((5, 1), np.int64), np.zeros(0, np.int64), [""])
            return
        both, in_a, in_b = np.intersect1d(at_a, at_b, assume_unique=True, return_indices=True)
        links = ids_a[in_a] * len(e.b_len) + ids_b[in_b]
        last = np.searchsorted(both, ends, "right")  # groups up to the end of each unit
        until_a, until_b = np.searchsorted(at_a, ends, "right"), np.searchsorted(at_b, ends, "right")
        n_links = np.diff(last, prepend=0)
        n_best = count_sum = np.zeros(len(units), np.int64)
        written = [""] * len(units)
        if self.look is not None:
            counts, best = self.look(links)
            starts = last - n_links
            n_best, count_sum = np.add.reduceat(best.astype(np.int64), starts), np.add.reduceat(counts, starts)
            a, b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
            groups, i, j = [], 0, 0
            for x, y in zip((in_a + 1).tolist(), (in_b + 1).tolist()):
                groups.append(f"{','.join(a[i:x])}|{','.join(b[j:y])}")
                i, j = x, y
            written = [";".join(groups[x:y]) for x, y in zip(starts.tolist(), last.tolist())]
        self._keep(units, np.ones(len(units), bool), np.diff(until_a, prepend=0), np.diff(until_b, prepend=0), n_links,
                   n_best, count_sum, links, written)

    def _keep(self, units, good, n_a, n_b, n_links, n_best, count_sum, links, written):
        first = len(self.index)
        self.index.update(zip(units, range(first, first + len(units))))
        self.chars += sum(map(len, units))
        self.good.frombytes(good.astype(np.int8).tobytes())
        for kept, more in ((self.n_a, n_a), (self.n_b, n_b), (self.n_links, n_links), (self.n_best, n_best),
                           (self.count_sum, count_sum), (self.links, links)):
            kept.frombytes(np.ascontiguousarray(more, np.int64).tobytes())
        self.written += written

    def spelled(self, numbers: np.ndarray) -> bool:
        return bool(np.frombuffer(self.good, np.int8)[numbers].all())


def _encoders(a: Broadcast, b: Broadcast) -> Encoders:
    key = ("alignment", hashlib.md5(a.value).digest(), hashlib.md5(b.value).digest())
    return held(key, lambda: Encoders(a.value, b.value))


def _documents(encoders: Encoders, batch: pa.RecordBatch) -> Iterator[tuple[list, list[list[str]]]]:
    """(ids, units of each text) of some documents at a time; null and empty texts have none."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part.column(0).to_pylist(), [encoders.units(" " + t) if t else [] for t in part.column(1).to_pylist()]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return found, total


class PairCounts:
    """Counts of the linked pairs of a corpus, by minimal perfect hash; ``best``: the highest of its B id."""

    def __init__(self, numbers: MinimalHash, counts: np.ndarray, n_b: int):
        self.numbers, self.counts = numbers, counts
        second = (numbers.keys % np.uint64(n_b)).astype(np.int64)
        highest = np.zeros(n_b, np.int64)
        np.maximum.at(highest, second, counts)
        self.best = counts == highest[second]

    def __call__(self, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.numbers(links)
        if len(at) and at.min() < 0:
            raise KeyError("a pair that the first pass has not met: the table has changed since")
        return self.counts[at], self.best[at]


def count_pairs(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> PairCounts:
    """The first pass: how many links of the corpus hold each pair of ids."""
    spark = docs.sparkSession
    ship(spark)
    a, b = vocabulary(spark, first), vocabulary(spark, second)

    def local(batches):
        """A task's distinct pairs with their counts, in one row."""
        units = Units(_encoders(a, b))
        keys, counts, waiting = [], [], 0
        for batch in batches:
            for _, texts in _documents(units.encoders, batch):
                numbers = [n for n in units.numbers(texts) if len(n) and units.spelled(n)]
                if numbers:
                    n_links = np.frombuffer(units.n_links, np.int64)
                    times = np.bincount(np.concatenate(numbers), minlength=len(n_links))
                    met = np.repeat(times, n_links)
                    keys.append(np.frombuffer(units.links, np.int64)[met > 0])
                    counts.append(met[met > 0])
                    waiting += len(keys[-1])
                    del n_links
                units.trim()
                if waiting > 1 << 21:
                    found, total = _summed(keys, counts)
                    keys, counts, waiting = [found], [total], 0
        if keys:
            found, total = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())],
                                             ["pairs", "counts"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    partial = stage(own.mapInArrow(local, "pairs binary, counts binary"), "alignment-pairs")

    def distinct(batches):
        found = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                found = np.union1d(found, np.frombuffer(x.as_py(), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(found)], ["pair"])

    encoders = Encoders(a.value, b.value)
    pairs = partial.select("pairs").mapInArrow(distinct, "pair long").distinct()
    keys = np.sort(pairs.toPandas()["pair"].to_numpy(np.int64))
    if len(keys) > encoders.most_pairs():
        raise AssertionError("more pairs than the vocabularies can link")
    numbers = MinimalHash(keys)
    sent = spark.sparkContext.broadcast(numbers)

    def dense(batches):
        """A task's dense vector, in slices; the branch is the first step of the summation tree."""
        from pyspark import TaskContext

        total = np.zeros(len(sent.value.keys), np.int64)
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                total[sent.value(np.frombuffer(x.as_py(), np.int64))] += np.frombuffer(y.as_py(), np.int64)
        branch = TaskContext.get().partitionId() % BRANCHES
        for at in range(0, len(total), SLICE):
            yield pa.RecordBatch.from_arrays([
                pa.array([at], pa.int64()), pa.array([branch], pa.int32()), pa.array([total[at:at + SLICE].tobytes()])],
                ["at", "branch", "vector"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in group["vector"])
        return pd.DataFrame({"at": group["at"].iloc[:1], "branch": group["branch"].iloc[:1], "vector": [total.tobytes()]})

    kind = "at long, branch int, vector binary"
    branches = partial.mapInArrow(dense, kind).groupBy("at", "branch").applyInPandas(added, kind)
    slices = branches.withColumn("branch", F.lit(0)).groupBy("at").applyInPandas(added, kind).toPandas().sort_values("at")
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in slices["vector"]]) if len(slices) else np.zeros(0, np.int64)
    return PairCounts(numbers, counts, len(encoders.b_len))


def pair_table(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model",
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a_id, b_id, n long, best boolean)``: each linked pair of ids with its count over the corpus."""
    found = count_pairs(docs, first, second, id_col, text_col)
    n_b = np.uint64(len(Encoders(*(vocabulary(docs.sparkSession, p).value for p in (first, second))).b_len))
    rows = pd.DataFrame({"a_id": (found.numbers.keys // n_b).astype(np.int64), "b_id": (found.numbers.keys % n_b).astype(np.int64),
                         "n": found.counts, "best": found.best})
    return docs.sparkSession.createDataFrame(rows, "a_id long, b_id long, n long, best boolean")


def align(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model",
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``, a row for each row of ``docs``.

    Tokens are those of the tokenizers library for a blank and the text (A) and of the sentencepiece library
    for the text (B), without special tokens; their strings in a text are plain. ``groups`` lists the ids between
    places where tokens of both end: ``a1,a2|b1;a3|b2,b3``. A link is a pair of tokens that end together; n_best
    counts the links whose pair is the most frequent one of its B id over the corpus (ties included), count_sum
    adds the corpus counts of all links.

    Texts that are null or empty, or that a vocabulary does not spell as they are written (such as those that
    hold the blank mark itself), have zeros and no groups. Ids may be null or repeated, a row each, and each row
    counts in the corpus; other columns are ignored; no rows give no rows. Texts of any length are aligned whole;
    stretches without a blank or a line end are encoded by the libraries at once.
    """
    spark = docs.sparkSession
    found = spark.sparkContext.broadcast(count_pairs(docs, first, second, id_col, text_col))
    a, b = vocabulary(spark, first), vocabulary(spark, second)

    def whole(batches):
        units = Units(_encoders(a, b), found.value)
        for batch in batches:
            for ids, texts in _documents(units.encoders, batch):
                numbers = [n if units.spelled(n) else n[:0] for n in units.numbers(texts)]
                sums = [[int(np.frombuffer(column, np.int64)[n].sum()) for n in numbers]
                        for column in (units.n_a, units.n_b, units.n_links, units.n_best, units.count_sum)]
                groups = [";".join(map(units.written.__getitem__, n.tolist())) for n in numbers]
                columns = [ids, sums[0], sums[1], sums[2], sums[2], sums[3], sums[4], groups]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, ALIGNED)], schema=ALIGNED)
                units.trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        whole, ALIGNED_SQL)
