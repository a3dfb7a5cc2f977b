"""Phrase collocations: words that follow each other far more often together than apart, by HAT-trie counting.

A task counts the runs of words of its texts in a HAT-trie: hash containers below a shallow trie of word ids.
A container that grows too large bursts into a trie node with a container for each next word. When the trie holds
too many entries, its largest subtrees are written out whole, as sorted runs, and the shuffle brings the runs of
one prefix partition together, where they are merged.

Counting goes by levels: words, then pairs, then runs of three and four. A frequent phrase has only frequent
parts, so a run with a rare word or pair is never entered; which these are, a Bloom filter of fixed size says. It
lets some rare ones pass, and those fall out when the merged counts are known: results are exact.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .bloom import Bloom, bloom, mixed
from .common import ship

#: What ends a piece of text, and a byte that no UTF-8 text holds to stand for it.
ENDS, END = b".,;:!?\n\x0b\x0c\r", b"\xff"
#: Entries of a container before it bursts, of a task's tries before subtrees are written out; languages of a task at a time.
BURST, ENTRIES, LANGUAGES = 4096, 600_000, 8
#: Frequent words that a language of a task may number before it starts anew, rare words that it remembers, and bits of
#: the number that a run of words is packed into.
WORDS, RARE, PACKED = 200_000, 20_000, 63
#: Words counted in a task before they are handed on; runs of words entered at a time; texts read at a time.
WORD_COUNTS, RUNS, ROWS = 300_000, 1 << 17, 200
#: Prefix partitions for each task of the scan, and shares into which the successors of one prefix are dealt.
PARTITIONS, SHARES = 4, 16

_CLEAN = bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" ")


def spelled(text: str | None) -> list[bytes]:
    """The words of a text (A-Z lower-cased), with END between pieces."""
    return (text or "").encode().lower().translate(_CLEAN).replace(b"\n", b" \xff ").split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 3)


def _lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 4)


class Container(dict):
    """A hash container: the words that remain of a run, packed into one number -> count."""


class HatTrie:
    """Counts of runs of ``length`` word ids, each packed into one number, PACKED // length bits to a word.

    Containers hang below nodes (dicts by the next word). The trie starts as one container; a container of several
    remaining words that holds more than ``burst`` runs becomes a node with a container for each next word.
    """

    def __init__(self, length: int, burst: int | None = None):
        self.length, self.bits, self.burst = length, PACKED // length, burst or BURST
        self.root, self.size = Container(), 0

    def add(self, runs: np.ndarray, counts: np.ndarray):
        """Adds the counts of distinct packed runs, in sorted order."""
        if len(runs):
            self.root = self._add(self.root, runs, counts, self.length - 1)

    def _add(self, place, runs: np.ndarray, counts: np.ndarray, after: int):
        """Adds runs, which have ``after`` words behind the next one, below ``place``; what stands there then."""
        if isinstance(place, Container):
            before, get = len(place), place.get
            for run, n in zip(runs.tolist(), counts.tolist()):
                place[run] = get(run, 0) + n
            self.size += len(place) - before
            return place if len(place) <= self.burst or not after else self._burst(place, after)
        heads = runs >> self.bits * after
        starts = np.nonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))[0]
        rest = runs & (1 << self.bits * after) - 1
        listed, times = rest.tolist(), counts.tolist()
        for word, x, y in zip(heads[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(runs)]):
            child = place.get(word)
            if child is None:
                child = place[word] = Container()
            if isinstance(child, Container):
                before, get = len(child), child.get
                for run, n in zip(listed[x:y], times[x:y]):
                    child[run] = get(run, 0) + n
                self.size += len(child) - before
                if len(child) > self.burst and after > 1:
                    place[word] = self._burst(child, after - 1)
            else:
                place[word] = self._add(child, rest[x:y], counts[x:y], after - 1)
        return place

    def _burst(self, container: Container, after: int) -> dict:
        node: dict = {}
        mask = (1 << self.bits * after) - 1
        for run, n in container.items():
            node.setdefault(run >> self.bits * after, Container())[run & mask] = n
        return node

    def take(self, at_most: int) -> tuple[np.ndarray, np.ndarray]:
        """Removes the largest subtrees, until no more than ``at_most`` entries are left: their runs and counts."""
        runs, counts = [], []

        def collect(place, prefix: int, after: int):
            if isinstance(place, Container):
                runs.append(np.fromiter(place.keys(), np.int64, len(place)) | prefix)
                counts.append(np.fromiter(place.values(), np.int64, len(place)))
            else:
                for word, child in place.items():
                    collect(child, prefix | word << self.bits * after, after - 1)

        if self.size > at_most:
            if isinstance(self.root, Container):
                collect(self.root, 0, self.length - 1)
                self.root, self.size = Container(), 0
            else:
                for size, word in sorted(((_size(child), word) for word, child in self.root.items()), reverse=True):
                    if self.size <= at_most:
                        break
                    collect(self.root.pop(word), word << self.bits * (self.length - 1), self.length - 2)
                    self.size -= size
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *runs]), np.concatenate([none, *counts])


def _size(place) -> int:
    return len(place) if isinstance(place, Container) else sum(map(_size, place.values()))


def packed_ids(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The runs of ``length`` ids that start at these places."""
    runs = ids[at]
    for i in range(1, length):
        runs = runs << PACKED // length | ids[at + i]
    return runs


class _Numbers(dict):
    """Ids of frequent words in a task, from 1; 0 for what no phrase holds: rare words and ends of pieces."""

    def __init__(self, lang: int, frequent: Bloom):
        super().__init__({END: 0})
        self.lang, self.frequent, self.hashes, self.rare = lang, frequent, [0], set()

    def __missing__(self, word: bytes) -> int:
        if word in self.rare:
            return 0
        name = word_hash(word)
        if name ^ self.lang not in self.frequent:
            if len(self.rare) >= RARE:
                self.rare.clear()
            self.rare.add(word)
            return 0
        self[word] = number = len(self.hashes)
        self.hashes.append(name)
        return number


def _pair_keys(first: np.ndarray, second: np.ndarray, lang: int) -> np.ndarray:
    return mixed(mixed(first, 1) ^ second, 2) ^ np.uint64(lang)


def _sorted_run(runs: np.ndarray, counts: np.ndarray, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subtrees as one run: rows of word hashes in sorted order, and their counts."""
    words = np.empty((len(runs), length), np.uint64)
    for i in range(length):
        words[:, i] = hashes[runs >> PACKED // length * (length - 1 - i) & (1 << PACKED // length) - 1]
    order = np.lexsort(words.T[::-1])
    return words[order], counts[order]


def _prefix_partition(words: np.ndarray, parts: int) -> np.ndarray:
    """By all words but the last, and one of a few shares of the last: a common prefix does not meet in one task."""
    key = words[:, -1] % np.uint64(SHARES)
    for i in range(words.shape[1] - 1):
        key = mixed(key ^ words[:, i], 11 + i)
    return (key % np.uint64(parts)).astype(np.int64)


class _Counting:
    """One language of a task: words become ids, runs of ids are entered, subtrees leave as sorted runs."""

    def __init__(self, lang: str, lengths: tuple[int, ...], words: Bloom, pairs: Bloom | None, parts: int):
        self.lang, self.name, self.lengths = lang, _lang_hash(lang), lengths
        self.words, self.pairs, self.parts = words, pairs, parts
        # ids fit their bits: a part of a text adds half of the numbers at most, and starts with half of them free
        self.limit = min(WORDS, 1 << PACKED // max(lengths))
        self.step = min(RUNS, self.limit // 2 - 8)
        self.waiting: list[int] = []
        self.tail = bytearray()  # 1: no run starts here, it is counted with the next part of the text
        self._fresh()

    def _fresh(self):
        self.numbers = _Numbers(self.name, self.words)
        self.tries = {n: HatTrie(n) for n in self.lengths}

    def feed(self, words: list[bytes]):
        number, over = self.numbers, max(self.lengths) - 1
        for at in range(0, len(words), self.step):
            part = words[at:at + self.step + over]
            self.waiting += map(number.__getitem__, part)
            self.waiting.append(0)
            own = min(self.step, len(part))
            self.tail += bytes(own) + b"\1" * (len(part) - own + 1)
            if len(self.waiting) >= RUNS or len(number) > self.limit // 2:
                yield from self.enter()
                number = self.numbers

    def enter(self):
        ids, self.waiting = np.array(self.waiting, np.int64), []
        own, self.tail = np.frombuffer(bytes(self.tail), np.uint8) == 0, bytearray()
        hashes = np.array(self.numbers.hashes, np.uint64)
        follows = (ids[:-1] > 0) & (ids[1:] > 0)
        if self.pairs is not None:
            at = np.nonzero(follows)[0]
            follows[at] = self.pairs.has(_pair_keys(hashes[ids[at]], hashes[ids[at + 1]], self.name))
        for length, trie in self.tries.items():
            whole = follows[:max(len(follows) - length + 2, 0)].copy()
            for i in range(1, length - 1):
                whole &= follows[i:len(whole) + i]
            whole &= own[:len(whole)]
            trie.add(*np.unique(packed_ids(ids, np.nonzero(whole)[0], length), return_counts=True))
        if len(self.numbers) > self.limit // 2:
            yield from self.rest()

    def size(self) -> int:
        return sum(trie.size for trie in self.tries.values())

    def shrink(self):
        """Writes the largest subtrees out."""
        hashes = np.array(self.numbers.hashes, np.uint64)
        for length, trie in self.tries.items():
            yield from self._written(length, *trie.take(trie.size // 4), hashes)

    def rest(self):
        """Everything that is left, and a new start."""
        if self.waiting:
            yield from self.enter()
        hashes = np.array(self.numbers.hashes, np.uint64)
        for length, trie in self.tries.items():
            yield from self._written(length, *trie.take(-1), hashes)
        self._fresh()

    def _written(self, length: int, runs: np.ndarray, counts: np.ndarray, hashes: np.ndarray):
        if not len(runs):
            return
        words, counts = _sorted_run(runs, counts, length, hashes)
        part = _prefix_partition(words, self.parts)
        order = np.argsort(part, kind="stable")  # inside a partition the run stays sorted
        part, words, counts = part[order], words[order], counts[order]
        starts = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
        ends = np.append(starts[1:], len(part))
        yield pa.RecordBatch.from_arrays([
            pa.array([self.lang] * len(starts)), pa.array(np.full(len(starts), length, np.int32)), pa.array(part[starts]),
            pa.array([_packed(words[x:y], counts[x:y]) for x, y in zip(starts.tolist(), ends.tolist())], pa.binary())],
            ["lang", "length", "part", "run"])


def _packed(words: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: each column on its own; a first word that repeats the one before is left out; short counts."""
    new = np.concatenate([[True], words[1:, 0] != words[:-1, 0]])
    kind = np.uint8 if counts.max() < 256 else np.int64
    head = np.array([len(words), new.sum(), np.dtype(kind).itemsize], np.int64).tobytes()
    return b"".join([head, words[new, 0].tobytes(), np.packbits(new).tobytes(),
                     *(np.ascontiguousarray(words[:, i]).tobytes() for i in range(1, words.shape[1])), counts.astype(kind).tobytes()])


def _unpacked(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    n, heads, width = np.frombuffer(data, np.int64, 3).tolist()
    at = 24
    first = np.frombuffer(data, np.uint64, heads, at)
    at += 8 * heads
    new = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n)
    at += -(-n // 8)
    words = np.empty((n, length), np.uint64)
    words[:, 0] = first[np.cumsum(new) - 1]
    for i in range(1, length):
        words[:, i] = np.frombuffer(data, np.uint64, n, at)
        at += 8 * n
    return words, np.frombuffer(data, np.uint8 if width == 1 else np.int64, n, at).astype(np.int64)


def _merge(runs: list[bytes], length: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of one prefix partition, merged; phrases below ``least`` are left out."""
    words, counts = zip(*(_unpacked(x, length) for x in runs))
    words, counts = np.concatenate(words), np.concatenate(counts)
    order = np.lexsort(words.T[::-1])  # a merge sort: it takes the runs as they are sorted
    words, counts = words[order], counts[order]
    starts = np.nonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))[0]
    total = np.add.reduceat(counts, starts)
    kept = total >= least
    return words[starts[kept]], total[kept]


def _word_counts(texts: DataFrame) -> DataFrame:
    """``(lang, word, f)``"""

    def local(batches):
        seen: dict[str, Counter] = {}
        size = 0

        def rows():
            for lang, counts in seen.items():
                if counts:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(counts)), pa.array([w.decode() for w in counts]),
                        pa.array(list(counts.values()), pa.int64())], ["lang", "word", "f"])
            seen.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    counts = seen.setdefault(lang, Counter())
                    before = len(counts)
                    counts.update(spelled(text))
                    counts.pop(END, None)
                    size += len(counts) - before
                    if size > WORD_COUNTS:
                        yield from rows()
                        size = 0
        yield from rows()

    return texts.mapInArrow(local, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _phrase_counts(texts: DataFrame, lengths: tuple[int, ...], least: int, parts: int, words, pairs=None) -> DataFrame:
    """``(lang, length, w1, w2, w3, w4, f)``: word hashes of phrases that occur ``least`` times or more."""

    def local(batches):
        frequent, linked = Bloom(words.value), None if pairs is None else Bloom(pairs.value)
        tries: dict[str, _Counting] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang not in tries:
                        if len(tries) >= LANGUAGES:  # few languages at a time: those before hand over what they have
                            for other in tries.values():
                                yield from other.rest()
                            tries.clear()
                        tries[lang] = _Counting(lang, lengths, frequent, linked, parts)
                    yield from tries[lang].feed(spelled(text))
                    while sum(x.size() for x in tries.values()) > ENTRIES:
                        yield from max(tries.values(), key=_Counting.size).shrink()
        for other in tries.values():
            yield from other.rest()

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        length = int(group["length"].iloc[0])
        found, f = _merge(group["run"].tolist(), length, least)
        out = {"lang": group["lang"].iloc[0], "length": np.full(len(f), length, np.int32)}
        for i in range(4):
            out[f"w{i + 1}"] = pd.array(found[:, i].view(np.int64) if i < length else [None] * len(f), dtype="Int64")
        return pd.DataFrame(out | {"f": f})

    runs = texts.mapInArrow(local, "lang string, length int, part long, run binary")
    return runs.groupBy("lang", "length", "part").applyInPandas(
        merged, "lang string, length int, w1 long, w2 long, w3 long, w4 long, f long")


def frequent_phrases(docs: DataFrame, least: int = 30, lang_col: str = "lang",
                     text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words array, f)`` of one to four words that occur ``least`` times or more, and ``(lang, n)``."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.col(text_col).cast("string").alias("text")).where("text is not null")
    counts = stage(_word_counts(texts), "phrases-words")
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))

    @F.pandas_udf("long")
    def hashed(values: pd.Series) -> pd.Series:
        return pd.Series([np.uint64(word_hash(x.encode())).astype(np.int64) for x in values], dtype="int64")

    @F.pandas_udf("long")
    def keyed(names: pd.Series, langs: pd.Series) -> pd.Series:
        own = {x: np.uint64(_lang_hash(x)) for x in langs.unique()}
        return pd.Series((names.to_numpy(np.int64).view(np.uint64) ^ langs.map(own).to_numpy(np.uint64)).view(np.int64))

    words = stage(counts.where(F.col("f") >= least).withColumn("id", hashed("word")), "phrases-frequent-words")
    if not words.groupBy("lang", "id").count().where("count > 1").isEmpty():
        raise ValueError("two frequent words of one hash")
    frequent = bloom(words.select(keyed("id", "lang")))
    parts = max(1, PARTITIONS * docs.rdd.getNumPartitions())
    pairs = stage(_phrase_counts(texts, (2,), least, parts, frequent), "phrases-pairs")

    @F.pandas_udf("long")
    def pair_key(first: pd.Series, second: pd.Series, langs: pd.Series) -> pd.Series:
        own = langs.map({x: np.uint64(_lang_hash(x)) for x in langs.unique()}).to_numpy(np.uint64)
        keys = _pair_keys(first.to_numpy(np.int64).view(np.uint64), second.to_numpy(np.int64).view(np.uint64), 0) ^ own
        return pd.Series(keys.view(np.int64))

    linked = bloom(pairs.select(pair_key("w1", "w2", "lang")))
    used = bloom(pairs.select("lang", F.explode(F.array("w1", "w2")).alias("id")).distinct().select(keyed("id", "lang")))
    longer = stage(_phrase_counts(texts, (3, 4), least, parts, used, linked), "phrases-longer")
    named = pairs.union(longer)
    for i in range(1, 5):  # a rare word that shares a frequent one's hash is told apart by no filter, but has no row here
        own = words.select("lang", F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"))
        named = named.join(own, ["lang", f"w{i}"], "left" if i > 2 else "inner")
    spelled_out = F.array_compact(F.array(*[f"word{i}" for i in range(1, 5)]))
    named = named.select("lang", spelled_out.alias("words"), "f")
    every = named.union(words.select("lang", F.array("word").alias("words"), "f"))
    return every.select("lang", F.concat_ws(" ", "words").alias("phrase"), "words", "f"), total


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, inside_percent: int = 80, lang_col: str = "lang",
                 text_col: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language (null: ``und``).

    Texts (A-Z lower-cased; null: empty) fall at ``.,;:!?`` and line ends into pieces, and these at blanks and tabs
    into words. Phrases are runs of 2 to 4 words inside a piece that occur a >= ``least`` times, overlaps included.
    A cut into a first part of l and a rest of r occurrences scores floor(2000000 a / (l + r)); the lowest cut counts,
    ties to the shorter first part. Phrases inside a longer one with 100 f(longer) >= inside_percent * a are dropped. Rank by
    score and a, falling, then by the phrase's bytes; n counts the language's words. Numbers are exact (decimals
    of 38 digits). Repeated rows count as often as they stand there; ids and other columns are ignored; no rows, or no phrase
    as frequent, give no rows. Texts of any length count whole: what a task holds at once is bounded by entries.
    """
    every, total = frequent_phrases(docs, least, lang_col, text_col)
    every = stage(every, "phrases-counts")
    f = every.select("lang", "phrase", "f")
    many = every.where(F.size("words") > 1)
    joined = lambda start, length: F.concat_ws(" ", F.slice("words", start, length))
    cut = many.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"),
                     joined(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    parts = cut.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(cast(2000000 as decimal(18, 0)) * cast(a as decimal(19, 0)) div cast(l + r as decimal(19, 0)) as long)")
    scored = parts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("least"))

    # phrases inside longer ones: the most frequent of those decides
    inner = many.where(F.size("words") > 2).select("lang", "f", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    inner = inner.select("lang", "f", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    longer = inner.select("lang", joined(F.col("at"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(
        F.max("f").alias("longer"))
    inside = F.coalesce(100 * F.col("longer").cast("decimal(19, 0)") >= inside_percent * F.col("a").cast("decimal(19, 0)"), F.lit(False))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~inside).select("lang", "phrase", "a", "least.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))  # a language's first ones from the first ones of its shares
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
