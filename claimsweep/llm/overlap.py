"""Jaccard self-join of documents by word n-grams, with vertical partitions of the n-gram order.

N-grams are ordered by their hashes. That order is cut into fragments, and each document's sorted set falls
into segments, one for each fragment.

* Candidates. The sets of two linked documents differ in at most D n-grams, D known from their size class. The
  class's order is cut into V > D fragments, so at least V - D segments are equal in both. A document is listed
  under the D + 1 largest of its segments; then two linked documents share an entry (the prefix argument,
  with segments for tokens). Equal sets are one document before that.
* Counting. For pairs that meet, partial overlaps are counted fragment by fragment, apart from each other, and
  summed for each pair; the sum decides exactly.

Groups of near copies are first tied to few leaders. Only documents that share an entry and are not yet tied
together go on: as pairs where the entry is short, in blocks of bounded size, with matrices of partial overlaps,
where it is long. So no group ever emits all its pairs, and none is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .bloom import Bloom, bloom, mixed
from .common import fresh, ship, with_row_id
from .components import components
from .vocab import Cache

#: Vertical fragments in which overlaps are counted.
FRAGMENTS = 8
#: Growth of the size classes.
CLASS_GROWTH = 1.25
#: Documents under an entry beyond which they are compared in blocks, and n-grams and documents of a block.
CROWDED, BLOCK, BLOCK_DOCS = 64, 1 << 18, 512
#: Texts that a worker answers for at a time, and words that it remembers.
ROWS, CACHED = 200, 400_000
#: Columns of an incidence matrix held at once.
COLUMNS = 4096
#: A row's place in the stored files.
ROW = "row struct<file: bigint, at: bigint>"


def allowed_difference(smaller: int, percent: int) -> int:
    """The most n-grams in which sets that link can differ, by the size of the smaller one.

    Linked: the union holds at most smaller * 100 / percent n-grams, and of these 100 - percent in a hundred differ.
    """
    return smaller * (100 - percent) // percent


def size_class(n: int) -> tuple[int, int, int]:
    """(number, first size, first size of the next class) of the class that holds sets of n n-grams."""
    number, first = 0, 1
    while True:  # classes grow geometrically
        following = max(first + 1, int(first * CLASS_GROWTH))
        if n < following:
            return number, first, following
        number, first = number + 1, following


def cuts(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(class, fragments, entries) under which a set of n n-grams is listed: as the smaller and as the larger one."""
    out, smallest = [], -(-n * percent // 100)
    size = n
    while size >= max(smallest, 1):
        number, first, following = size_class(size)
        differ = allowed_difference(following - 1, percent)
        if differ:
            out.append((number, differ + 1 + (differ + 1) // 2, differ + 1))
        size = first - 1
    return out


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 11)


_hashes = Cache(_hash, CACHED)


def gram_set(text: str | None, k: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word n-grams (A-Z lower-cased); shorter texts are one n-gram."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(k, len(words))
    n = len(words) - size + 1
    grams = np.full(n, size, np.uint64)
    for i in range(size):
        grams = mixed(grams ^ own[i:i + n])
    _hashes.trim()
    return np.unique(grams)


def entries(grams: np.ndarray, percent: int) -> np.ndarray:
    """The hashes of the segments under which a set is listed."""
    found = []
    for number, fragments, listed in cuts(len(grams), percent):
        fragment = ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(fragment, minlength=fragments)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(grams, 3), dtype=np.uint64)])
        ends = np.cumsum(counts)
        sums = sums[ends] - sums[ends - counts]  # of a segment's n-grams: equal for equal segments
        name = mixed(sums ^ mixed(np.uint64(number) << np.uint64(32) | np.arange(fragments, dtype=np.uint64), 5))
        # an order of (fragment, segment) that is the same in all documents: the most n-grams first
        found.append(name[np.lexsort((name, -counts))[:listed]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _facts(percent: int, k: int):
    """Sizes, 128-bit digests and entries of the sets of a batch's texts."""

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, first, second, listed = [], [], [], []
                for text in part.column("text").to_pylist():
                    grams = gram_set(text, k)
                    n.append(len(grams))
                    first.append(mixed(grams, 1).sum(dtype=np.uint64).astype(np.int64))
                    second.append(mixed(grams, 2).sum(dtype=np.uint64).astype(np.int64))
                    listed.append(entries(grams, percent).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.int64()),
                     pa.array(second, pa.int64()), pa.array(listed, pa.list_(pa.int64()))],
                    ["row", "doc_id", "n_shingles", "d1", "d2", "entries"])

    return apply


def _cut(grams: np.ndarray, fragments: int) -> list[np.ndarray]:
    marks = np.searchsorted(grams, np.arange(1, fragments, dtype=np.uint64) * np.uint64((1 << 64) // fragments))
    return np.split(grams, marks)


def _linked(shared, n, m, percent):
    return 100 * shared >= percent * (n + m - shared)


def summed_overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``(u, v, shared, n, m)``: partial overlaps of pairs of nodes, counted by fragment and summed for each pair."""

    @F.pandas_udf("long")
    def partial(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                          for x, y in zip(left, right)], dtype="int64")

    left = segments.select(F.col("node").alias("u"), "fragment", "n", F.col("grams").alias("left"))
    right = segments.select(F.col("node").alias("v"), "fragment", F.col("n").alias("m"), F.col("grams").alias("right"))
    met = pairs.join(left, "u").join(right, ["v", "fragment"])
    return met.select("u", "v", "n", "m", partial("left", "right").alias("part")).groupBy("u", "v").agg(
        F.sum("part").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    found = summed_overlaps(pairs, segments)
    return found.where(_linked(F.col("shared"), F.col("n"), F.col("m"), percent)).select("u", "v")


def _matrix(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of the one list with all of the other, some n-grams at a time."""
    out = np.zeros((len(left), len(right)), np.int32)

    def joined(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))

    (a, row_a), (b, row_b) = joined(left), joined(right)
    common = np.intersect1d(a, b)
    keep_a, keep_b = np.isin(a, common), np.isin(b, common)
    col_a, row_a = np.searchsorted(common, a[keep_a]), row_a[keep_a]
    col_b, row_b = np.searchsorted(common, b[keep_b]), row_b[keep_b]
    for at in range(0, len(common), COLUMNS):
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        own = (col_a >= at) & (col_a < at + COLUMNS)
        x[row_a[own], col_a[own] - at] = 1
        own = (col_b >= at) & (col_b < at + COLUMNS)
        y[row_b[own], col_b[own] - at] = 1
        out += (x @ y.T).astype(np.int32)  # whole numbers below 2 ** 24: exact
    return out


def _joining(us: list, vs: list) -> list[bool]:
    """Which edges, taken in order, join two components: those that are needed."""
    root: dict = {}

    def top(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    needed = []
    for u, v in zip(us, vs):
        u, v = top(u), top(v)
        needed.append(u != v)
        root[u] = v
    return needed


def _block_links(crowd: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Links in crowds, block by block. ``crowd(node, crowd, root, n)``: the crowd that a node is in, what it is tied to.

    What is tied to a node that many others are tied to stands in blocks of its own, and these are not compared
    with each other; all other blocks of a crowd are. A block pair's matrices of partial overlaps, one for each
    fragment, are summed, and only links leave the task.
    """
    size = crowd.groupBy("crowd", "root").agg(F.sum("n").alias("grams"), F.count("*").alias("docs"))
    size = size.withColumn("heap", F.when((F.col("docs") > BLOCK_DOCS // 8) | (F.col("grams") > BLOCK // 8), F.col("root")))
    dealt = size.groupBy("crowd", "heap").agg(
        F.ceil(F.greatest(F.sum("grams") / BLOCK, F.sum("docs") / BLOCK_DOCS)).cast("long").alias("parts"))
    name = F.xxhash64("crowd", F.coalesce("heap", F.lit(-1)), "part").alias("block")
    blocks = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("crowd", "heap", name)
    blocks = stage(blocks, "overlap-blocks")
    other = blocks.select("crowd", F.col("heap").alias("heap2"), F.col("block").alias("block2"))
    met = blocks.join(other, "crowd").where("block <= block2 and not (heap is not null and heap <=> heap2)")
    met = met.select("block", "block2", F.xxhash64("block", "block2").alias("meeting"))
    parts = dealt.select(F.col("crowd").alias("crowd2"), F.col("heap").alias("heap2"), "parts")
    member = crowd.join(size.select("crowd", "root", "heap"), ["crowd", "root"]).join(
        parts, (F.col("crowd") == F.col("crowd2")) & F.col("heap").eqNullSafe(F.col("heap2")))
    member = member.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).select("node", "root", name)
    member = stage(member, "overlap-members")
    sides = met.select("meeting", "block", F.lit(0).alias("side")).union(
        met.select("meeting", F.col("block2").alias("block"), F.lit(1).alias("side")))
    rows = member.join(sides, "block").select("node", "root", "meeting", "side").join(
        segments.select("node", "fragment", "n", "grams"), "node")

    def partial(group: pd.DataFrame) -> pd.DataFrame:
        """One fragment's overlaps of a block pair, with the nodes in order."""
        group = group.sort_values("node")
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("meeting", "us", "vs", "ns", "ms", "roots_u", "roots_v", "overlaps")})
        sets = lambda side: [np.frombuffer(x, np.uint64) for x in side["grams"]]
        out = _matrix(sets(left), sets(right))
        packed = lambda x: [x.to_numpy(np.int64).tobytes()]
        return pd.DataFrame({"meeting": group["meeting"].iloc[:1].to_numpy(), "us": packed(left["node"]),
                             "vs": packed(right["node"]), "ns": packed(left["n"]), "ms": packed(right["n"]),
                             "roots_u": packed(left["root"]), "roots_v": packed(right["root"]), "overlaps": [out.tobytes()]})

    def total(group: pd.DataFrame) -> pd.DataFrame:
        """The sum over the fragments, and what it links; of links between two groups that are tied, one is enough."""
        of = lambda c: np.frombuffer(group[c].iloc[0], np.int64)
        us, vs = of("us"), of("vs")
        shared = sum(np.frombuffer(x, np.int32).reshape(len(us), len(vs)).astype(np.int64) for x in group["overlaps"])
        n, m = of("ns")[:, None], of("ms")[None, :]
        link = _linked(shared, n, m, percent) & (of("roots_u")[:, None] != of("roots_v")[None, :])
        i, j = np.nonzero(link)
        found = pd.DataFrame({"u": us[i], "v": vs[j], "x": of("roots_u")[i], "y": of("roots_v")[j]}).drop_duplicates(["x", "y"])
        return found[["u", "v"]][_joining(found["x"].tolist(), found["y"].tolist())]

    kind = ("meeting long, us binary, vs binary, ns binary, ms binary, roots_u binary, roots_v binary, overlaps binary")
    return rows.groupBy("meeting", "fragment").applyInPandas(partial, kind).groupBy("meeting").applyInPandas(
        total, "u long, v long")


def _tied(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes after these links."""
    roots = components(links)
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("v", "node").alias("root"))


def _groups(listed: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """``(node, root)`` from ``listed(entry, node, n)``: the components of all links."""
    nodes = segments.where("fragment = 0").select("node", "n")
    ends = listed.groupBy("entry").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    lists = listed.join(ends, "entry")
    near = lists.groupBy("node").agg(F.min("least").alias("v"), F.max("most").alias("w"))
    pairs = near.select(F.col("node").alias("u"), "v").union(near.select(F.col("node").alias("u"), F.col("w").alias("v")))
    links = stage(_links(pairs.where("u <> v").distinct(), segments, percent), "overlap-links")
    tied = stage(_tied(nodes, links), "overlap-tied")

    # entries whose documents are not all tied together yet
    placed = listed.join(tied, "node")
    lists = placed.groupBy("entry").agg(F.count("*").alias("members"), F.min("root").alias("a"), F.max("root").alias("b"))
    open_ = stage(placed.join(lists.where("a <> b").select("entry", "members"), "entry"), "overlap-open")
    short = open_.where(F.col("members") <= CROWDED)
    other = short.select("entry", F.col("node").alias("v"), F.col("root").alias("other"), F.col("n").alias("m"))
    pairs = short.withColumnRenamed("node", "u").join(other, "entry").where(
        (F.col("u") < F.col("v")) & (F.col("root") != F.col("other"))
        & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))).select("u", "v").distinct()
    more = stage(links.union(_links(pairs, segments, percent)), "overlap-links")
    long_ = open_.where(F.col("members") > CROWDED)
    if not long_.isEmpty():
        first = long_.groupBy("entry").agg(F.min("node").alias("first"))
        meets = long_.join(first, "entry").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
        names = _tied(long_.select("node").distinct(), meets)
        crowd = names.withColumnRenamed("root", "crowd").join(tied, "node").join(nodes, "node")
        more = more.union(_block_links(stage(crowd, "overlap-crowds"), segments, percent))
    return _tied(nodes.select("node"), more)


def similar_documents(docs: DataFrame, percent: int = 90, k: int = 3, id_col: str = "doc_id", text_col: str = "text",
                      fragments: int = FRAGMENTS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_copies)``, a row for each row of ``docs``, a plain read of Parquet files.

    A document's set holds its distinct k-word n-grams (A-Z lower-cased, words between ASCII white space); with
    fewer words, all of them as one n-gram. Two documents link when 100 * intersection >= percent * union;
    component_id is the smallest id reachable over links. n_copies counts the rows with the same set. N-grams are
    compared by 64-bit hashes. Texts that are null or without words have no n-grams, link with nothing and are
    their own component. Rows without an id are kept and link; they name no component (one that holds no id has
    null). Rows of one id are linked only if their texts are. Texts of any length count whole; other columns
    are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    row = fresh(docs, "row")
    numbered = with_row_id(docs, row).select(
        F.col(row).alias("row"), F.xxhash64(row).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = stage(numbered.mapInArrow(_facts(percent, k), f"{ROW}, doc_id long, n_shingles long, d1 long, d2 long, entries array<long>"),
                "overlap-documents")
    same = own.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("n_copies"), F.min("row").alias("row"))
    # one number for each different set: given once, in a table that is written once
    sets = stage(same.withColumn("node", F.monotonically_increasing_id()), "overlap-sets")

    listed = own.join(sets.select("row", "node", F.col("n_shingles").alias("n")), "row").select(
        F.explode("entries").alias("entry"), "node", "n")
    listed = stage(listed, "overlap-entries")
    shared = listed.groupBy("entry").agg(F.count("*").alias("members")).where("members > 1")
    listed = stage(listed.join(shared.select("entry"), "entry"), "overlap-shared")

    # the segments of the documents that share an entry, from their texts; the filter spares most texts the way
    wanted = listed.select("node").distinct().join(sets.select("node", "row"), "node").select("row", "node")
    wanted = stage(wanted, "overlap-wanted")
    kept = bloom(wanted.select(F.xxhash64("row")))

    def segments_of(batches):
        filter_ = Bloom(kept.value)
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(filter_.has(keys.view(np.uint64)))).select(["row", "text"])
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [gram_set(text, k) for text in part.column(1).to_pylist()]
                of = np.repeat(np.arange(len(sets)), fragments)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(of)), pa.array(np.tile(np.arange(fragments, dtype=np.int32), len(sets))),
                    pa.array(np.array([len(x) for x in sets], np.int64)[of]),
                    pa.array([x.tobytes() for grams in sets for x in _cut(grams, fragments)], pa.binary())],
                    ["row", "fragment", "n", "grams"])

    segments = numbered.mapInArrow(segments_of, f"{ROW}, fragment int, n long, grams binary").join(wanted, "row").drop("row")
    groups = _groups(listed, stage(segments, "overlap-segments"), percent)

    placed = sets.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    label = placed.join(named, "root").select("n_shingles", "d1", "d2", "n_copies", "component_id")
    # a hot set is one row of ``label``: adaptive execution splits its documents over tasks
    some = own.where("n_shingles > 0").join(label, ["n_shingles", "d1", "d2"])
    none = own.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("n_copies", F.lit(1).cast("long"))
    out = ["doc_id", "n_shingles", "component_id", "n_copies"]
    return some.select(out).union(none.select(out))
