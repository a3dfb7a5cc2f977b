"""SimHash near-duplicates: linked fingerprints found by a generalised pigeonhole.

The 64 bits are dealt into m parts that keep correlated bits together. Two fingerprints that differ in
at most ``radius`` bits must agree to within T_i bits in some part i, for any thresholds with
sum(T_i) = radius - m + 1 (T_i = -1 leaves part i out). Each fingerprint gets its own thresholds, by
dynamic programming on candidate counts estimated from histograms of all fingerprints; it probes an
exact index of the parts with the variants those thresholds call for, and candidates are verified.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..staging import stage
from .common import fresh, ship, with_row_id
from .components import components

BITS = 64
#: A part value held by more fingerprints than this is crowded; what probes it takes the other exact way.
CROWDED = 256
#: Cost of one probe in units of one verified candidate.
PROBE_COST = 2.0
#: Bits of one histogram.
BLOCK = 8
#: Shingles hashed at a time, so that a very long text needs little memory.
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, seed: int = 42, k: int = 3) -> int:
    """Signed 64-bit SimHash over the XXH64 of all word k-shingles, repeats included."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    digest, total, votes = xxhash.xxh64_intdigest, max(len(words) - k + 1, 1), np.zeros(BITS, np.int64)
    shingles = zip(*(words[i:] for i in range(k))) if len(words) >= k else iter([words])
    while part := [digest(b" ".join(s), seed) for s in itertools.islice(shingles, SHINGLES_AT_ONCE)]:
        hashes = np.array(part, ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total).view(">i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint, na_action=None)


def fingerprint_of(text: Column) -> Column:
    """Fingerprint of a text column; null and wordless texts have fingerprint zero."""
    return _fingerprints(text.cast("binary"))


@dataclass(frozen=True)
class Layout:
    """Bits of each part, lowest cost first in each; histograms count blocks of up to BLOCK bits of a part."""

    parts: tuple[tuple[int, ...], ...]

    def mask(self, part: int) -> int:
        return sum(1 << b for b in self.parts[part])

    def blocks(self, part: int) -> list[tuple[int, ...]]:
        bits = self.parts[part]
        return [bits[i:i + BLOCK] for i in range(0, len(bits), BLOCK)]


def _unsigned(values) -> np.ndarray:
    return np.asarray(values, np.int64).view(np.uint64)


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(together: np.ndarray, m: int) -> Layout:
    """Deals the bits into m parts of near equal size, each grown from bits correlated with those it has.

    together[i, j]: in how many fingerprints bits i and j are both set; together[i, i]: how many set bit i;
    its last row and column count all fingerprints.
    """
    n = max(float(together[BITS, BITS]), 1.0)
    p = np.diag(together)[:BITS] / n
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs((together[:BITS, :BITS] / n - np.outer(p, p)) / np.outer(spread, spread))
    left, parts = set(range(BITS)), []
    for i in range(m):
        size = (BITS - sum(map(len, parts))) // (m - i)
        seed = max(sorted(left), key=lambda b: corr[b, sorted(left - {b})].sum() if len(left) > 1 else 0.0)
        part = [seed]
        left.discard(seed)
        while len(part) < size:
            nearest = max(sorted(left), key=lambda b: corr[b, part].sum())
            part.append(nearest)
            left.discard(nearest)
        parts.append(tuple(part))
    return Layout(tuple(parts))


def _together(fps: DataFrame) -> np.ndarray:
    """How often bits are set together, over all fingerprints: at most 65 x 65 counts reach the driver."""

    def count(batches):
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            x = np.ones((len(batch), BITS + 1), np.float32)
            x[:, :BITS] = _bit_matrix(_unsigned(batch["fp"]))
            for i in range(0, len(x), 1 << 14):
                total += x[i:i + (1 << 14)].T @ x[i:i + (1 << 14)]
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "n": total[i, j].astype(np.int64)})

    out = np.zeros((BITS + 1, BITS + 1))
    for r in fps.mapInPandas(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["n"]
    return out


def _block_values(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    values = np.zeros(len(fps), np.int64)
    for i, b in enumerate(bits):
        values |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return values


def _histograms(fps: DataFrame, layouts: list[Layout]) -> dict[tuple[int, int, int], np.ndarray]:
    """Counts of each block's values over all fingerprints: a few thousand numbers at any input size."""
    blocks = [((a, i, j), bits) for a, lay in enumerate(layouts) for i in range(len(lay.parts))
              for j, bits in enumerate(lay.blocks(i))]

    def count(batches):
        totals = [np.zeros(1 << len(bits), np.int64) for _, bits in blocks]
        for batch in batches:
            values = _unsigned(batch["fp"])
            for total, (_, bits) in zip(totals, blocks):
                total += np.bincount(_block_values(values, bits), minlength=len(total))
        for k, total in enumerate(totals):
            v = np.nonzero(total)[0]
            yield pd.DataFrame({"k": np.full(len(v), k), "v": v, "n": total[v]})

    out = {key: np.zeros(1 << len(bits)) for key, bits in blocks}
    for r in fps.mapInPandas(count, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).collect():
        out[blocks[r["k"]][0]][r["v"]] = r["n"]
    return out


def _within(histogram: np.ndarray, radius: int) -> np.ndarray:
    """[v, d]: share of all fingerprints whose block value lies d bits from v, d up to ``radius``."""
    size = len(histogram)
    share = histogram / max(histogram.sum(), 1.0)
    distance = np.bitwise_count(np.arange(size)[:, None] ^ np.arange(size)[None, :])
    return np.stack([(share[None, :] * (distance == d)).sum(axis=1) for d in range(radius + 1)], axis=1)


@dataclass(frozen=True)
class Plan:
    """How to probe: a layout and, for each part, what its histograms say about candidates."""

    layout: Layout
    tables: tuple[tuple[np.ndarray, ...], ...]
    n: float
    radius: int

    def variants(self, part: int, t: int) -> np.ndarray:
        """Masks to exclusive-or with a part's value to reach all values within t bits."""
        bits = self.layout.parts[part]
        return np.array([sum(1 << b for b in c) for d in range(t + 1) for c in itertools.combinations(bits, d)],
                        np.uint64)

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """[fingerprint, part, t + 1]: estimated candidates and probes of threshold t in a part; t = -1 is free."""
        out = np.zeros((len(fps), len(self.layout.parts), self.radius + 2))
        for i in range(len(self.layout.parts)):
            near = np.zeros((len(fps), self.radius + 1))
            near[:, 0] = 1.0
            for table, bits in zip(self.tables[i], self.layout.blocks(i)):
                own, both = table[_block_values(fps, bits)], np.zeros_like(near)
                for d in range(self.radius + 1):
                    for e in range(d + 1):
                        both[:, d] += near[:, e] * own[:, d - e]
                near = both
            for t in range(self.radius + 1):
                probes = sum(1 for d in range(t + 1) for _ in itertools.combinations(range(len(self.layout.parts[i])), d))
                out[:, i, t + 1] = near[:, :t + 1].sum(axis=1) * self.n + PROBE_COST * probes
        return out

    def thresholds(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds of least cost with sum radius - m + 1, and that cost; by dynamic programming over the parts."""
        cost, m = self.costs(fps), len(self.layout.parts)
        budget = self.radius + 1  # sum of (t + 1) over the parts
        best = np.full((len(fps), budget + 1), np.inf)
        best[:, 0] = 0.0
        choice = np.zeros((m, len(fps), budget + 1), np.int8)
        for i in range(m):
            after = np.full_like(best, np.inf)
            for used in range(budget + 1):
                for t in range(used + 1):
                    value = best[:, used - t] + cost[:, i, t]
                    better = value < after[:, used]
                    after[better, used] = value[better]
                    choice[i, better, used] = t
            best = after
        out, left, rows = np.zeros((len(fps), m), np.int8), np.full(len(fps), budget), np.arange(len(fps))
        for i in reversed(range(m)):
            t = choice[i, rows, left]
            out[:, i], left = t - 1, left - t
        return out, best[:, budget]


def make_plan(fps: DataFrame, radius: int = 2) -> Plan:
    """Chooses the number of parts by the mean cost over a sample of what the histograms describe."""
    together = _together(fps)
    layouts = [group_bits(together, m) for m in range(1, radius + 2)]
    counts = _histograms(fps, layouts)
    n = float(together[BITS, BITS])
    rng, plans = np.random.default_rng(0), []
    for a, lay in enumerate(layouts):
        tables = tuple(tuple(_within(counts[a, i, j], radius) for j in range(len(lay.blocks(i))))
                       for i in range(len(lay.parts)))
        drawn = np.zeros(512, np.uint64)  # fingerprints drawn from the block histograms
        for i in range(len(lay.parts)):
            for j, bits in enumerate(lay.blocks(i)):
                share = counts[a, i, j] / max(counts[a, i, j].sum(), 1.0)
                values = rng.choice(len(share), len(drawn), p=share) if share.sum() else np.zeros(len(drawn), int)
                for k, b in enumerate(bits):
                    drawn |= ((values >> k) & 1).astype(np.uint64) << np.uint64(b)
        plan = Plan(lay, tables, n, radius)
        plans.append((plan.thresholds(drawn)[1].mean(), -len(lay.parts), plan))
    return min(plans, key=lambda x: x[:2])[2]


def _probe_rows(fps: DataFrame, plan: Plan) -> DataFrame:
    """(fp, part, value): what each fingerprint looks up."""

    def probe(batches):
        for batch in batches:
            values = _unsigned(batch["fp"])
            for at in range(0, len(values), 2048):
                own = values[at:at + 2048]
                chosen, _ = plan.thresholds(own)
                for i in range(len(plan.layout.parts)):
                    for t in np.unique(chosen[:, i]):
                        if t >= 0:
                            rows = own[chosen[:, i] == t]
                            masks = plan.variants(i, int(t))
                            keys = (rows & np.uint64(plan.layout.mask(i)))[:, None] ^ masks[None, :]
                            yield pd.DataFrame({"fp": np.repeat(rows, len(masks)).view(np.int64),
                                                "part": np.int32(i), "value": keys.ravel().view(np.int64)})

    return fps.select("fp").mapInPandas(probe, "fp long, part int, value long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame, radius: int = 2, crowded: int = CROWDED, plan: Plan | None = None) -> DataFrame:
    """``(u, v)``: edges that connect just what is connected by pairs differing in at most ``radius`` bits.

    ``fps(fp long)`` holds distinct fingerprints in a stored table. Fingerprints that would probe a part
    value shared by more than ``crowded`` others are not compared pair by pair. For those that do so,
    radius 2 has a second exact way: two of them are linked just if a third word lies within one bit of
    both, so each is grouped under its 65 such words and tied to the smallest of each group. A pair
    with one uncrowded member is found by that member's probes. Other radii verify every candidate.
    """
    plan = plan or make_plan(fps, radius)
    parts = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(plan.layout.mask(i)))).alias("value"))
             for i in range(len(plan.layout.parts))]
    index = fps.select(F.col("fp").alias("other"), F.explode(F.array(*parts)).alias("p")).select("other", "p.*")
    probes = _probe_rows(fps, plan)
    edges = None
    if radius == 2:
        heavy = index.groupBy("part", "value").count().where(F.col("count") > crowded).select("part", "value")
        heavy = stage(heavy, "simhash-crowded")
        busy = stage(probes.join(heavy, ["part", "value"], "left_semi").select("fp").distinct(), "simhash-busy")
        probes = probes.join(heavy, ["part", "value"], "left_anti").join(busy, "fp", "left_anti")
        near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)]
        meets = busy.select("fp", F.explode(F.array(*near)).alias("word"))
        first = meets.groupBy("word").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
        edges = meets.join(first, "word").where("fp <> u").select("u", F.col("fp").alias("v"))
    found = probes.join(index, ["part", "value"]).where(
        (F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius))
    found = found.select(F.col("fp").alias("u"), F.col("other").alias("v"))
    return found if edges is None else found.union(edges)


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text",
                    crowded: int = CROWDED) -> DataFrame:
    """``(doc_id, fingerprint string, component_id, n_copies)``, a row for each row of ``docs``.

    component_id is the smallest id reachable over fingerprints that differ in ``radius`` bits or fewer;
    n_copies counts the rows with the same fingerprint. Null and wordless texts share fingerprint zero.
    Rows with a null id are kept; they do not name a component unless it has no id at all (then null).
    Repeated rows stay repeated; other columns are ignored; no rows give no rows.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_of(F.col(text_col)).alias("fp"))
    return grouped(stage(own, "simhash-documents"), radius, crowded).drop("root")


def grouped(own: DataFrame, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """The same from a stored table ``(doc_id, fp)``, and ``root``, one number for each group; further columns stay."""
    each = own.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_copies"))
    each = stage(each, "simhash-fingerprints")
    roots = components(links(each.select("fp"), radius, crowded))
    placed = each.join(roots, each["fp"] == roots["u"], "left").select(
        "fp", "least_id", "n_copies", F.coalesce("v", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    label = placed.join(named, "root").select("fp", "root", "n_copies", "component_id")
    # a hot fingerprint is one row of ``label``: adaptive execution splits its documents over tasks
    return own.join(label, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies", "root",
        *[c for c in own.columns if c not in ("doc_id", "fp")])


def keep_one(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, with all columns of ``docs`` (a stored table).

    The one with the smallest id stays; of rows with that id, or without any, the first in a fixed order of the
    files (by a hash of their paths) and of the rows in them.
    """
    ship(docs.sparkSession)
    row, seen = fresh(docs, "row"), fresh(docs, "kept_row")
    numbered = with_row_id(docs, row)
    own = numbered.select(F.col(id_col).cast("long").alias("doc_id"), F.col(row).alias("at"),
                          fingerprint_of(F.col(text_col)).alias("fp"))
    groups = grouped(stage(own, "simhash-documents"), radius)
    first = groups.groupBy("root").agg(F.min_by("at", F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias(seen))
    return numbered.join(first.select(seen), F.col(row) == F.col(seen), "left_semi").drop(row)
