import itertools
import random

import numpy as np
import pytest
import xxhash
from helpers import awkward, stored

from claimsweep.llm import simhash
from claimsweep.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=2):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def as_long(x):
    return x - (1 << 64) if x >> 63 else x


def test_whole_query_against_brute_force(spark, tmp_path):
    rows = awkward()
    got = simhash.near_duplicates(stored(spark, rows, tmp_path / "d")).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    roots = plain_components(fps)
    expected = []
    for (i, _, *_), fp, root in zip(rows, fps, roots):
        ids = [r[0] for r, x in zip(rows, roots) if x == root and r[0] is not None]
        expected.append((i, f"{fp:016x}", min(ids) if ids else None))
    key = lambda t: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in t)
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("crowded", [1, 4, 256])
@pytest.mark.parametrize("spread", [4, 12, 64])
def test_links_of_dense_and_sparse_fingerprints(spark, crowded, spread):
    r = random.Random(spread)
    fps = {r.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:6]:  # balls, chains and crowds around some of them
        for _ in range(40):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(spread)
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 1 << 63}
    table = spark.createDataFrame([(as_long(x),) for x in fps], "fp long")
    found = {row["u"]: row["v"] for row in components(simhash.links(table, crowded=crowded)).collect()}
    ordered = sorted(map(as_long, fps))
    roots = plain_components([x & (1 << 64) - 1 for x in ordered])
    least = {}
    for x, root in zip(ordered, roots):
        least.setdefault(root, x)
    assert {x: found.get(x, x) for x in ordered} == {x: least[root] for x, root in zip(ordered, roots)}


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_other_radii(spark, radius):
    r = random.Random(radius)
    fps = {r.getrandbits(64) for _ in range(20)}
    fps |= {x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in list(fps)}
    table = spark.createDataFrame([(as_long(x),) for x in fps], "fp long")
    pairs = {frozenset((row["u"], row["v"])) for row in simhash.links(table, radius).collect()}
    assert pairs == {frozenset(map(as_long, p)) for p in itertools.combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= radius}


def test_thresholds_have_the_right_sum_and_least_cost(spark):
    fps = np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.int64)
    table = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    for m in (1, 2, 3):
        lay = simhash.group_bits(simhash._together(table), m)
        assert sorted(b for p in lay.parts for b in p) == list(range(64))
        counts = simhash._histograms(table, [lay])
        plan = simhash.Plan(lay, tuple(tuple(simhash._within(counts[0, i, j], 2) for j in range(len(lay.blocks(i))))
                                       for i in range(m)), 400.0, 2)
        chosen, cost = plan.thresholds(fps.view(np.uint64)[:20])
        assert (chosen.sum(axis=1) == 2 - m + 1).all()
        each = plan.costs(fps.view(np.uint64)[:20])
        for q in range(20):
            best = min(sum(each[q, i, t + 1] for i, t in enumerate(ts)) for ts in itertools.product(range(-1, 3), repeat=m)
                       if sum(ts) == 3 - m)
            assert cost[q] == pytest.approx(best)


def test_keep_one_keeps_columns_and_one_of_each_group(spark, tmp_path):
    rows = awkward()
    docs = stored(spark, rows, tmp_path / "d")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = plain_components([plain_fingerprint(r[1]) for r in rows])
    assert kept.count() == len(set(groups))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(3) == 1


def test_empty_table_and_chains(spark, tmp_path):
    assert simhash.near_duplicates(stored(spark, [], tmp_path / "d")).count() == 0
    chain = spark.createDataFrame([(i + 1, i) for i in range(50)] + [(5, 5), (None, 3)], "u long, v long")
    assert {(r["u"], r["v"]) for r in components(chain).collect()} == {(i, 0) for i in range(1, 51)}
