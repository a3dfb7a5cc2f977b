import math
import random
from collections import Counter

import numpy as np
import pytest

from claimsweep.llm import topk


def plain(rows, k=20, every=20):
    """All scores of all pairs of rows, with exact integers."""
    good = [(i, [max(min(math.floor(64 * x), 9200000000000000000), -9200000000000000000) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return []
    n, length = max((n, length) for length, n in Counter(len(v) for _, v in good).items())
    good = [(i, v) for i, v in good if len(v) == length]
    out = []
    for at, (q, v) in enumerate(good):
        if q % every == 0:
            score = lambda w: min(max(sum(a * b for a, b in zip(v, w)), topk.LEAST), topk.MOST)
            scored = sorted((-score(w), i) for other, (i, w) in enumerate(good) if other != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], f"vec_id long, embedding array<{kind}>, score string")
    stored = [(x["vec_id"], x["embedding"]) for x in df.collect()]  # in the precision that is stored
    return sorted(map(tuple, topk.top_k(df, **options).collect())), stored


@pytest.mark.parametrize("size,dims,block", [(400, 8, 64), (90, 3, 1000), (15, 5, 4), (1, 2, 8), (0, 4, 8)])
def test_exact_top_k(spark, size, dims, block):
    r = random.Random(size)
    rows = [(i, [r.choice([r.gauss(0, 0.2), 0.0, 0.25]) for _ in range(dims)]) for i in range(size)]
    if size > 50:  # ties, copies, repeated ids, nulls, other lengths and what is not finite
        rows += [(1000 + i, rows[40][1]) for i in range(30)] + [(20, rows[3][1]), (None, rows[2][1]), (2000, None)]
        rows += [(2020, [float("nan")] * dims), (2021, [float("inf")] * dims), (2022, [None] * dims), (2040, [-0.0] * dims)]
        rows += [(40, rows[40][1]), (60, []), (80, [0.5]), (100, rows[40][1] + [1.0]), (1, rows[5][1])]
    got, stored = run(spark, rows, candidates=block, queries=7)
    assert got == plain(stored)


def test_rows_of_one_id_ask_and_are_found(spark):
    got, stored = run(spark, [(20, [1.0, 0.0]), (20, [0.5, 0.0]), (1, [0.25, 0.0])])
    assert got == plain(stored) and len(got) == 4


@pytest.mark.parametrize("large", [1e6, 1e9, 3e15, 1e30])
def test_large_components(spark, large):
    r = random.Random(1)
    rows = [(i, [r.choice([-1, 1]) * large * r.random(), r.gauss(0, 1), 3.0]) for i in range(60)] + [(100, [0.1, 0.2, 0.3])]
    got, stored = run(spark, rows, kind="double", k=7, candidates=25)
    assert got == plain(stored, 7)


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(900)] + [(1000 + i, [i / 100, 0.0, 1.0]) for i in range(60)]
    got, stored = run(spark, rows, k=5, candidates=200, queries=10)
    assert got == plain(stored, 5)


def test_few_vectors_are_read(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(0, 0.12, (4000, 64))
    whole = np.floor(64 * vectors)
    marks = topk.Cells(whole.min(axis=0).tolist(), whole.max(axis=0).tolist(), topk.CELLS)
    low, high = marks.bounds(whole[:20], *marks.unpack(marks.pack(whole)))
    exact = whole[:20] @ whole.T
    assert (low <= exact).all() and (exact <= high).all()
    left = [(high[i] >= topk._kth(low[i], 20)).sum() for i in range(20)]
    assert np.mean(left) < 0.1 * len(vectors)
