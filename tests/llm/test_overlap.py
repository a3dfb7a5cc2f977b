import itertools
import random

import numpy as np
import pytest
from helpers import awkward, stored

from claimsweep.llm import overlap
from claimsweep.llm.queries import QUERIES


def plain_set(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def plain(rows, percent=90, k=3):
    """(id, size, component, copies) by comparing all pairs."""
    sets = [plain_set(t, k) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(top(i), []).append(rows[i][0])
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [x for x in members[top(i)] if x is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None, sum(x == sets[i] for x in sets) if sets[i] else 1))
    return sorted(out, key=str)


def copies(seed, groups=12, members=9, length=(3, 90), edits=4):
    """Texts with near copies: words replaced, added, cut or said twice."""
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"w{r.randrange(400)}" for _ in range(r.randint(*length))]
        for m in range(members):
            own = list(words)
            for _ in range(r.randint(0, edits)):
                at = r.randrange(len(own))
                own[at:at + r.randint(0, 1)] = [f"x{r.randrange(10**6)}"] * r.randint(0, 2)
                own = own or ["a"]
            rows.append((1000 + 37 * len(rows) % 9973, " ".join(own).upper() if m % 3 == 0 else "\n ".join(own)))
    return rows


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("percent,k,seed", [(90, 3, 1), (50, 2, 3), (100, 3, 5)])
def test_against_all_pairs(spark, tmp_path, percent, k, seed):
    rows = copies(seed) + copies(seed + 50, 4, 20, (100, 300), 8) + awkward(seed)
    docs = stored(spark, rows, tmp_path / "d")
    assert result(overlap.similar_documents(docs, percent, k)) == plain(rows, percent, k)


@pytest.mark.parametrize("crowded,block_docs", [(0, 512), (2, 4)])
def test_crowds_and_blocks(spark, tmp_path, monkeypatch, crowded, block_docs):
    monkeypatch.setattr(overlap, "CROWDED", crowded)
    monkeypatch.setattr(overlap, "BLOCK_DOCS", block_docs)
    # chains of links around the threshold: many are near their group, few of these are linked to one another
    rows = copies(7, 3, 60, (60, 80), 5) + copies(8, 3, 10, (20, 40), 2)
    docs = stored(spark, rows, tmp_path / "d")
    assert result(overlap.similar_documents(docs)) == plain(rows)


def test_query_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(QUERIES["op11_jaccard_join"](spark, "/root/testdata/sf0.001")) == plain(rows)


def test_empty_and_only_empty(spark, tmp_path):
    assert overlap.similar_documents(stored(spark, [], tmp_path / "a")).collect() == []
    rows = [(1, None), (2, ""), (2, " "), (None, ""), (3, "one"), (4, "ONE"), (5, "one two")]
    assert result(overlap.similar_documents(stored(spark, rows, tmp_path / "b"))) == plain(rows)


def test_linked_sets_share_an_entry():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        n, percent = int(rng.integers(1, 400)), int(rng.choice([70, 80, 90, 95]))
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        cut = base[rng.random(len(base)) > rng.random() * (100 - percent) / 100]
        other = np.unique(np.concatenate([cut, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n * (100 - percent) // 100))).astype(np.uint64)]))
        shared = len(np.intersect1d(base, other))
        if shared and not np.array_equal(base, other) and 100 * shared >= percent * (len(base) + len(other) - shared):
            assert len(np.intersect1d(overlap.entries(base, percent), overlap.entries(other, percent)))


def test_matrix_of_overlaps(monkeypatch):
    monkeypatch.setattr(overlap, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 30))).astype(np.uint64)) for _ in range(25)]
    out = overlap._matrix(sets[:10], sets[10:])
    assert all(out[i, j] == len(np.intersect1d(sets[i], sets[10 + j])) for i in range(10) for j in range(15))
