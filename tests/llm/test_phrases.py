import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, awkward

from claimsweep.llm import phrases
from claimsweep.llm.bloom import Bloom, bloom


def plain(rows, top=2000, least=30, percent=80):
    """The definition over (text, lang) rows, in memory."""
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in many.items():
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(100 * b >= percent * a for q, b in many.items() if len(q) > len(p)
                       and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def table(spark, rows):
    full = [(i, t, lang, "a", None, "x", "y", "z", "c", "s", "w") for i, (t, lang) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def texts(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Ünï", "日本", "W3", "a\x1cb", "\x00"]
    sayings = [" ".join(r.choice(words) for _ in range(r.randint(2, 6))) for _ in range(8)]
    rows = []
    for _ in range(500):
        parts = [r.choice(sayings) if r.random() < 0.4 else r.choice(words) for _ in range(r.randint(1, 40))]
        text = "".join(p + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"]) for p in parts)
        rows.append((text, r.choice(["en", "en", "en", None, "und", "日本", ""])))
    return rows + rows[:40] + [(None, "en"), ("", "en"), (None, None), ("only one", "xx"), ("a b " * 20000, "long")]


@pytest.mark.parametrize("seed,least,top", [(1, 30, 2000), (2, 5, 40)])
def test_against_the_definition(spark, seed, least, top):
    rows = texts(seed)
    got = sorted(map(tuple, phrases.collocations(table(spark, rows), top, least).collect()))
    assert got == plain(rows, top, least)


def test_awkward_and_empty_tables(spark):
    rows = [(t, s) for _, t, *rest in awkward() for s in [rest[0] if rest else None]]
    assert sorted(map(tuple, phrases.collocations(table(spark, rows), 2000, 2).collect())) == plain(rows, 2000, 2)
    assert phrases.collocations(table(spark, [])).collect() == []
    assert phrases.collocations(table(spark, [(None, None), ("", "a"), ("b", "a")])).collect() == []


class Everything:
    def __contains__(self, key):
        return True

    def has(self, keys):
        return np.ones(len(keys), bool)


def test_trie_bursts_and_writes_whole_subtrees(monkeypatch):
    monkeypatch.setattr(phrases, "RUNS", 500)
    monkeypatch.setattr(phrases, "BURST", 8)
    monkeypatch.setattr(phrases, "WORDS", 160)
    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.8)) % 90}".encode() for _ in range(30000)]
    docs = [words[i:i + 300] for i in range(0, len(words), 300)]
    for length in (2, 3, 4):
        counting = phrases._Counting("en", (length,), Everything(), Everything(), 7)
        batches, burst = [], False
        for doc in docs:
            batches += counting.feed(doc)
            burst |= not isinstance(counting.tries[length].root, phrases.Container)
            while counting.size() > 300:
                batches += counting.shrink()
        assert burst
        batches += counting.rest()
        merged = Counter()
        parts = {}
        for batch in batches:
            for part, run in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist()):
                rows, counts = phrases._unpacked(run, length)
                assert [tuple(x) for x in rows.tolist()] == sorted(map(tuple, rows.tolist()))  # a sorted run
                parts.setdefault(part, []).append(run)
        for runs in parts.values():
            rows, counts = phrases._merge(runs, length, 3)
            for row, n in zip(rows.tolist(), counts.tolist()):
                assert tuple(row) not in merged  # a phrase is in one partition
                merged[tuple(row)] = n
        assert counting.step < 80  # texts were cut into parts
        names = {w: phrases.word_hash(w) for w in set(words)}
        expected = Counter(tuple(names[w] for w in doc[i:i + length]) for doc in docs for i in range(len(doc) - length + 1))
        assert merged == Counter({p: n for p, n in expected.items() if n >= 3})


def test_trie_counts_as_a_dict():
    r = np.random.default_rng(0)
    for length in (2, 3, 4):
        trie, expected = phrases.HatTrie(length, 5), Counter()
        for _ in range(50):
            ids = r.integers(1, 9, 300)
            runs, counts = np.unique(phrases.packed_ids(ids, np.arange(300 - length + 1), length), return_counts=True)
            trie.add(runs, counts)
            expected.update(tuple(ids[i:i + length].tolist()) for i in range(300 - length + 1))
        assert trie.size == len(expected)
        taken = trie.take(100)
        assert trie.size <= 100
        left = trie.take(-1)
        names = np.arange(10).astype(np.uint64)
        got = Counter()
        for runs, counts in (taken, left):
            for row, n in zip(*phrases._sorted_run(runs, counts, length, names)):
                got[tuple(row.tolist())] += int(n)
        assert got == expected and trie.size == 0


def test_filter_has_all_its_keys_and_few_others(spark):
    keys = [(i * 7919 - 10**17,) for i in range(20000)]
    found = Bloom(bloom(spark.createDataFrame(keys, "k long").repartition(3)).value)
    own = np.array([k for k, in keys], np.int64).view(np.uint64)
    assert found.has(own).all() and all(int(k) in found for k in own[:200])
    other = own + np.uint64(1)
    assert found.has(other).mean() < 0.01
    assert [int(k) in found for k in other[:500]] == found.has(other[:500]).tolist()
    assert not Bloom(bloom(spark.createDataFrame([], "k long")).value).has(own).any()
