"""Sharding, mixing, quality rules and licenses on awkward tables, against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import awkward, stored
from pyspark.sql import functions as F

from claimsweep.llm import licenses, mixing, quality, sharding


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_shards_are_contiguous_and_balanced(spark, tmp_path):
    rows = awkward()
    got = sharding.shard_by_bytes(stored(spark, rows, tmp_path / "d"), n_shards=5).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    total, start = sum(size(t) for _, t, *_ in rows), 0
    slots = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        assert r["shard"] == start * 5 // total
        start += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(s == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(stored(spark, [], tmp_path / "e")).count() == 0


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rate = (goal - sum(fixed.values())) / max(sum(weight[s] for s in free), 1e-9)
        over = [s for s in free if rate * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: rate * weight[s] for s in free}
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("weight", [None, "n_chars"])
def test_mixture_meets_targets(spark, tmp_path, weight):
    rows = awkward() + [(1000 + i, "a b c " * (i % 9), "dominant") for i in range(300)]
    docs = stored(spark, rows, tmp_path / "d")
    got = mixing.mix(docs, weight_col=weight).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    goals, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert r["size"] * 2 >= r["taken"] and r["taken"] == r["copies"] * r["size"]
        assert r["target"] == pytest.approx(goals[r["source"]])
        taken[r["source"]] += r["taken"]
    if weight is None:
        for s, goal in goals.items():
            assert abs(taken[s] - goal) <= max(r["size"] for r in got if r["source"] == s) / 2 + 1e-6
    again = mixing.mix(docs, weight_col=weight).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    copies = mixing.take(docs, weight_col=weight)
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in got)
    assert mixing.mix(stored(spark, [], tmp_path / "e")).count() == 0


def test_weights_by_length_meet_targets_and_change_odds(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, "w " * r.choice([2, 30, 60, 200]), r.choice(["a", "a", "a", "b", None])) for i in range(3000)]
    docs = stored(spark, rows, tmp_path / "d").withColumn("w", mixing.middle_length(F.col("text")))
    for share in (0.4, 1.5):
        got = mixing.mix(docs, share=share, weight_col="w").collect()
        sizes, taken, copies = defaultdict(int), defaultdict(int), defaultdict(list)
        for x in got:
            sizes[x["source"]] += x["size"]
            taken[x["source"]] += x["taken"]
            copies[x["source"], 50 <= x["size"] <= 1000].append(x["copies"])
        for source, goal in plain_targets(sizes, share=share).items():
            assert abs(taken[source] - goal) <= 100
            if goal < 1.2 * sizes[source]:  # not all taken twice
                more, less = (sum(copies[source, k]) / len(copies[source, k]) for k in (True, False))
                assert more / less == pytest.approx(2, rel=0.2)


def test_likelier_documents_are_drawn_more_often(spark, tmp_path):
    rows = [(i, "a b", "s" if i % 2 else "t") for i in range(4000)]
    docs = stored(spark, rows, tmp_path / "d").selectExpr("doc_id", "text", "source", "if(doc_id % 4 < 2, 3.0, 1.0) as w")
    got = mixing.mix(docs, share=0.4, weights=(1.0,), weight_col="w").groupBy((mixing.F.col("doc_id") % 4 < 2).alias("k")).sum("copies")
    drawn = {r["k"]: r["sum(copies)"] for r in got.collect()}
    assert drawn[True] / drawn[False] == pytest.approx(3, rel=0.25) and sum(drawn.values()) == 1600  # sources of one size share alike


def test_sources_of_empty_texts_take_nothing(spark, tmp_path):
    rows = [(1, "", "a"), (2, None, "a"), (3, "", "b"), (4, "x y z", "b"), (5, "x y z", "b"), (6, "", None)]
    docs = stored(spark, rows, tmp_path / "d").selectExpr("doc_id", "text", "source", "if(doc_id = 3, 1.5D, 1.0D) as w")
    for weight in (None, "w"):
        got = {r["doc_id"]: r for r in mixing.mix(docs, weight_col=weight).collect()}
        assert len(got) == 6 and all(got[i]["taken"] == 0 for i in (1, 2, 3, 6)) and got[1]["target"] == 0
        assert got[4]["taken"] + got[5]["taken"] == 9


def plain_rules(rows, limit, left):
    seen = defaultdict(set)
    norm = lambda x: " ".join(words("".join(c.lower() if "A" <= c <= "Z" else c for c in x)))
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if words(x):
                seen[s, norm(x)].add(t)
    out = []
    for i, t, s in rows:
        t = t or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
        hit = {k for j in range(len(w) - 7) if grams[tuple(w[j:j + 8])] > 1 for k in range(j, j + 8)}
        gone = sum(len(words(x)) for x in lines if len(seen[s, norm(x)]) > limit)
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed,
                    len(w) - gone, not failed and 100 * (len(w) - gone) >= left * len(w)))
    return out


def test_quality_rules_against_plain_python(spark, tmp_path):
    body = " ".join(f"v{i}" for i in range(30))
    rows = awkward() + [(200 + i, f"Shared  LINE of the\thost\nown {i} words\n{body} {i}", "h") for i in range(6)]
    rows += [(300 + i, "shared line of the host\n" * 12 + f"x{i} " * 3, "h") for i in range(3)]
    rows += [(400, "q " * 9 + "# | <>", "a"), (401, "\n".join([body] * 3 + ["tail"]), None)] + [(500 + i, f"copy\n{body}", "h") for i in range(9)]
    docs = stored(spark, rows, tmp_path / "d")
    got = quality.apply_rules(docs, line_limit=5)
    assert Counter(map(tuple, got.collect())) == Counter(plain_rules(rows, 5, quality.LEAST_LEFT))
    good = quality.keep_good(docs, line_limit=5)
    assert good.columns == docs.columns
    assert Counter(r["doc_id"] for r in good.collect()) == Counter(r["doc_id"] for r in got.where("kept").collect())
    cut = {r["doc_id"]: r["text"] for r in quality.without_common_lines(docs, line_limit=5).collect()}
    assert cut[200] == f"own 0 words\n{body} 0" and cut[500] == f"copy\n{body}" and cut[100] is None
    assert quality.apply_rules(stored(spark, [], tmp_path / "e")).count() == 0


def plain_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    spots = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in spots]
    return len(w), len(spots), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in spots}))


def test_license_scan(spark, tmp_path):
    mit = licenses.TEMPLATES["mit"][0]
    noisy = " ".join(x + (" really" if i % 25 == 24 else "") for i, x in enumerate(mit.split()))
    rows = awkward() + [(600, "cc by CC-BY cc by", "a"), (601, "The MIT\nLicense, the mit license; GNU General  public license"), (602, "before " * 50 + mit),
                        (603, noisy), (604, mit[:120]), (605, "Permission is hereby granted"), (606, "transmit license submit licenses"), (607, "Ümit license mit licenses")]
    docs = stored(spark, rows, tmp_path / "d")
    out, spans = licenses.scan(docs)
    got = out.collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter(
        (r[0], *plain_base(r[1])) for r in rows)
    by = {r["doc_id"]: r for r in got}
    assert by[602]["labels"] == "mit" and by[602]["base_labels"] == "" and by[602]["score"] == pytest.approx(1.0)
    assert by[603]["labels"] == "mit" and by[604]["labels"] == "" and by[605]["labels"] == ""
    span = [r for r in spans.collect() if r["doc_id"] == 602][0]
    assert (span["first_word"], span["last_word"]) == (50, 50 + plain_base(mit)[0] - 1)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(stored(spark, [], tmp_path / "e"))[0].count() == 0
