"""Lines of a group of near copies, lines of large hosts, and boilerplate that the quality stage takes out."""

import random

import corpus_pipeline
import pytest
from helpers import stored
from pyspark.sql import functions as F

from claimsweep.llm import quality


def lines(r, n, words=14):
    return [" ".join(f"w{r.randrange(5000)}" for _ in range(words)) for _ in range(n)]


def test_near_copies_do_not_make_each_other_boilerplate(spark, tmp_path):
    r, whole = random.Random(1), lines(random.Random(2), 8)
    rows = []
    for i in range(60):  # a group with one edit in each copy
        copy = [x.split() for x in whole]
        copy[r.randrange(8)][r.randrange(14)] = f"edit{i}"
        rows.append((i, "\n".join(map(" ".join, copy)), "a"))
    rows += [(100 + i, "\n".join(["All rights  RESERVED here", *lines(r, 6)]), "a") for i in range(40)]
    rows += [(200 + i, "\n".join([f"Only {i} of it", "all rights reserved here " * 30]), "a") for i in range(3)]
    docs = stored(spark, rows, tmp_path / "d")
    got = {x["doc_id"]: x["text"] for x in quality.keep_good(docs).collect()}
    assert {i: got.get(i) for i in range(60)} == {i: t for i, t, _ in rows[:60]}
    assert {100 + i for i in range(40)} <= set(got)


def test_lines_are_judged_by_their_share_of_a_host(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, "\n".join((["rare but shared"] if i < 30 else []) + (["in one of ten texts"] if i % 10 == 0 else []) + lines(r, 4, 10)), "a")
            for i in range(1000)]
    got = {x["doc_id"]: x["text"] for x in quality.keep_good(stored(spark, rows, tmp_path / "d")).collect()}
    assert len(got) == 1000
    assert sum("rare but shared" in t for t in got.values()) == 30
    assert not any("in one of ten" in t for t in got.values())


def test_quality_stage_takes_boilerplate_out(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, "\n".join(["All rights  RESERVED", *lines(r, 5), "", "all rights reserved"]), None) for i in range(40)] + [(90, None, None)]
    docs = stored(spark, rows, tmp_path / "d")
    out = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert {x["doc_id"]: x["text"] for x in out.collect()} == {
        i: "\n".join(x for x in t.split("\n") if x.lower().split() != ["all", "rights", "reserved"]) for i, t, _ in rows[:40]}


@pytest.mark.parametrize("n", [20, 60, 120, 400])
def test_links_of_near_copies_do_not_hang_on_length(spark, n):
    r, rows = random.Random(n), []
    for i in range(250):
        words = [f"w{r.randrange(50000)}" for _ in range(n)]
        copy = [f"x{j}" if j % 15 == 7 else w for j, w in enumerate(words)]
        rows.append((" ".join(words), " ".join(copy), " ".join(f"w{r.randrange(50000)}" for _ in range(n))))
    band = lambda c: quality.near_bands(quality.words_of(F.col(c)))
    got = spark.createDataFrame(rows, "a string, b string, c string").select(
        F.arrays_overlap(band("a"), band("b")).cast("int").alias("near"), F.arrays_overlap(band("a"), band("c")).cast("int").alias("far"))
    near, far = got.agg(F.avg("near"), F.avg("far")).first()
    assert near >= 0.9 and far < 0.01
