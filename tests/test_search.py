"""Searches that leave work out by bounds: the same hits as scoring everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsweep.operators import search


def tables(spark, seed, n_docs=300, n_queries=12):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(4000)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 80)))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[i % 7][1]) for i in range(9)] + [(n_docs + 20, None), (n_docs + 21, "")]
    asked = [(q, " ".join(r.choice(words) for _ in range(r.randint(1, 25)))) for q in range(n_queries)]
    asked += [(100, docs[3][1]), (101, "unseen words only"), (102, ""), (103, "w1")]
    return (spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string"))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 5), (3, 400)])
def test_keyword_hits_are_those_of_full_scores(spark, monkeypatch, seed, k):
    monkeypatch.setattr(search, "FIRST_POSTINGS", 40)
    queries, corpus = tables(spark, seed)
    full = search.keyword_scores(queries, corpus)
    order = [F.desc(F.round("score", 9)), "doc_id"]
    wanted = search.top_k(full.where("score > 0"), k, *order).select("query_id", "rank", "doc_id", F.bround("score", 4).alias("score"))
    assert rows(search.tfidf_search(queries, corpus, k)) == rows(wanted)


def test_common_terms_are_not_scored(spark):
    d = "/root/testdata/sf0.01"
    queries = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    terms, weights = search.keyword_terms(queries, spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    own = search.essential_terms(terms, weights, 5).where("essential")
    assert terms.join(own.select("query_id", "token"), "token").count() * 5 <= terms.join(weights, "token").count()


def nearest(corpus, queries, k, by):
    out = []
    for q, v, key in queries:
        if v is None:
            continue
        found = sorted((round(float(np.sqrt(((np.float32(v).astype(float) - np.float32(x).astype(float)) ** 2).sum())), 9), i)
                       for i, x, other in corpus if x is not None and (not by or key == other))
        out += [(q, n + 1, i) for n, (_, i) in enumerate(found[:k])]
    return sorted(out)


def vectors(seed, dims=6, n=500, centers=25, width=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, dims))
    corpus = [(i, (middle[i % centers] + width * rng.normal(size=dims)).tolist(), i % 3) for i in range(n)]
    corpus += [(n + i, corpus[5][1], 2) for i in range(6)] + [(n + 50, None, 1)]
    queries = [(q, corpus[11 * q][1], q % 4) for q in range(15)] + [(99, None, 0)]
    return corpus, queries


@pytest.mark.parametrize("by", ["filter_key", None])
@pytest.mark.parametrize("seed,k,pivots", [(1, 1, 16), (2, 10, 64), (3, 300, 3)])
def test_nearest_vectors(spark, by, seed, k, pivots):
    corpus, queries = vectors(seed)
    c = spark.createDataFrame(corpus, "doc_id int, vector array<float>, filter_key int")
    q = spark.createDataFrame(queries, "query_id int, vector array<float>, filter_key int")
    got = search.vector_topk(q, c, k, by, pivots).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in got) == nearest(corpus, queries, k, by)


def test_far_parts_are_not_met(spark):
    corpus, queries = vectors(4, n=2000)
    c = spark.createDataFrame(corpus, "doc_id int, vector array<float>, filter_key int")
    q = spark.createDataFrame(queries, "query_id int, vector array<float>, filter_key int")
    seen = search._vector_scores(q, c, 10, None, 64).count()
    assert seen < 0.3 * 15 * len(corpus)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "doc_id int, vector array<float>, filter_key int")
    asked = spark.createDataFrame([(1, [1.0], 1)], "query_id int, vector array<float>, filter_key int")
    assert search.vector_topk(asked, empty, 3).collect() == []
    assert search.vector_topk(asked.limit(0), empty.union(spark.createDataFrame([(1, [1.0], 1)], empty.schema)), 3).collect() == []
