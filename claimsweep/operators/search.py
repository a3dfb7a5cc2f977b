"""Keyword and vector search over clause and document tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import contains_any, tokenize
from ..rules import policies as P
from ..staging import stage


# ---------------------------------------------------------------- keyword search

def doc_frequency(corpus: DataFrame) -> DataFrame:
    """Number of documents containing each token; counts combine map-side."""
    return corpus.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token")).groupBy("token").agg(
        F.count("*").alias("df"))


def term_rows(texts: DataFrame, key: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(key, token, tf), cut to a vocabulary first where one is given; counts combine map-side."""
    tokens = texts.select(key, F.explode(tokenize(F.col("text"))).alias("token"))
    if vocabulary is not None:
        tokens = tokens.join(vocabulary, "token", "left_semi")
    return tokens.groupBy(key, "token").agg(F.count("*").alias("tf"))


def city_factor(query: Column, content: Column) -> Column:
    """Score factor for lodging clauses by the cities the query names."""
    cities = P.FIRST_TIER_CITIES
    asked = contains_any(query, cities)
    same = F.lit(False)
    for city in cities:
        same = same | (query.contains(city) & content.contains(city))
    return (
        F.when(asked, F.when(same, P.CITY_BOOST).otherwise(1.0))
        .when(content.contains(P.FALLBACK_PHRASE), P.FALLBACK_BOOST)
        .when(content.contains(P.LODGING_PHRASE) & contains_any(content, cities), P.FIRST_TIER_CUT)
        .otherwise(1.0))


def expand_city_query(city: Column) -> Column:
    """The fixed question asked when only a city is known."""
    before, after = P.LODGING_QUERY.split("{city}")
    return F.when(F.coalesce(city, F.lit("")) == "", "").otherwise(F.concat(F.lit(before), city, F.lit(after)))


def top_k(scored: DataFrame, k: int, *order) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Postings of a query's rarest terms that its first documents are taken from, and how many of these, times k.
FIRST_POSTINGS, FIRST_SCORED = 2000, 4
#: Room for rounding where bounds are compared with scores.
ROOM = 1e-6


def keyword_terms(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, token, tf)`` of the queries' vocabulary, and ``(query_id, token, w, bound, df)``.

    The corpus is read and tokenized once. A term adds w * (1 + ln tf) to a document's score, ``bound`` at most.
    Both tables are written: Spark knows their sizes and broadcasts what is small.
    """
    asked = term_rows(queries, "query_id").withColumnRenamed("tf", "qtf")
    terms = stage(term_rows(corpus, "doc_id", asked.select("token").distinct()), "search-terms")
    n = F.lit(corpus.count())
    seen = terms.groupBy("token").agg(F.count("*").alias("df"), F.max("tf").alias("most"))
    w = F.col("qtf") * (F.ln((n + 1) / (F.col("df") + 1)) + 1)
    weights = asked.join(seen, "token").select("query_id", "token", w.alias("w"), (w * (F.ln("most") + 1)).alias("bound"), "df")
    return terms, stage(weights, "search-weights")


def essential_terms(terms: DataFrame, weights: DataFrame, k: int, least: float = 1.0, most: float = 1.0) -> DataFrame:
    """Weights with ``essential`` and ``rest``, the bound of all terms of the query that are not essential.

    The documents that score best by a query's rarest terms are scored in full; the k-th best of them is a threshold
    that k documents reach. The most frequent terms whose bounds do not add up to it are not essential: a document
    that has no other term of the query is not among the first k. ``least`` and ``most`` bound a factor that scores
    are multiplied by later.
    """
    impact = F.sum(F.col("w") * (F.ln("tf") + 1)).alias("score")
    rare = W.partitionBy("query_id").orderBy("df", "token")
    first = weights.withColumn("before", F.sum("df").over(rare) - F.col("df")).where(F.col("before") < FIRST_POSTINGS)
    partial = terms.join(first.select("query_id", "token", "w"), "token").groupBy("query_id", "doc_id").agg(impact)
    best = stage(top_k(partial, FIRST_SCORED * k, F.desc("score"), "doc_id").select("query_id", "doc_id"), "search-first")
    whole = best.join(terms, "doc_id").join(weights.select("query_id", "token", "w"), ["query_id", "token"]).groupBy(
        "query_id", "doc_id").agg(impact)
    sure = top_k(whole, k, F.desc("score")).where(F.col("rank") == k).select("query_id", (F.col("score") * least).alias("sure"))
    common = W.partitionBy("query_id").orderBy(F.desc("df"), "token").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = weights.join(sure, "query_id", "left").withColumn(
        "essential", F.sum("bound").over(common) * most + ROOM >= F.coalesce("sure", F.lit(0.0)))
    rest = F.sum(F.when(~F.col("essential"), F.col("bound")).otherwise(0.0)).over(W.partitionBy("query_id"))
    return stage(marked.withColumn("rest", rest).withColumn("sure", F.coalesce("sure", F.lit(0.0))), "search-essential")


def keyword_scores(queries: DataFrame, corpus: DataFrame, k: int | None = None, least: float = 1.0,
                   most: float = 1.0) -> DataFrame:
    """(query_id, doc_id, score) for every document that can be among a query's first ``k`` (None: that shares a token).

    Documents are scored by a query's essential terms first. Those that could reach the threshold with all the rest
    meet the other terms; documents of common terms alone are never scored.
    """
    terms, weights = keyword_terms(queries, corpus)
    impact = F.sum(F.col("w") * (F.ln("tf") + 1))
    if k is None:
        return terms.join(weights, "token").groupBy("doc_id", "query_id").agg(impact.alias("score"))
    marked = essential_terms(terms, weights, k, least, most)
    own = marked.where("essential").select("query_id", "token", "w", "rest", "sure")
    partial = terms.join(own, "token").groupBy("doc_id", "query_id").agg(
        impact.alias("score"), F.first("rest").alias("rest"), F.first("sure").alias("sure"))
    able = stage(partial.where((F.col("score") + F.col("rest")) * most + ROOM >= F.col("sure")).select("doc_id", "query_id", "score"),
                 "search-able")
    other = able.select("doc_id", "query_id").join(terms, "doc_id").join(
        marked.where("not essential").select("query_id", "token", "w"), ["query_id", "token"])
    other = other.groupBy("doc_id", "query_id").agg(impact.alias("more"))
    return able.join(other, ["doc_id", "query_id"], "left").select(
        "doc_id", "query_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def tfidf_search(queries: DataFrame, corpus: DataFrame, k: int, adjust_city: bool = False) -> DataFrame:
    """``hits(query_id, rank, doc_id, score)``; equal scores keep corpus order (``ord``, else the id)."""
    order = "doc_id"
    if adjust_city:
        factors = (P.CITY_BOOST, P.FALLBACK_BOOST, P.FIRST_TIER_CUT, 1.0)
        scored = keyword_scores(queries, corpus, k, min(factors), max(factors))
        scored = (scored.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
                  .join(corpus.select("doc_id", "content", "ord"), "doc_id")
                  .withColumn("score", F.col("score") * city_factor(F.col("query_text"), F.col("content"))))
        order = "ord"
    else:
        scored = keyword_scores(queries, corpus, k)
    hits = top_k(scored.where("score > 0"), k, F.desc(F.round("score", 9)), order)
    return hits.select("query_id", "rank", "doc_id", F.bround("score", 4).alias("score"))


# ---------------------------------------------------------------- reranking

def city_tier(content: Column, city: Column) -> Column:
    return (F.when(content.contains(city), 0)
            .when(content.contains(P.FALLBACK_PHRASE) & ~city.isin(*P.FIRST_TIER_CITIES), 1).otherwise(2))


def city_rerank(hits: DataFrame) -> DataFrame:
    """Stable re-order of ``hits(query_id, rank, city, content, ...)``: same city, fallback clause, rest."""
    city = F.regexp_replace("city", "市$", "")
    tier = F.when(F.coalesce(city, F.lit("")) == "", 0).otherwise(city_tier(F.col("content"), city))
    w = W.partitionBy("query_id").orderBy("tier", "old_rank")
    return hits.withColumnRenamed("rank", "old_rank").withColumn("tier", tier).withColumn("rank", F.row_number().over(w))


def entity_rerank(hits: DataFrame, k: int = P.CLAUSES_KEPT) -> DataFrame:
    """Re-order by the cities that the query text or the claim's city mention, then cut to ``k``."""
    text = F.concat_ws(" ", F.coalesce("city", F.lit("")), F.coalesce("query_text", F.lit("")))
    own = F.regexp_replace(F.coalesce("city", F.lit("")), "市$", "")
    content = F.col("content")
    named = F.when(own != "", content.contains(own)).otherwise(False)
    any_mentioned, first_tier = own != "", own.isin(*P.FIRST_TIER_CITIES)
    for city in P.KNOWN_CITIES:
        said = text.contains(city)
        named = named | (said & content.contains(city))
        any_mentioned = any_mentioned | said
        if city in P.FIRST_TIER_CITIES:
            first_tier = first_tier | said
    tier = (F.when(~any_mentioned, 0).when(named, 0)
            .when(content.contains(P.FALLBACK_PHRASE) & ~first_tier, 1).otherwise(2))
    w = W.partitionBy("query_id").orderBy("tier", "old_rank")
    return (hits.withColumnRenamed("rank", "old_rank").withColumn("tier", tier)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


# ---------------------------------------------------------------- vector search

#: Vectors that stand for the parts of a corpus, and shares into which the rows of a part are dealt.
PIVOTS, SHARES = 64, 16


def _by_pivots(vectors: DataFrame, pivots, column: str) -> DataFrame:
    """Adds ``near``, the distances to all pivots."""
    import numpy as np
    import pandas as pd

    def measure(values):
        own = [np.asarray(v, float) for v in values]
        out = np.empty((len(own), len(pivots)))
        for j, p in enumerate(pivots):
            out[:, j] = [np.sqrt(((v - p) ** 2).sum()) for v in own] if len({len(v) for v in own}) > 1 else np.sqrt(
                ((np.stack(own) - p) ** 2).sum(axis=1))
        return pd.Series(list(out))

    measure.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return vectors.withColumn("near", F.pandas_udf(measure, "array<double>")(F.col(column)))


def pivot_parts(corpus: DataFrame, pivots: int = PIVOTS, filter_on: str | None = "filter_key") -> tuple[DataFrame, list]:
    """The corpus with ``part``, the number of its nearest pivot, and ``off``, the distance to it; and the pivots.

    Pivots are the vectors with the smallest hashes of their ids: so many at most, whatever the corpus holds.
    """
    import numpy as np

    corpus = corpus.where(F.col("vector").isNotNull())
    chosen = corpus.select("vector").orderBy(F.xxhash64("doc_id")).limit(pivots).collect()
    at = [np.asarray(r["vector"], float) for r in chosen]
    keys = [filter_on] if filter_on else []
    measured = _by_pivots(corpus.select("doc_id", "vector", *keys), at, "vector")
    off = F.array_min("near")
    return stage(measured.select("doc_id", "vector", *keys, (F.array_position("near", off) - 1).cast("int").alias("part"), off.alias("off")),
                 "vector-parts"), at


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = P.RERANK_POOL, filter_on: str | None = "filter_key",
                pivots: int = PIVOTS) -> DataFrame:
    """Exact nearest vectors per query among the rows its metadata filter admits; lower is better.

    ``queries(query_id, vector, <filter>)`` and ``corpus(doc_id, vector, <filter>)``; vectors have one length, null
    ones take no part; without a filter every query searches the whole corpus. The corpus is dealt to its nearest pivots.
    The nearest parts that hold k vectors give a distance that the k-th best cannot pass. By the triangle inequality
    parts, and single vectors, whose distance to their pivot puts them beyond it are not met.
    """
    hits = top_k(_vector_scores(queries, corpus, k, filter_on, pivots), k, F.round("distance", 9), "doc_id")
    return hits.select("query_id", "rank", "doc_id", F.bround("distance", 4).alias("score"))


def _vector_scores(queries: DataFrame, corpus: DataFrame, k: int, filter_on: str | None, pivots: int) -> DataFrame:
    """(query_id, doc_id, distance) of the vectors that a query has to look at."""
    import numpy as np
    import pandas as pd

    keys = [filter_on] if filter_on else []
    own, at = pivot_parts(corpus, pivots, filter_on)
    parts = stage(own.groupBy(*keys, "part").agg(F.count("*").alias("n"), F.min("off").alias("nearest"), F.max("off").alias("farthest")),
                  "vector-part-sizes")
    asked = _by_pivots(queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").alias("q"), *keys), at, "q")
    spread = asked.select("query_id", "q", *keys, F.posexplode("near").alias("part", "d"))
    met = stage(spread.join(parts, [*keys, "part"]).withColumn(
        "within", F.greatest(F.lit(0.0), F.col("d") - F.col("farthest"), F.col("nearest") - F.col("d"))), "vector-parts-met")
    dealt = own.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int"))

    def apart(left, right):
        a, b = left.tolist(), right.tolist()
        same = len({len(x) for x in a} | {len(x) for x in b}) == 1
        if same:
            return pd.Series(np.sqrt(((np.stack(a).astype(float) - np.stack(b).astype(float)) ** 2).sum(axis=1)))
        raise ValueError("vectors of one length are needed")

    apart.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.Series}
    def distances(visits: DataFrame) -> DataFrame:
        shared = visits.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        pairs = shared.join(dealt, [*keys, "part", "share"])
        if "sure" in visits.columns:
            pairs = pairs.where(F.col("sure").isNull() | (F.abs(F.col("d") - F.col("off")) <= F.col("sure") + ROOM))
        return pairs.select("query_id", "doc_id", F.pandas_udf(apart, "double")(F.col("q"), F.col("vector")).alias("distance"))

    # the nearest parts that hold k vectors: the k-th best of these is a distance that the k-th best of all cannot pass
    upto = W.partitionBy("query_id").orderBy("d", "part").rowsBetween(W.unboundedPreceding, W.currentRow)
    nearest = met.withColumn("before", F.sum("n").over(upto) - F.col("n")).where(F.col("before") < k).drop("before")
    sure = top_k(distances(nearest), k, "distance", "doc_id").where(F.col("rank") == k).select("query_id", F.col("distance").alias("sure"))
    visits = met.join(sure, "query_id", "left").where(F.col("sure").isNull() | (F.col("within") <= F.col("sure") + ROOM))
    return distances(stage(visits, "vector-visits"))


def sparse_scores(queries: DataFrame, corpus: DataFrame, filter_on: str | None = "filter_key") -> DataFrame:
    """Inner product of sparse vectors, given as ``map<int,double>``, over shared entries only."""
    keys = [filter_on] if filter_on else []
    q = queries.select("query_id", *keys, F.explode("sparse").alias("dim", "qw"))
    d = corpus.select("doc_id", *keys, F.explode("sparse").alias("dim", "dw"))
    return q.join(d, [*keys, "dim"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("product"))


def hybrid_topk(queries: DataFrame, corpus: DataFrame, k: int, sparse_weight: float, filter_on: str | None = "filter_key") -> DataFrame:
    """Weighted fusion of a dense and a sparse candidate pool of ``max(3k, 10)`` each.

    Each side is scaled to 0..1 over its own pool (best = 1; a pool of equal values counts 1), a
    candidate missing from a side scores 0 there. Weight 0 means dense only.
    """
    if sparse_weight <= 0:
        return vector_topk(queries, corpus, k, filter_on)
    pool = max(3 * k, 10)
    dense = vector_topk(queries, corpus, pool, filter_on).select("query_id", "doc_id", F.col("score").alias("v"))
    sparse = top_k(sparse_scores(queries, corpus, filter_on), pool, F.desc(F.round("product", 9)), "doc_id").select(
        "query_id", "doc_id", F.bround("product", 4).alias("v"))
    w = W.partitionBy("query_id")

    def scaled(side, best, worst, name):
        span = best - worst
        value = F.when(span == 0, 1.0).otherwise((F.col("v") - worst) / span)
        return side.select("query_id", "doc_id", value.alias(name))

    d = scaled(dense, F.min("v").over(w), F.max("v").over(w), "dense")
    s = scaled(sparse, F.max("v").over(w), F.min("v").over(w), "sparse")
    fused = d.join(s, ["query_id", "doc_id"], "full").select(
        "query_id", "doc_id",
        (F.coalesce("dense", F.lit(0.0)) + F.lit(sparse_weight) * F.coalesce("sparse", F.lit(0.0))).alias("fused"))
    hits = top_k(fused, k, F.desc(F.round("fused", 9)), "doc_id")
    return hits.select("query_id", "rank", "doc_id", F.bround("fused", 4).alias("score"))
