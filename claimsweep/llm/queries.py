"""The operators as queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, cotraining, licenses, mixing, oracles, overlap, phrases, pieces, quality, sharding, simhash, tokens, topk, toxicity
from .common import fresh, read_table


def near_duplicates(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def shards(spark, sf_dir):
    return sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"))


def token_counts(spark, sf_dir):
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"))


def quality_rules(spark, sf_dir):
    return quality.apply_rules(read_table(spark, sf_dir, "documents"))


def quality_classifier(spark, sf_dir):
    return cotraining.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def mixture(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    weight = fresh(docs, "length_weight")
    docs = docs.withColumn(weight, mixing.middle_length(F.col("text")))
    return mixing.mix(docs, weight_col=weight).select("doc_id", "size", "source_size", "target", "taken")


def toxicity_scores(spark, sf_dir):
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def exact_search(spark, sf_dir):
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def license_labels(spark, sf_dir):
    return licenses.scan(read_table(spark, sf_dir, "documents"))[0]


def piece_encodings(spark, sf_dir):
    """Digests of the n best encodings; the texts' ids stay with the operator."""
    e = pieces.encode_documents(read_table(spark, sf_dir, "documents"))
    return e.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "score",
        F.transform("others", lambda o: o["score"]).alias("next_scores"), "round_trip")


def similar_documents(spark, sf_dir):
    return overlap.similar_documents(read_table(spark, sf_dir, "documents"))


def phrase_collocations(spark, sf_dir):
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def aligned_tokens(spark, sf_dir):
    """Digests of the groups; the groups themselves stay with the operator."""
    e = alignment.align(read_table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return e.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES = {
    "op1_simhash": near_duplicates,
    "op2_sharding": shards,
    "op3_token_counts": token_counts,
    "op4_quality_rules": quality_rules,
    "op5_quality_classifier": quality_classifier,
    "op6_mixing": mixture,
    "op7_toxicity": toxicity_scores,
    "op8_exact_top_k": exact_search,
    "op9_licenses": license_labels,
    "op10_sentencepiece": piece_encodings,
    "op11_jaccard_join": similar_documents,
    "op12_collocations": phrase_collocations,
    "op13_alignment": aligned_tokens,
}
ORACLES = {
    "op2_sharding": oracles.sharding(),
    "op4_quality_rules": oracles.quality(),
    "op6_mixing": oracles.mixing(),
    "op8_exact_top_k": oracles.top_k(),
    "op9_licenses": oracles.licenses(),
    "op12_collocations": oracles.collocations(),
}
