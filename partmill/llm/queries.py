"""One registered query per training-data operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sqltexts
from .block_naming import exact_groups
from .common import table
from .decontaminate import contamination
from .extendible_shards import assign_shards
from .host_rules import host_rules
from .mixing import mix
from .near_dedup import near_duplicates
from .pivot_clusters import centroid_digest, clusters
from .prefix_trie import prefix_trie
from .rlz_dedup import dedup_substrings, digest
from .secret_index import BASE_RULES, MORE_RULES, secret_report
from .subword_quality import quality
from .toxicity import toxicity
from .url_reputation import WIDE_SUFFIXES, filter_urls, outcomes_by_document

SHARD_BYTES = 16 << 20
NGRAM = 10
WINDOW = 35
CENTROIDS, ROUNDS = 40, 5


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return filter_urls(pages, outcomes_by_document(pages, labels))


def op2_rlz_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(dedup_substrings(table(spark, sf_dir, "documents"), WINDOW))


def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op5_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return assign_shards(docs, SHARD_BYTES).select("doc_id", "shard", "shard_depth", "doc_bytes", "shard_bytes", "shard_docs", "fits")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), NGRAM).drop("text_hash")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("k1", "k2")


def op11_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS)
    return found.withColumn("centroid_sha256", centroid_digest(found["centroid"])).drop("centroid")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).drop("failures")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_reputation": op1_url_reputation,
    "op2_rlz_substrings": op2_rlz_substrings,
    "op3_block_naming": op3_block_naming,
    "op4_trigram_secrets": op4_trigram_secrets,
    "op5_subword_quality": op5_subword_quality,
    "op6_extendible_shards": op6_extendible_shards,
    "op7_decontamination": op7_decontamination,
    "op8_source_mix": op8_source_mix,
    "op9_weak_toxicity": op9_weak_toxicity,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_pivot_clusters": op11_pivot_clusters,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_host_rules": op13_host_rules,
    "pipeline": pipeline,
}


def _secret_rules() -> list[tuple[str, str, int, int]]:
    rules = [("assign", sqltexts.SECRET_ASSIGN, 8, 1)]
    for rule in (BASE_RULES + MORE_RULES)[1:]:
        rules.append((rule.kind, rule.pattern.replace("'", "''"), rule.least, rule.group))
    return rules


ORACLES: dict[str, str] = {
    "op1_url_reputation": sqltexts.URLS % {"wide": ", ".join(f"'{s}'" for s in WIDE_SUFFIXES)},
    "op2_rlz_substrings": sqltexts.SUBSTRINGS % {"n": WINDOW},
    "op3_block_naming": sqltexts.EXACT,
    "op4_trigram_secrets": sqltexts.secrets(_secret_rules()),
    "op6_extendible_shards": sqltexts.SHARDS % {"limit": SHARD_BYTES},
    "op7_decontamination": sqltexts.DECONTAMINATE % {"n": NGRAM},
    "op8_source_mix": sqltexts.MIX,
    "op10_minhash_near_dedup": sqltexts.NEAR,
    "op11_pivot_clusters": sqltexts.pivot_clusters(CENTROIDS, ROUNDS),
    "op12_prefix_trie": sqltexts.TRIE,
    "op13_host_rules": sqltexts.HOST_RULES % {"wide": ", ".join(f"'{s}'" for s in WIDE_SUFFIXES)},
}
