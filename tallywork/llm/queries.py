"""The named queries of the operators, each over its whole table, with the columns that a digest comparison needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, lexical_search, line_dedup, mixing, ngram_model, prefix_trie, quality, secrets,
               sharding, simhash, substrings, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SHARDS = 40


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op1_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                      F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.covered_words(F.col("spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        sha256(F.concat_ws(",", F.sort_array("items"))).alias("items_sha256"),
                        (hit > 0).alias("contaminated"), F.size("near_items").cast("bigint").alias("n_near_items"))


@query
def op3_perfect_hash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


@query
def op4_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        sha256(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        count("guess").alias("n_guess"))


@query
def op5_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


@query
def op6_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha256(F.col("text")).alias("kept_sha256"))


@query
def op8_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query
def op9_bloom_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.scored(table(spark, sf_dir, "documents"))


@query
def op10_digest_array_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


@query
def op11_block_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"), group=100, heads=6)
    return out.withColumnRenamed("saved", "saved_tokens")


@query
def op12_shared_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query
def op13_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
