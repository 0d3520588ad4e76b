"""The corpus pipeline: clean documents in, shards of a mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of
the next one. All but the last return the columns of ``documents``. A stage works on everything its predecessor kept:

1. quality: line-first cleaning; rejected documents go, failing lines of kept ones go.
2. near_dedup: groups of SimHash fingerprints (three-word shingles) that link at 3 or fewer differing bits; the document
   with the smallest id of each stays.
3. decontaminate: documents with a benchmark window go.
4. mix: each document as many times as the mix takes it.
5. shard: K-d tree shards; one row per document with its shard and slot.

Defined cases, in every stage: a NULL text is empty, NULL ids and sources are values of their own, rows with one id are judged
apart by their texts, an empty table gives an empty one, texts of any length are whole, and columns of any other name pass
through. A stage's own tables are dropped when the next stage is called, since its result is written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywork.llm import decontaminate, mixing, quality, sharding, simhash
from tallywork.sources.store import Store

SHARDS = 40


_held: dict[str, Store] = {}


def _store(spark: SparkSession, stage: str, before: str | None = None) -> Store:
    """The store of a stage's own tables. Those of the stage before are done with."""
    if before in _held:
        _held.pop(before).close()
    _held[stage] = Store(spark)
    return _held[stage]


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs, _store(spark, "near_dedup"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
                                         _store(spark, "decontaminate", "near_dedup"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, _store(spark, "mix", "decontaminate"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, shards=SHARDS, store=_store(spark, "shard", "mix"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", clean_lines), ("near_dedup", near_dedup), ("decontaminate", drop_contaminated), ("mix", mix),
    ("shard", shard)]

# The SimHash of a text needs XXH64 with a seed, which DuckDB has not; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written under the shared folder until the next ones are."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        now = Store(spark)
        docs = now.save(f"stage_{name}", stage(spark, docs, sf_dir)).df
        if before:
            before.close()
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
