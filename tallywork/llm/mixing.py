"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every document has a fixed 60-bit hash of its id. Sizes are summed by source and hash bucket; the bucket in which the
running sum passes the budget is the boundary, and only its rows are summed again over finer buckets. The resulting
threshold per source selects documents with a filter, without a sort. Larger budgets give larger thresholds, so the
selections are nested.

Defined cases: a NULL text has no words. A NULL source is a source of its own, last in order. A NULL id hashes as the
empty text. Documents with one hash (repeated ids) are taken together. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import row_numbers
from ..sources.store import Store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def id_hash(key: Column) -> Column:
    """The first 60 bits of the id's MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(store: Store, sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target). Targets stop at ``repeats`` times the size; the excess goes to the other sources
    by weight, round after round, until none is above."""
    sums = store.save("mix_sources", sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ordered = row_numbers(store, "mix_order", sums, [F.col("source").asc_nulls_last()], "_no")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    table = store.save("mix_weights", ordered.select(
        "source", "source_size", F.element_at(turn, ((F.col("_no") - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * repeats).alias("most"))).df
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.col("most") < F.col("weight") * F.lit(level)
        now, held, rest = table.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)),
                                    F.sum(F.when(~over, F.col("weight")))).first()
        if now == capped or not rest:
            break
        capped, level = now, (budget - held) / rest
    share_of = F.col("weight") * F.lit(level)
    target = F.when(F.col("most") < share_of, F.col("most").cast("double")).otherwise(share_of)
    return table.select("source", "source_size", target.alias("target"))


def _same(left: str, right: str = "_source") -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def thresholds(store: Store, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``whole`` (times that every document of the source is taken) and ``below``: documents with a
    smaller hash are taken once more."""
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("bigint")
    plan = store.save("mix_plan", targets.withColumn("whole", whole).withColumn("want", target - whole * size)).df
    state = plan.where("want > 0").select(F.col("source").alias("_source"), "want", F.lit(0).cast("bigint").alias("at"),
                                          F.lit(0).cast("bigint").alias("base"))
    shift = HASH_BITS
    while True:
        inside = sized.join(state, _same("source")).where(F.shiftright("h", shift) == F.col("at"))
        shift -= LEVEL_BITS
        tally = inside.groupBy("_source", "want", "base", F.shiftright("h", shift).alias("at")).agg(
            F.sum("size").alias("s"), F.count_if(F.col("size") > 0).alias("docs"))
        upto = F.sum("s").over(Window.partitionBy("_source").orderBy("at"))
        passed = tally.withColumn("upto", F.col("base") + upto).where("upto > want and upto - s <= want")
        saved = store.save("mix_boundary", passed.select("_source", "want", "at", (F.col("upto") - F.col("s")).alias("base"),
                                                         "s", "docs"))
        state = saved.df.select("_source", "want", "at", "base")
        if not shift or (saved.df.agg(F.max("docs")).first()[0] or 0) <= 1:
            break
    nearer = (2 * (F.col("want") - F.col("base")) >= F.col("s")).cast("bigint")
    ends = saved.df.select("_source", F.shiftleft(F.col("at") + nearer, shift).alias("below"))
    joined = plan.join(ends, _same("source"), "left")
    return store.save("mix_thresholds", joined.select("source", "source_size", "target", "whole",
                                                      F.coalesce("below", F.lit(0)).alias("below"))).df


def sized_rows(store: Store, docs: DataFrame) -> DataFrame:
    """The only pass over the texts: (doc_id, source, size, h), written."""
    return store.save("mix_sizes", docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                               id_hash(F.col("doc_id")).alias("h"))).df


def plan_of(store: Store, sized: DataFrame, **options) -> DataFrame:
    return thresholds(store, sized, source_targets(store, sized, **options))


def times(h: Column, plan: DataFrame) -> Column:
    return (plan["whole"] + (h < plan["below"]).cast("bigint")).cast("int")


def taken(docs: DataFrame, store: Store | None = None, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, taken (words, repeats counted)."""
    store = store or Store(docs.sparkSession)
    sized = sized_rows(store, docs)
    plan = plan_of(store, sized, **options).withColumnRenamed("source", "_source")
    return sized.join(plan, _same("source"), "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("h"), plan)).alias("taken"))


def mixed(docs: DataFrame, store: Store | None = None, **options) -> DataFrame:
    """The mixed corpus: each document as many times as the mix takes it, with its own columns. A document without
    words goes with the others of its source."""
    store = store or Store(docs.sparkSession)
    plan = plan_of(store, sized_rows(store, docs), **options)
    joined = docs.join(plan.select("source", "whole", "below"), docs["source"].eqNullSafe(plan["source"]), "left")
    copies = F.array_repeat(F.lit(0), times(id_hash(docs["doc_id"]), plan))
    own = [docs[f"`{c}`"].alias(f"c{at}") for at, c in enumerate(docs.columns)]
    return joined.select(*own, F.explode(copies).alias("copy")).select(
        *[F.col(f"c{at}").alias(c) for at, c in enumerate(docs.columns)])
