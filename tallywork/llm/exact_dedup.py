"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

Every row is reduced once to (doc_id, digest, row number) and written, the only pass over the texts. Misra-Gries summaries
(Spark's ``freqItems``, merged map-side) name the digests that may fill more than half of a mean shuffle partition.
Their exact counts and winners are verified with one aggregate over the few candidates; the digests that are as frequent as
that are at most twice the shuffle partitions, so their winners are broadcast and their rows are settled map-side. The
other digests go through an ordinary shuffle of the narrow rows, in which no group is larger than half a partition.

Texts are equal when their bytes are; a SHA-256 digest of all bytes stands for them.

Defined cases: a NULL text counts as empty. Of equal texts the largest id stays; NULL ids are below all others. Of rows
with one id and one text exactly one stays (the last one written). An empty table gives an empty result. A text of any length
is one digest. Other columns are not read by ``exact_groups`` and are passed through by ``deduplicated``, whatever their
names. Ids may be of any ordered type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Saved, Store

LEAST_SUPPORT = 1e-4  # what Spark's summary allows; it holds 1 / support digests


def digest_of(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def digests(store: Store, docs: DataFrame) -> Saved:
    """(doc_id, digest, row), written: row numbers are fixed from here on."""
    return store.save("digests", docs.select("doc_id", digest_of(docs["text"]).alias("digest"),
                                             F.monotonically_increasing_id().alias("row")))


def heavy_winners(store: Store, rows: Saved, partitions: int | None = None) -> DataFrame:
    """(digest, group_size, winner) of the digests with more than half of a mean shuffle partition's rows."""
    partitions = partitions or int(rows.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    support = min(1.0, max(LEAST_SUPPORT, 1 / (2 * partitions)))
    summary = rows.df.stat.freqItems(["digest"], support)
    candidates = summary.select(F.explode("digest_freqItems").alias("digest"))
    verified = rows.df.join(F.broadcast(candidates), "digest").groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("winner"))
    return store.save("heavy_digests", verified.where(F.col("group_size") * (2 * partitions) > rows.rows)).df


def _settled(rows: Saved, heavy: DataFrame) -> DataFrame:
    """Every row with its group's size and winner; rows of heavy digests do not cross a shuffle."""
    hot = rows.df.join(F.broadcast(heavy), "digest")
    group = Window.partitionBy("digest")
    rest = rows.df.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "*", F.count(F.lit(1)).over(group).alias("group_size"), F.max(F.struct("doc_id", "row")).over(group).alias("winner"))
    return hot.select("doc_id", "digest", "row", "group_size", "winner").unionByName(rest)


def exact_groups(docs: DataFrame, store: Store | None = None, partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    store = store or Store(docs.sparkSession)
    rows = digests(store, docs)
    return _settled(rows, heavy_winners(store, rows, partitions)).select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("winner.row")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def deduplicated(docs: DataFrame, store: Store | None = None, partitions: int | None = None) -> DataFrame:
    """The documents that stay, with their own columns. Copies of heavy digests are removed before the shuffle."""
    store = store or Store(docs.sparkSession)
    rows = digests(store, docs)
    heavy = heavy_winners(store, rows, partitions)
    settled = store.save("settled", _settled(rows, heavy)).df.withColumn("stays", F.col("row") == F.col("winner.row"))
    pairs = settled.where("group_size > 1").groupBy(F.col("doc_id").alias("_k_id"), F.col("digest").alias("_k_digest")).agg(
        F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    pairs = store.save("pairs", pairs.where("NOT stays OR n > 1")).df
    names = [f"c{at}" for at in range(len(docs.columns))]
    own = docs.toDF(*names)
    by_name = dict(zip(docs.columns, names))
    own = own.withColumn("_digest", digest_of(F.col(by_name["text"]))).withColumn("_id", F.col(by_name["doc_id"]))
    won = heavy.select(F.col("digest").alias("_digest"), F.struct(F.col("winner.doc_id").alias("id")).alias("_won"))
    left = own.join(F.broadcast(won), "_digest", "left").where(
        F.col("_won").isNull() | F.col("_id").eqNullSafe(F.col("_won.id"))).drop("_won")

    def same(table):
        return (F.col("_digest") == table["_k_digest"]) & F.col("_id").eqNullSafe(table["_k_id"])

    losers, twins = (pairs.where(c).select("_k_id", "_k_digest") for c in (~F.col("stays"), F.col("stays")))
    kept = left.join(losers, same(losers), "left_anti")
    once = kept.join(twins, same(twins), "left_anti")
    one_of = kept.join(twins, same(twins), "left_semi").dropDuplicates(["_digest", "_id"])
    return once.unionByName(one_of).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
