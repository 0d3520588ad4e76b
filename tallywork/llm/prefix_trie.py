"""The prefix trie of conversations by fixed-length block hashing.

A turn is reduced to a SHA-256 digest of role and text, and bound to its place by two 64-bit hashes of (place, digest). The
XOR of these over the first d turns is the key of the depth-d prefix; a block digest is the XOR over ``BLOCK`` consecutive
turns, so block digests chain to the keys at block ends.

Conversations are first grouped by their chains of block digests alone. Where all conversations with one chain go on
with the same block, its turns are one unbranched run of nodes (a unit) with the same members, and no turn of it is
grouped. Only inside blocks where siblings diverge (other turns, or an end) the turns' own prefix keys are formed and
grouped. A conversation's last, shorter block differs from a whole one, so ends lie on unit ends too.

Sums over subtrees need no walk of the tree: each node is charged to its smallest member c. Those nodes are the tail of
c's path, so a node's subtree holds the whole charge of its other members and the rest of its own member's path.

Running keys and sums are distributed scans (``scan.py``), and lookups by parent or conversation are split by hot keys, so
neither one long conversation nor a common first turn fills a task. The ids that end at a node are joined in chunks of
``CHUNK`` and hashed as a stream.

Defined cases: NULL role or text is empty. Turns are ordered by ``turn``, NULL first, ties by digest; equal rows are turns
of their own. Rows without a conv_id belong to no conversation and are left out. An empty table has no nodes. Texts of any
length are read once and never shuffled. Other columns are not read, whatever their names. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import row_numbers
from ..operators.skew import lookup_join
from ..sources.store import Saved, Store
from .scan import running_sum, running_xor

BLOCK = 4
CHUNK = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
UNIT = ["hi", "k1", "k2"]  # a unit is known by its last depth and the prefix key there


def turn_digests(store: Store, conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size) of every turn: its place from 1 and the code points of its text. The only pass over
    the texts; places come from a distributed sort of the narrow rows."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    bare = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("digest"),
        F.length(text).cast("bigint").alias("size"))
    ranked = row_numbers(store, "turn_order", store.save("turn_digests", bare),
                         [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")], "no")
    return store.save("turn_numbers", ranked.select("conv_id", "no", "digest", "size")).df


def lengths(store: Store, numbered: DataFrame) -> Saved:
    """(conv_id, first, n): the number of a conversation's first turn in the table, and its turns."""
    return store.save("lengths", numbered.groupBy("conv_id").agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("n")))


def placed(numbered: DataFrame, own: Saved) -> DataFrame:
    """Turns with ``pos``, their place in the conversation from 1, and the other columns of ``own``."""
    at = lookup_join(numbered, own, ["conv_id"], "n", F.col("no"))
    return at.withColumn("pos", F.col("no") - F.col("first") + 1).drop("no", "first")


def with_shared_heads(store: Store, numbered: DataFrame, group: int, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which the first ``head`` turns (a column over conv_id, ``most`` at the most) of every
    conversation c are replaced by those of conversation c - c % group, as far as it has them."""
    own = lengths(store, numbered)
    base = own.df.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = own.df.withColumn("head", head.cast("bigint")).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    heads = heads.join(base, "base", "left").withColumn("given", F.least("head", F.coalesce("base_n", F.lit(0)))) \
        .drop("base_n")
    saved = store.save("heads", heads)
    turns = placed(numbered, saved)
    kept = turns.where("pos > head").select("conv_id", (F.col("pos") - F.col("head") + F.col("given")).alias("pos"), "digest",
                                            "size")
    firsts = turns.where((F.col("pos") <= most) & (F.col("conv_id") == F.col("base"))).select("base", "pos", "digest", "size")
    taken = saved.df.where("given > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("bigint"), "given")).alias("pos"))
    given = taken.join(firsts, ["base", "pos"]).select("conv_id", "pos", "digest", "size")
    return kept.unionByName(given), saved.df.select("conv_id")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each unit's joined ids; its chunks come in order and are hashed as a stream."""
    names, now, digest = [*UNIT, "ends_sha256"], None, None

    def done(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        out = []
        for *unit, ids in zip(*[batch.column(c).to_pylist() for c in (*UNIT, "ids")]):
            if unit == now:
                digest.update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now, digest.hexdigest()))
            now, digest = unit, hashlib.sha256(ids.encode())
        yield done(out)
    if now is not None:
        yield done([(*now, digest.hexdigest())])


def end_hashes(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(hi, k1, k2, ends_sha256) of the units at whose end conversations end."""
    last = members.groupBy("conv_id").agg(F.max(F.struct(*UNIT)).alias("u"))
    chunks = last.groupBy("u", F.floor(F.col("conv_id") / chunk).alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = chunks.select("u.*", "chunk", "ids").repartition(*UNIT).sortWithinPartitions(*UNIT, "chunk")
    return dealt.select(*UNIT, "ids").mapInArrow(_ends, "hi bigint, k1 bigint, k2 bigint, ends_sha256 string")


def memberships(store: Store, turns: DataFrame, conversations: DataFrame, block: int) -> DataFrame:
    """(conv_id, lo, hi, k1, k2, p1, p2): the units on each conversation's path: depths lo to hi, the key at the end and the
    key before the start. The root is the unit of depth 0."""
    chains = turns.groupBy("conv_id", "blk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.max("pos").alias("hi"))
    chains = running_xor(store, "block_order", chains, "conv_id", [F.col("blk")], {"k1": "x1", "k2": "x2"})
    chains = store.save("block_chains", chains.select(
        "conv_id", "blk", "hi", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"))).df
    ahead = F.struct("k1", "k2")
    siblings = store.save("siblings", chains.groupBy("blk", "p1", "p2").agg(
        F.count(F.lit(1)).alias("n"), (F.min(ahead) != F.max(ahead)).alias("split")).where("n > 1"))
    marked = lookup_join(chains, siblings, ["blk", "p1", "p2"], "n", F.col("conv_id"))
    marked = store.save("marked_blocks", marked.withColumn("split", F.coalesce("split", F.lit(False)))).df
    whole = marked.where("NOT split").select("conv_id", (F.col("blk") * block + 1).alias("lo"), "hi", "k1", "k2", "p1", "p2")
    at = turns.join(marked.where("split").select("conv_id", "blk", "p1", "p2"), ["conv_id", "blk"])
    # At most ``block`` turns of one block.
    upto = [F.aggregate(F.filter("held", lambda t: t["pos"] <= F.col("t.pos")), F.col(f"p{i}"),
                        lambda key, t: key.bitwiseXOR(t[f"x{i}"])) for i in (1, 2)]
    held = at.groupBy("conv_id", "blk", "p1", "p2").agg(F.collect_list(F.struct("pos", "x1", "x2")).alias("held"))
    fine = held.select("*", F.explode("held").alias("t")).select(
        "conv_id", F.col("t.pos").alias("lo"), F.col("t.pos").alias("hi"), upto[0].alias("k1"), upto[1].alias("k2"),
        "t.x1", "t.x2")
    fine = fine.select("conv_id", "lo", "hi", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"),
                       F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"))
    zero = F.lit(0).cast("bigint")
    root = conversations.select("conv_id", *[zero.alias(c) for c in ("lo", "hi", "k1", "k2", "p1", "p2")])
    return store.save("memberships", whole.unionByName(fine).unionByName(root)).df


def trie(store: Store, turns: DataFrame, conversations: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, pos from 1 without gaps, digest, size); ``conversations`` (conv_id)
    also names those without turns. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved (over the subtree: sizes of last turns that need not be read again), ends_sha256."""
    turns = store.save("turns", turns.select(
        "conv_id", "pos", "size", F.floor((F.col("pos") - 1) / block).alias("blk"), F.xxhash64("digest", "pos").alias("x1"),
        F.xxhash64("pos", "digest", F.lit("second")).alias("x2"))).df
    members = memberships(store, turns, conversations, block)
    units = members.groupBy("lo", *UNIT).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                             F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    units = store.save("bare_units", units).df
    above = (F.col("lo") - 1).alias("hi")
    kids = units.where("lo > 0").groupBy(above, F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    units = store.save("units", units.join(kids, UNIT, "left").fillna(0, ["n_children"]).withColumn(
        "blk", F.floor((F.col("hi") - 1) / block))).df

    # Nodes: the turns of each unit's smallest member.
    steps = turns.select("conv_id", "blk", "pos", "size").join(units.drop("p1", "p2"), ["conv_id", "blk"]).where(
        "pos BETWEEN lo AND hi")
    top = units.where("hi = 0").withColumn("pos", F.col("hi")).withColumn("size", F.col("hi"))
    columns = ["conv_id", "pos", "lo", *UNIT, "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("size")).alias("charge")]
    nodes = running_sum(store, "node_order", steps.select(*columns).unionByName(top.select(*columns)), "conv_id", [F.col("pos")],
                        {"upto": "charge"})
    nodes = store.save("nodes", nodes).df

    # What each conversation is charged with as a smallest member; its path is no longer than its deepest node.
    leaf = (F.col("pos") == F.col("hi")) & (F.col("n_children") == 0)
    charged = store.save("charged", nodes.groupBy("conv_id").agg(
        F.sum("charge").alias("charge"), F.count_if(leaf).alias("leaves"), F.max(F.col("pos") + 1).alias("n")))
    paid = lookup_join(members.select("conv_id", *UNIT), charged, ["conv_id"], "n", F.col("hi"))
    sums = paid.groupBy(*UNIT).agg(F.sum("charge").alias("all_charge"), F.sum("leaves").alias("n_leaves"))

    parents = store.save("parents", units.where("n_children > 0").select(
        F.col("hi").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"),
        F.col("n_children").alias("n")))
    placed_under = lookup_join(units.select((F.col("lo") - 1).alias("up"), "p1", "p2", *UNIT), parents, ["up", "p1", "p2"],
                               "n", F.col("k1")).select(*UNIT, "above")
    facts = placed_under.join(sums, UNIT).join(end_hashes(members, chunk), UNIT, "left")
    at_end, inside = F.col("pos") == F.col("hi"), F.col("pos") > F.col("lo")
    return nodes.join(store.save("unit_facts", facts).df, UNIT).select(
        "conv_id", F.col("pos").alias("depth"), F.when(inside, F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs", F.when(at_end, F.col("n_children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("all_charge") - F.col("upto") + F.col("charge")).alias("saved"),
        F.when(at_end, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, store: Store | None = None, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """The trie of a table (conv_id, turn, role, text) as it is."""
    store = store or Store(conversations.sparkSession)
    numbered = turn_digests(store, conversations)
    own = lengths(store, numbered)
    return trie(store, placed(numbered, own), own.df.select("conv_id"), block, chunk)


def rebuilt_trie(conversations: DataFrame, group: int, heads: int, store: Store | None = None, block: int = BLOCK,
                 chunk: int = CHUNK) -> DataFrame:
    """The trie of conversations whose first crc32(conv_id) % ``heads`` turns are those of conversation c - c % group."""
    store = store or Store(conversations.sparkSession)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    turns, ids = with_shared_heads(store, turn_digests(store, conversations), group, head, heads - 1)
    return trie(store, turns, ids, block, chunk)
