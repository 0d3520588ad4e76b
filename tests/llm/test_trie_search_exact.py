"""The prefix trie, the ranked search and exact dedup beside plain versions, on forms that the queries do not take."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.llm import exact_dedup, lexical_search, prefix_trie, scan
from tallywork.sources.store import Store


def plain_trie(rows):
    """(conv_id, depth) -> the other columns, for turns (conv_id, turn, role, text)."""
    paths = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            paths[conv].append(((turn is not None, turn or 0), digest, len(text)))
    for path in paths.values():
        path.sort()
    nodes = defaultdict(list)
    for conv, path in paths.items():
        for depth in range(len(path) + 1):
            nodes[tuple(d for _, d, _ in path[:depth])].append(conv)
    out = {}
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[:len(prefix)] == prefix]
        kids = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) > len(p) and q[:len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * paths[nodes[p][0]][len(p) - 1][2] for p in below if p)
        ends = ",".join(str(c) for c in sorted(m for m in members if len(paths[m]) == len(prefix)))
        out[min(members), len(prefix)] = (min(nodes[prefix[:-1]]) if prefix else None, len(members), len(kids), len(leaves), saved,
                                          hashlib.sha256(ends.encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(4)
    rows = []
    for conv in range(60):
        first = rng.choice("aab")
        rows += [(conv, t, "user", first if t < 2 else rng.choice("xy")) for t in range(rng.choice([1, 2, 3, 5, 8, 9]))]
    rows += [(70 + i, t, "user", "same") for i in range(25) for t in range(13)]
    rows += [(99, t, "user", "same" if t < 30 else "end") for t in range(120)]
    return rows + [(None, 1, "user", "none"), (100, None, None, None), (100, 1, None, "a"), (100, 1, None, "a")]


@pytest.mark.parametrize("block, chunk", [(1, 4096), (4, 3), (5, 1), (64, 4096)])
def test_trie_equals_plain_one(spark, block, chunk):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = prefix_trie.conversation_trie(table, block=block, chunk=chunk).collect()
    expected = plain_trie(rows)
    assert len(got) == len(expected)
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == expected


def test_running_values_over_partitions(spark):
    """A segment longer than a sort partition is carried on."""
    rows = [(s, i, (i * 7919 + s) % 1000) for s, n in ((1, 3), (2, 4000), (3, 1), (4, 2000)) for i in range(n)]
    table = spark.createDataFrame(rows, "s bigint, i bigint, v bigint").repartition(7)
    table.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = Store(spark)
        sums = {(r.s, r.i): r.t for r in scan.running_sum(store, "a", table, "s", [F.col("i")], {"t": "v"}).collect()}
        xors = {(r.s, r.i): r.t for r in scan.running_xor(store, "b", table, "s", [F.col("i")], {"t": "v"}).collect()}
    finally:
        table.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, mixed = Counter(), Counter()
    for s, i, v in rows:
        total[s] += v
        mixed[s] ^= v
        assert sums[s, i] == total[s] and xors[s, i] == mixed[s]


def texts():
    rng = random.Random(8)
    rows = [(i, f"text {rng.randint(0, 40)}") for i in range(150)] + [(i, "hot") for i in range(200, 320)]
    rows += [(7, None), (9, ""), (None, "hot"), (None, None), (None, "alone"), (500, "twice"), (500, "twice"), (319, "hot"),
             (3, "x" * 300_000), (4, "x" * 300_000)]
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_exact_groups(spark, partitions):
    """With no heavy digest, some, and many."""
    rows = texts()
    docs = spark.createDataFrame([(i, t, i, "g", "w") for i, t in rows], "doc_id bigint, text string, digest bigint, _id string, row string")
    docs = docs.repartition(4)
    store = Store(spark)
    heavy = exact_dedup.heavy_winners(store, exact_dedup.digests(store, docs), partitions).count()
    assert {1: heavy == 0, 3: heavy == 1, 40: heavy > 3}[partitions]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.exact_groups(docs, partitions=partitions).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(
        (i, top[t or ""], len(groups[t or ""]), sha(t or "")) for i, t in rows)
    assert Counter((r.doc_id, r.text_sha256) for r in got if r.kept) == Counter((top[t], sha(t)) for t in groups)
    left = exact_dedup.deduplicated(docs, partitions=partitions)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter((top[t], t) for t in groups)
    assert all(r._id == "g" and r.row == "w" and r.digest == r.doc_id for r in left.collect())


def test_shared_sets_rebuild_items():
    rng = random.Random(2)
    common = [rng.sample(range(400), 30) for _ in range(5)]
    items = [sorted({*rng.choice(common), *rng.choice(common), *rng.sample(range(400), 8)}) for _ in range(64)]
    signature = np.zeros(400, np.uint64)
    for at, terms in enumerate(items):
        signature[terms] |= np.uint64(1 << at)
    used = np.flatnonzero(signature)
    leaf, leaves, nodes, parts = lexical_search.shared_sets(signature[used], len(items))
    terms = [set(used[leaf == i].tolist()) for i in range(leaves)]
    for node in nodes:
        assert len(node) >= 2 and sum(len(terms[p]) for p in node) == len(set().union(*[terms[p] for p in node]))
        terms.append(set().union(*[terms[p] for p in node]))
    for mine, held in zip(items, parts):
        assert sum(len(terms[p]) for p in held) == len(mine) and set().union(*[terms[p] for p in held]) == set(mine)
    # Additions with sharing, leaves filled once each, are fewer than the items' own terms.
    assert sum(map(len, nodes)) + sum(map(len, parts)) < sum(map(len, items)) / 2


def test_search_in_batches(spark):
    """Blocks in passes of their own, and documents in small batches, give what one pass gives; ids may be text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    docs = docs.unionByName(docs.limit(3)).repartition(3)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = items.unionByName(items).unionByName(items.select("item_id", F.lit(None).cast("string").alias("text")))
    pick = lambda df: Counter(map(tuple, df.collect()))
    one = pick(lexical_search.best_documents(docs, items, k=4))
    assert one and max(one.values()) == 2
    held, lexical_search.CELLS = lexical_search.CELLS, 1 << 11
    items_, lexical_search.ITEMS = lexical_search.ITEMS, 7
    try:
        assert pick(lexical_search.best_documents(docs, items, k=4, batch_terms=60)) == one
    finally:
        lexical_search.CELLS, lexical_search.ITEMS = held, items_
