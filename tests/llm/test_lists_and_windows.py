"""The URL list as a table of a million entries in parts, and benchmark windows cut by Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.llm import decontaminate, url_filter
from tallywork.sources.store import Store


def test_a_list_of_a_million_entries_in_parts(spark):
    n = 1_000_000
    kind = F.when(F.col("id") % 3 == 0, F.concat(F.lit("host"), "id", F.lit(".example/"))).when(
        F.col("id") % 3 == 1, F.concat(F.lit("host"), "id", F.lit(".example/a/b"))).otherwise(F.concat(F.lit("host"), "id", F.lit(".test")))
    entries = spark.range(n).select(kind.alias("entry"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"))
    entries = entries.unionByName(spark.createDataFrame([(None, "block"), ("host3.example/", "block")], "entry string, verdict string"))
    urls = {"http://host3.example/x": ("host3.example/", "block"),  # listed twice, once to allow: blocks
            "http://www.host9.example/": ("host9.example/", "allow"), "http://host4.example/a/bc": ("host4.example/a/b", "block"),
            "http://host4.example/a": (None, "allow"), "http://host5.test": ("host5.test", "allow"),
            "http://a.b.host8.test/q?r": ("host8.test", "block"), "http://host999999.example/": ("host999999.example/", "allow"),
            "http://host1000000.example/": (None, "allow"), "http://host6.example/" + "x" * 50_000: ("host6.example/", "block")}
    pages = spark.createDataFrame([(i, u, 7) for i, u in enumerate(urls)], "page_id int, url string, verdict int")
    store = Store(spark)
    out = url_filter.judged(pages, entries=entries, store=store, entries_a_part=200_000)
    got = {r.page_id: (r.rule, r.verdict) for r in out.collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    store.close()


def test_digests_are_those_of_spark_and_collisions_stay_apart(spark, tmp_path):
    words = ["com/", "é.example/ü", "", "x" * 100]
    made = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()
    assert [r.h for r in made] == url_filter.digests([w.encode() for w in words]).tolist()
    one = np.full(2, url_filter.digests([b"com/"])[0])  # two entries under one digest
    (tmp_path / "a").write_bytes(url_filter.laid_out(one, [b"net/\nallow", b"com/\nblock"]))
    (tmp_path / "b").write_bytes(url_filter.laid_out(one[:0], []))
    (tmp_path / "c").write_bytes(url_filter.laid_out(one[:1] + 1, [b"other/\nallow"]))
    listed = url_filter.DigestParts([str(tmp_path / x) for x in "bca"])
    assert listed.find([b"com/", b"other/", b"x"]) == ["block", None, None]
    assert url_filter.DigestParts([str(tmp_path / "b")]).find([b"com/"]) == [None]


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_windows_are_cut_on_spark_in_bounded_blocks(spark, limit):
    long = " ".join(f"w{i % 50}" for i in range(300))
    items = [("a", long), (None, "A b"), ("c", None), ("d", "  "), ("a", "z")]
    df = spark.createDataFrame(items, "item_id string, text string")
    store = Store(spark)
    rows = decontaminate.window_blocks(df, 10, limit, store).withColumnRenamed("items", "items_").collect()
    got = set()
    for row in rows:
        w = decontaminate.windows_of(row, 10)
        assert 0 < len(w.terms) <= limit
        for terms, n, item in zip(w.terms.tolist(), w.sizes.tolist(), w.item_of.tolist()):
            got.add((w.items[item], tuple(w.vocabulary[t] for t in terms[:n])))
    words = long.encode().split()
    assert got == {("a", tuple(words[i:i + 10])) for i in range(291)} | {("null", (b"a", b"b")), ("a", (b"z",))}
    store.close()
