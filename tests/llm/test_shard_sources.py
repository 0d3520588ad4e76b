"""Sources with a common head are told apart by the tree."""

from tallywork.llm import sharding


def test_sources_with_a_common_head_are_split(spark):
    docs = spark.range(400).selectExpr("id doc_id", "'same text' text", "'en' lang", "9L n_chars",
                                       "concat('https://crawl_20', 19 + id % 2) source")
    where = docs.select("doc_id", "source").join(sharding.shard_documents(docs, shards=2), "doc_id")
    found = {(r.shard, r.source): r["count"] for r in where.groupBy("shard", "source").count().collect()}
    assert found == {(0, "https://crawl_2019"): 200, (1, "https://crawl_2020"): 200}
