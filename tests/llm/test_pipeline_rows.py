"""Rows that share an id are judged by their own texts, in the stages that drop rows."""

from collections import Counter

from tallywork.llm import decontaminate, simhash

LONG = "one two three four five six seven eight nine ten eleven twelve"


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_texts_under_a_repeated_id(spark):
    a, b, c = "Alpha beta gamma delta epsilon.", "Quite another text, about ships and rain.", "A third one, on bread, salt and iron."
    rows = [(3, b), (5, c), (5, b), (7, a), (None, a), (None, "No id, no copy, nothing else to say."), (8, c), (9, None), (9, ""),
            (10, LONG), (10, LONG)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, _id string, _row_hash int")
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    got = rows_of(out)
    assert sum(got.values()) == 6 and got[9, None] + got[9, ""] == 1
    assert got - Counter({(9, None): 1, (9, ""): 1}) == Counter([(3, b), (5, c), (7, a), (None, rows[5][1]), (10, LONG)])


def test_clean_text_of_a_contaminated_id(spark):
    items = spark.createDataFrame([(1, LONG)], "item_id bigint, text string")
    rows = [(1, f"before {LONG} after"), (1, "clean"), (2, None), (None, LONG), (None, "clean too"), (3, "clean"), (3, "clean")]
    docs = spark.createDataFrame([(i, t, 4) for i, t in rows], "doc_id bigint, text string, _hit_row int")
    assert rows_of(decontaminate.clean_documents(docs, items)) == Counter(
        [(1, "clean"), (2, None), (None, "clean too"), (3, "clean"), (3, "clean")])


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "same words here"), ("a", "same words here"), ("c", LONG)], "doc_id string, text string")
    assert rows_of(simhash.deduplicated(docs)) == Counter([("a", "same words here"), ("c", LONG)])
    items = spark.createDataFrame([(1, LONG)], "item_id bigint, text string")
    assert len(rows_of(decontaminate.clean_documents(docs, items))) == 2
