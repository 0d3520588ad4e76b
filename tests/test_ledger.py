"""Files are loaded once, and again when they change; a written document reads back section by section."""

import os

import pytest
from pyspark.sql import functions as F

from tallywork.operators import stats
from tallywork.plans import extracts
from tallywork.sources import ledger, staging
from tallywork.sources.store import Store

HEAD = ",".join(staging.RAW_COLUMNS)


def put(folder, name, *rows, at=None):
    path = folder / name
    path.write_text("\n".join([HEAD, *rows]) + "\n")
    if at:
        os.utime(path, (at, at))


def line(i):
    return f"T{i},C{i},1/1/90,M,PUNE,10.5,2/8/16,101010,5{i}"


def test_only_new_and_changed_files_are_read(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    path, book, store = str(logs), str(tmp_path / "ledger"), Store(spark)
    land = lambda rows: store.save("landed", rows).df
    ids = lambda df: sorted(r.transaction_id for r in df.collect())
    put(logs, "a.csv", line(1), line(2), at=1_000_000_000)
    put(logs, "empty.csv", at=1_000_000_000)
    assert ids(ledger.load_new(spark, path, book, land)) == ["T1", "T2"]
    assert ledger.load_new(spark, path, book, land) is None
    put(logs, "b.csv", line(3), "too,short", at=1_000_000_100)
    assert ids(ledger.load_new(spark, path, book, land).where("NOT malformed")) == ["T3"]
    rows = {os.path.basename(r.file_name): r for r in ledger.read_ledger(spark, book).collect()}
    assert {k: (r.rows_loaded, r.malformed_rows) for k, r in rows.items()} == {"a.csv": (2, 0), "b.csv": (2, 1), "empty.csv": (0, 0)}
    assert rows["a.csv"].file_bytes == (logs / "a.csv").stat().st_size
    put(logs, "a.csv", line(2), line(1), at=1_000_000_200)  # other order, other time
    assert ids(ledger.load_new(spark, path, book, land)) == ["T1", "T2"]
    again = {os.path.basename(r.file_name): r for r in ledger.read_ledger(spark, book).collect()}
    assert len(again) == 3 and again["a.csv"].fingerprint == rows["a.csv"].fingerprint
    assert again["a.csv"].modified > rows["a.csv"].modified


def test_a_load_that_fails_is_taken_again(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    put(logs, "a.csv", line(1))

    def broken(rows):
        raise RuntimeError("no room")

    with pytest.raises(RuntimeError):
        ledger.load_new(spark, str(logs), str(tmp_path / "ledger"), broken)
    assert ledger.unseen_files(spark, str(logs), str(tmp_path / "ledger")).count() == 1


def test_document_by_sections(spark, tmp_path):
    sections = {"numbers": spark.range(1000).repartition(3).selectExpr("id", "cast(id as decimal(12,2)) / 4 AS q"),
                "lists": spark.createDataFrame([("a\n\"b", [1, 2]), ("é", []), (None, None)], "k string, v array<int>"),
                "none": spark.range(0).selectExpr("id", "'x' AS t")}
    path = str(tmp_path / "doc")
    index = {r.section: (r.rows, r.columns) for r in extracts.write_document(spark, sections, path).collect()}
    assert index == {"numbers": (1000, ["id", "q"]), "lists": (3, ["k", "v"]), "none": (0, ["id", "t"])}
    for name, df in sections.items():
        back = extracts.read_section(spark, path, name, df.schema)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert {(r.extract, r.same) for r in extracts.contents(spark, sections, path, "json").collect()} == {(n, True) for n in sections}
    other = {**sections, "numbers": sections["numbers"].where("id > 0")}
    assert not extracts.contents(spark, other, path, "json").where("extract = 'numbers'").first().same


def test_histogram_between_extremes(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.0, 9.0, 99.0, 999.0, None)], "b double")
    assert {r.bin: r.n for r in stats.spread_histogram(df, "b", 3).collect()} == {0: 2, 1: 1, 2: 2}
    assert {r.bin: r.n for r in stats.spread_histogram(df.where("b = 9"), "b", 3).collect()} == {0: 1}
    assert stats.spread_histogram(df.where("b IS NULL"), "b", 3).collect() == [] and df.agg(F.count("b")).first()[0] == 5
