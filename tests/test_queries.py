"""Every registered query against its DuckDB statement on the smallest tables."""

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
#: Results that SQL cannot express; tests of their own compare them with plain Python or a library.
WITHOUT_SQL = {
    "lr_tuned_metrics", "lr_multiclass_metrics", "op1_mix", "op2_shard", "op3_idcoder", "op5_langid", "op7_pii",
    "op9_pieces", "op10_imatch", "pipeline",
}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    verdict, rows = compare(spark, duck, SF_DIR, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict == ("rows only" if name in WITHOUT_SQL else "ok")
    assert rows > 0


def test_messy_files_in_parts(spark, monkeypatch):
    """No task writes a whole file: parts by range of the key, read as one file."""
    monkeypatch.setattr(entry, "MESSY_PART", 200_000)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    written = []
    discover = entry.csv._discover
    monkeypatch.setattr(entry.csv, "_discover", lambda *a: written.extend(discover(*a)) or written)
    try:
        folder = SF_DIR.replace("sf0.001", "sf0.01")
        verdict, rows = compare(spark, connect(folder), folder, entry.queries()["ingest_messy_csv"], entry.oracle_sql()["ingest_messy_csv"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert verdict == "ok" and rows > 900
    assert [n for n, _ in written] == ["file0.csv", "file1.csv", "file2.csv"] and all(len(paths) > 2 for _, paths in written)


def test_day_files_are_dealt_to_as_many_tasks_as_rows_need(spark):
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = entry._day_files(spark, SF_DIR)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(entry.csv.discover_files(spark, folder, "Friday*")) == 9


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_statements_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
