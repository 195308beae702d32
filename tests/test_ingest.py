"""Raw bytes in, strings out."""

import datetime
import pathlib

import pyarrow as pa
import pytest
from pyarrow import feather
from pyspark.sql import functions as F

from sievewright.sources import arrow, tables
from sievewright.sources.csv import FILE_BITS, ingest_statistics, read_folder, source_names


def write(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))


def read(spark, folder, **kw):
    return read_folder(spark, str(folder), **kw).orderBy("row_id")


def test_bad_lines(spark, tmp_path):
    write(tmp_path, "a.csv", 'A,B,Label\n1,2,x\n1,2,x,EXTRA\n1,2\n3,4,y,\n5,"q,r",z\n\n6,7,w,,\n,8,v\n')
    rows = [tuple(r) for r in read(spark, tmp_path).select("a", "b", "label").collect()]
    assert rows == [("1", "2", "x"), ("1", "2", None), ("5", "q,r", "z"), (None, "8", "v")]


def test_encoding_is_decided_per_file(spark, tmp_path):
    write(tmp_path, "one.csv", "v,Label\n1,Web – x\n")
    write(tmp_path, "two.csv", b"v,Label\n1,caf\xe9\n2,Web \x96 x\n")
    far = b"".join(b"%d,plain\n" % i for i in range(5000))
    write(tmp_path, "zzz far.csv", "v,Label\n0,é\n".encode("latin-1") + far + b"9,\x96\n")
    rows = read(spark, tmp_path).groupBy("source_file").agg(
        F.collect_set("label").alias("l"), F.count("*").alias("n")
    )
    got = {r["source_file"]: (sorted(r["l"]), r["n"]) for r in rows.collect()}
    assert got["one"] == (["Web – x"], 1)
    assert got["two"] == (sorted(["café", "Web \x96 x"]), 2)
    assert got["zzz far"] == (sorted(["é", "plain", "\x96"]), 5002)


def test_order_sources_and_na(spark, tmp_path):
    write(tmp_path, "Monday.v2.csv", " Label,A\nNA,1\nnan,2\nBENIGN,\n")
    write(tmp_path, "Friday.csv", "A,Label,Extra\n5,x,e\n")
    write(tmp_path, "notes.txt", "no,table\n")
    df = read(spark, tmp_path)
    rows = [tuple(r) for r in df.select("source_file", "a", "label", "extra").collect()]
    assert rows == [
        ("Friday", "5", "x", "e"),
        ("Monday.v2", "1", None, None),
        ("Monday.v2", "2", None, None),
        ("Monday.v2", None, "BENIGN", None),
    ]
    assert [r[0] for r in df.select("row_id").collect()] == [
        0, 1 << FILE_BITS, (1 << FILE_BITS) + 1, (1 << FILE_BITS) + 2
    ]
    stats = {r["source_file"]: (r["rows"], r["columns"]) for r in ingest_statistics(df).collect()}
    assert stats == {"Friday": (1, 4), "Monday.v2": (3, 4), "TOTAL": (4, 4)}
    assert source_names(df).count() == 2


def test_duplicate_headers(spark, tmp_path):
    write(tmp_path, "a.csv", "Fwd Header Length,Fwd Header Length,B,B\n1,2,3,4\n")
    assert read(spark, tmp_path).columns[2:] == ["fwd_header_length", "fwd_header_length_1", "b", "b_1"]
    assert read(spark, tmp_path, tidy=False).columns[2:] == [
        "Fwd Header Length", "Fwd Header Length.1", "B", "B.1"
    ]


def test_line_numbers_across_blocks(spark, tmp_path):
    lines = "".join(f"{i},{'x' * 50}\n" for i in range(4000))
    write(tmp_path, "big.csv", "n,t\n" + lines)
    write(tmp_path, "small.csv", "n,t\n0,y\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read(spark, tmp_path).filter("source_file = 'big'")
        assert df.filter(F.col("row_id") != F.col("n").cast("bigint")).count() == 0
        assert df.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_file_in_parts(spark, tmp_path):
    """A folder of parts named like a file is one file: records numbered through, one encoding, a header in each part."""
    (tmp_path / "b.csv").mkdir()
    write(tmp_path, "a.csv", "n,t\n0,y\n")
    write(tmp_path, "c.csv", "n,t\n0,z\n")
    write(tmp_path / "b.csv", "_SUCCESS", "")
    for part in range(5):
        rows = "".join(f'{part * 300 + i},"{"x" * 50}\n\n""é"\n' for i in range(300))
        write(tmp_path / "b.csv", f"part-0000{part}-x.csv", ("n,t\n" + rows).encode("latin-1" if part == 2 else "utf-8"))
    write(tmp_path / "b.csv", "part-00005-x.csv", "n,t\n\n1500,u,surplus\n1501,v")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = read(spark, tmp_path, parts=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["source_file"], r["row_id"] >> FILE_BITS) for r in (rows[0], rows[1], rows[-1])] == [("a", 0), ("b", 1), ("c", 2)]
    parts = rows[1:-1]
    assert [r["row_id"] - (1 << FILE_BITS) for r in parts] == [int(r["n"]) for r in parts] == [*range(1500), 1501]
    assert {r["t"] for r in parts[600:900]} == {"x" * 50 + '\n\n"é'}
    assert {r["t"] for r in parts[:600]} == {("x" * 50 + '\n\n"é').encode().decode("latin-1")}
    assert {r["source_file"] for r in read(spark, tmp_path).collect()} == {"a", "c"}  # else a folder is no file


def test_missing_folder_and_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_folder(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        read_folder(spark, str(tmp_path))


def test_sinks(spark, tmp_path):
    df = spark.range(3).withColumn("s", F.lit("a,b"))
    for fmt in ("Parquet", "FEATHER", "csv", "orc"):
        tables.save(df, str(tmp_path / "t"), fmt)
        assert tables.load(spark, str(tmp_path / "t"), fmt).count() == 3
    with pytest.raises(ValueError):
        tables.save(df, str(tmp_path / "t"), "xml")


def test_arrow_files(spark, tmp_path, monkeypatch):
    """Other programs read the parts, this one reads theirs; an overwrite and left-over files change nothing else."""
    rows = [(i, None if i % 7 == 0 else f"é{i}", [float(i), None], datetime.datetime(2024, 1, 1, i % 24), {"a": i}) for i in range(1000)]
    df = spark.createDataFrame(rows, "i long, s string, v array<double>, t timestamp, m map<string, int>").repartition(3)
    where = tables.save(df, str(tmp_path / "t"), "feather")
    files = sorted(pathlib.Path(where).glob("*.arrow"))
    assert len(files) == 3
    seen = pa.concat_tables([pa.ipc.open_file(f).read_all() for f in files])
    assert sorted(seen["i"].to_pylist()) == list(range(1000)) and seen["s"].null_count == 143
    (pathlib.Path(where) / "part-00000-left-over.arrow").write_bytes(files[0].read_bytes())
    back = tables.load(spark, str(tmp_path / "t"), "feather")
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
    tables.save(df.filter("i < 5"), str(tmp_path / "t"), "feather")
    assert tables.load(spark, str(tmp_path / "t"), "feather").count() == 5
    assert len(list(pathlib.Path(where).glob("*.arrow"))) <= 3
    tables.save(df.filter("i < 0"), str(tmp_path / "none"), "feather")
    assert tables.load(spark, str(tmp_path / "none"), "feather").schema == df.schema
    assert tables.load(spark, str(tmp_path / "none"), "feather").count() == 0
    (tmp_path / "other.feather").mkdir()
    feather.write_feather(pa.table({"x": [1, 2, 3], "y": ["a", None, "c"]}), str(tmp_path / "other.feather" / "one.feather"))
    assert [tuple(r) for r in tables.load(spark, str(tmp_path / "other"), "feather").orderBy("x").collect()] == [(1, "a"), (2, None), (3, "c")]
    monkeypatch.setattr(arrow, "BATCH_ROWS", 10)
    monkeypatch.setattr(arrow, "BATCHES", 2)
    tables.save(df.coalesce(1), str(tmp_path / "split"), "feather")
    whole = tables.load(spark, str(tmp_path / "split"), "feather")
    assert whole.rdd.getNumPartitions() == 50 and sorted(whole.collect()) == sorted(df.collect())


@pytest.mark.parametrize("fmt", ["parquet", "orc", "feather"])
def test_features_and_targets_join_by_buckets(spark, tmp_path, fmt):
    df = spark.range(500).selectExpr("concat('r', id) as row_id", "id * 1.5 as `a b`", "id % 3 as y", "if(id % 5 = 0, 'test', 'train') as split")
    for _ in range(2):  # a later run replaces the tables
        tables.save_split(df, str(tmp_path), "train", ["y"], ["a b"], fmt)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = tables.load_split(spark, str(tmp_path), "train", fmt)
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange" in plan) == (fmt == "feather")
        assert sorted(back.collect()) == sorted(df.filter("split = 'train'").drop("split").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("split_")]
