"""No caps by number of columns, one plan whatever the size, quoting of raw files."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import labels, profile, select
from sievewright.plans.profile import profile_splits
from sievewright.sources.csv import FILE_BITS, read_folder


def wide(spark, n, gaps=False):
    rng = np.random.default_rng(n)
    data = rng.normal(size=(60, n))
    data[:, -1] = 3.0
    rows = [tuple(None if gaps and (i * 7 + j) % 5 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(data)]
    return spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(n))), rows


def test_histograms_of_all_columns(spark):
    df, _ = wide(spark, 27)
    assert profile.histogram(df, bins=4).select("feature").distinct().count() == 27


@pytest.mark.parametrize("gaps", [False, True])
def test_correlations_of_many_columns(spark, gaps):
    df, rows = wide(spark, 34, gaps)
    found = {(r["i"], r["j"]): r["r"] for r in select.correlation_matrix(df).collect()}
    assert len(found) == 34 * 33 // 2
    for (i, j), r in found.items():
        pairs = np.array([(a[i], a[j]) for a in rows if a[i] is not None and a[j] is not None])
        if 33 in (i, j):
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(pairs.T)[0, 1], abs=1e-9)


def test_profile_correlates_all_features(spark):
    df, _ = wide(spark, 32)
    done = df.withColumn("y", F.lit(1))
    features = [f"c{i}" for i in range(32)]
    assert profile_splits(done, done, features, "y")["correlations"].count() == 32 * 31 // 2


def test_label_codes_need_no_shuffle(spark, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select(F.when(F.col("id") % 3 == 0, "BENIGN").otherwise("Bot").alias("label"))
        done, mapping = labels.multiclass_target(df)
        done.explain()
        assert "Exchange" not in capsys.readouterr().out
        assert {tuple(r) for r in done.distinct().collect()} == {("BENIGN", 0), ("Bot", 1)}
        named = labels.normalise_labels(df, mapping=spark.createDataFrame([("bot", "BOT")], "raw string, canonical string"))
        named.explain()
        assert "Exchange" not in capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(labels, "MOST_LABELS", 3)
    with pytest.raises(ValueError, match="labels"):
        labels.label_map(spark.range(4).select(F.col("id").cast("string").alias("label")))


def test_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,"say ""hi""",x\n2,"two\nlines",y\n3,"p,q",z,extra\n4,"p, ""q""",z\n')
    rows = read_folder(spark, str(tmp_path)).orderBy("row_id").select("a", "b", "c").collect()
    assert [tuple(r) for r in rows] == [("1", 'say "hi"', "x"), ("2", "two\nlines", "y"), ("4", 'p, "q"', "z")]
    (tmp_path / "b.csv").write_text('a,b,c\n1,5" pipe,x\n2,"open,y\n\n3,z,w\n')
    with pytest.raises(ValueError, match="b.csv: a quoted field is not closed"):
        read_folder(spark, str(tmp_path))


def test_large_files_with_line_breaks_are_split(spark, tmp_path):
    rng = random.Random(2)
    want = []
    for name, end in (("one", "\n"), ("two", "\r\n")):
        rows = [[str(i), "".join(rng.choice(['"', "\n", "\r\n", ",", " ", "ab", "é", '""', "\n\n"]) for _ in range(rng.choice([0, 3, 30]))), "z"] for i in range(600)]
        rows[50][1] = "long \n" * 2000  # a field over several blocks
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerows([["n", "t", "u"], *rows])
            out.write(f'600,5" pipe and 6",z{end} {end}601,"a"b"c,z{end}')
        want += [(name, i, r[1]) for i, r in enumerate(rows)] + [(name, 600, '5" pipe and 6"')]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        files = [f"{tmp_path}/{n}.csv" for n in ("one", "two")]
        assert spark.read.option("lineSep", "\n").text(files).rdd.getNumPartitions() > 20
        df = read_folder(spark, str(tmp_path))
        got = {(r["source_file"], r["row_id"] & (1 << FILE_BITS) - 1): (r["n"], r["t"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 2 * 602
    for name, i, text in want:
        assert got[name, i] == (str(i), text or None), (name, i)
