import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import queries, shard
from sievewright.llm.numbering import number_rows


@pytest.mark.parametrize("n", [1, 2, 3, 16, 1000, 4097])
def test_permutation(n):
    p = shard.Permutation(n, 3)
    places = p.forward(np.arange(n))
    assert sorted(places) == list(range(n))
    assert p.inverse(places).tolist() == list(range(n))
    assert n < 100 or (places != shard.Permutation(n, 4).forward(np.arange(n))).any()


@pytest.mark.parametrize("n,shards", [(0, 4), (1, 4), (3, 16), (101, 7)])
def test_shards_and_slots(spark, n, shards):
    rows = [(None if i % 3 == 0 else i // 2, "x") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, slot string")
    got = shard.shard_rows(df, [F.col("doc_id")], shards, seed=5).collect()
    again = shard.shard_rows(df.repartition(5), [F.col("doc_id")], shards, seed=5).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    counts = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(shards)]
    assert all(c == list(range(len(c))) for c in counts)
    assert n == 0 or max(map(len, counts)) - min(map(len, counts)) <= 1
    order = sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    for r in got:
        assert order[shard.row_of(n, shards, 5, r["shard"], r["slot"])] == r["doc_id"]
    with pytest.raises(ValueError):
        shard.shard_rows(df, [F.col("doc_id")], 0)


def test_row_numbers(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    got = sorted(number_rows(df, [-F.col("k"), F.col("v")], "n").collect(), key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(500))
    assert [(r["k"], r["v"]) for r in got] == sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1]))


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = queries.QUERIES["op2_shard"](spark, sf_dir).collect()
    places = shard.Permutation(len(texts), 7).forward(np.arange(len(texts)))
    for r in got:
        place = places[sorted(texts).index(r["doc_id"])]
        assert (r["shard"], r["slot"]) == (place % 16, place // 16)
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
