"""Searches by rank and running totals in their many-pass forms, against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from sievewright.functions import ranks
from sievewright.operators import split


def keys_from(rows, order, position):
    """Numbers of the rows from a position on, by plain sorting; NULLs first, texts by their bytes."""
    plain = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    ranked = sorted(rows, key=lambda r: [plain(r[i]) for i in order])
    return sorted(r[0] for r in ranked[position:])


def texts(kind):
    rnd = random.Random(kind)
    if kind == "long":  # 200 bytes, most of them shared
        return ["x" * 180 + f"{rnd.randrange(10**20):020d}" for _ in range(400)]
    if kind == "nested":  # every text begins the next
        return ["ab" * i for i in range(150)]
    if kind == "ends":  # a text and the same with zero bytes after it
        return ["a" * i + "\0" * j for i in range(14) for j in range(12)]
    return [None, *("".join(rnd.choice("aé日😀z") for _ in range(rnd.randrange(1, 9))) for _ in range(300))]


@pytest.mark.parametrize("direct_rows", [3, 200_000])
@pytest.mark.parametrize("kind", ["long", "nested", "ends", "mixed"])
def test_cut_on_text_keys(spark, kind, direct_rows):
    values = list(dict.fromkeys(texts(kind)))
    random.Random(1).shuffle(values)
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "id long, k string").coalesce(2).cache()
    for position in [0, len(rows) // 3, len(rows) - 1]:
        got = df.filter(ranks.at_or_after(df, ["k"], position, direct_rows))
        assert sorted(r["id"] for r in got.collect()) == keys_from(rows, [1], position)
    assert df.filter(ranks.at_or_after(df, ["k"], len(rows), direct_rows)).count() == 0


def test_text_keys_take_few_passes(spark, monkeypatch):
    n, seen, search = 20_000, [], ranks.order_statistics
    monkeypatch.setattr(ranks, "order_statistics", lambda *a, **k: seen.append(a) or search(*a, **k))
    df = spark.range(n).select("id", F.concat(F.lit("p" * 160), F.sha2(F.col("id").cast("string"), 256)).alias("k"))
    order = [r["id"] for r in df.orderBy("k").select("id").collect()]
    got = df.filter(ranks.at_or_after(df, ["k"], 15_000, direct_rows=50))
    assert {r["id"] for r in got.collect()} == set(order[15_000:])
    assert len(seen) == 1


def test_text_then_number(spark):
    rows = [(i, ["b" * 30, "b" * 31, None][i % 3], i * 7919 % 1000) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    for position in [40, 130, 260]:
        got = df.filter(ranks.at_or_after(df, ["k", "v"], position, direct_rows=2))
        assert sorted(r["id"] for r in got.collect()) == keys_from(rows, [1, 2], position)


def test_long_texts_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(ranks, "DIRECT_BYTES", 1000)
    rows = [(i, f"{i:03d}" + "y" * 300) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k string")
    got = split.ordered_split(df, "k", 0.5).filter("split = 'test'")
    assert {r["id"] for r in got.collect()} == set(range(30, 60))


@pytest.mark.parametrize("level", [256, 4, 3])
def test_running_totals_in_levels(spark, monkeypatch, level):
    monkeypatch.setattr(ranks, "LEVEL_BUCKETS", level)
    rnd = random.Random(level)
    values = sorted({rnd.gauss(0, 1) for _ in range(590)} | {float("inf"), -float("inf"), 0.0, 1e300, -1e300})
    rows = [(rnd.choice("ab"), v, rnd.randrange(9)) for v in values]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = ranks.running_totals(df, ["g"], "v", {"w": "total"}, len(rows), bucket_rows=20)
    found = {(r["g"], r["v"]): r["total"] for r in got.collect()}
    assert len(found) == len(rows)
    for group in "ab":
        total = 0
        for g, v, w in sorted(rows, key=lambda r: -r[1]):
            if g == group:
                total += w
                assert found[g, v] == total


def test_buckets_of_levels_follow_the_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "LEVEL_BUCKETS", 8)
    df = spark.range(4000).select(F.when(F.col("id") % 1000 != 7, F.col("id") * F.col("id") / 7.0).alias("v"))
    df = df.union(spark.createDataFrame([(float("nan"),)], "v double"))
    got = ranks._value_buckets(df, "v", 60).groupBy("_b").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("_b").collect()
    assert len(got) > 50 and max(r["n"] for r in got) < 200
    assert all(a["high"] < b["low"] for a, b in zip(got, got[1:], strict=False) if a["high"] is not None)
    assert ranks._value_buckets(df, "v", 60).filter("v is null").select("_b").distinct().collect() == [(0,)]
    assert ranks._value_buckets(df.filter("false"), "v", 60).count() == 0


def test_running_totals_with_ties_in_turn(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), rnd.randrange(40) / 4, turn, rnd.randrange(5)) for turn in range(3) for _ in range(120)]
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "g string, v double, turn int, w long")
    got = ranks.running_totals(df, ["g"], "v", {"w": "total"}, len(rows), bucket_rows=20, then=["turn"])
    found = {(r["g"], r["v"], r["turn"]): r["total"] for r in got.collect()}
    for group in "ab":
        total = 0
        for g, v, turn, w in sorted(rows, key=lambda r: (-r[1], r[2])):
            if g == group:
                total += w
                assert found[g, v, turn] == total


def test_neighbour_information_counts_in_buckets(spark, monkeypatch):
    from sievewright.operators import select

    rnd = random.Random(9)
    rows = [(i, rnd.choice([0, 0, 1, 2]), rnd.gauss(0, 1), None if i % 9 == 0 else rnd.randrange(12) / 3) for i in range(400)]
    df = spark.createDataFrame([(i, y, a + y, b) for i, y, a, b in rows], "row_id long, y int, a double, b double")
    scores = lambda: {r["feature"]: r["mi_score"] for r in select.mutual_info_knn(df, ["a", "b"], "y").collect()}
    whole, total = scores(), ranks.running_totals
    monkeypatch.setattr(select, "running_totals", lambda *a, **k: total(*a, **k, bucket_rows=50))
    assert scores() == pytest.approx(whole, abs=1e-12) and whole["a"] > 0.1
