import pytest
from pyspark.sql import functions as F

from sievewright.functions.ranks import (
    at_or_after,
    hash_ordinals,
    hash_quota,
    order_statistics,
    quantiles,
    running_totals,
)
from sievewright.operators import clean

INF = float("inf")


def test_infinities(spark):
    df = spark.createDataFrame(
        [(1, 1.0, INF, None), (2, INF, -INF, INF), (3, -INF, None, None), (4, 5.0, INF, -INF)],
        "i int, a double, b double, c double",
    )
    out = clean.handle_infinities(df, "clip", ["a", "b", "c"]).orderBy("i")
    assert [tuple(r)[1:] for r in out.collect()] == [
        (1.0, 0.0, None), (5.0, 0.0, 0.0), (1.0, None, None), (5.0, 0.0, 0.0)
    ]
    out = clean.handle_infinities(df, "nan", ["a", "b", "c"]).orderBy("i")
    assert [tuple(r)[1:] for r in out.collect()] == [
        (1.0, None, None), (None, None, None), (None, None, None), (5.0, None, None)
    ]
    assert clean.count_infinities(df).first()[0] == 7
    with pytest.raises(ValueError):
        clean.handle_infinities(df, "other")


def test_first_copy_survives(spark):
    rows = [
        (3, "Monday", 1.0, None), (1, "Friday", 1.0, None), (2, "Monday", -0.0, "x"),
        (5, "Friday", 0.0, "x"), (4, "Monday", 1.0, "y"),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, source_file string, v double, t string")
    for parts in (1, 7):
        out = clean.keep_first(df.repartition(parts), "row_id")
        assert sorted((r["row_id"], r["source_file"]) for r in out.collect()) == [
            (1, "Friday"), (2, "Monday"), (4, "Monday")
        ]
        by_two = clean.keep_first(df.repartition(parts), ["source_file", "row_id"], ignore=[])
        assert sorted(r["row_id"] for r in by_two.collect()) == [1, 4, 5]


def test_keep_first_is_a_hash_aggregate(spark, capsys):
    df = spark.createDataFrame([(1, 2.0, "t")], "row_id bigint, v double, t string")
    clean.keep_first(df, "row_id").explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_ignored_columns_come_from_the_first_row(spark):
    df = spark.createDataFrame([(2, "a", 1), (1, "b", 1), (3, "c", 2)], "row_id bigint, source_file string, v int")
    assert sorted(tuple(r) for r in clean.keep_first(df, "row_id").collect()) == [(1, "b", 1), (3, "c", 2)]


def test_clipping(spark):
    df = spark.createDataFrame(
        [(v, 7.0 if v and v < 9 else 0.0) for v in (1.0, 2.0, 3.0, 10.0, None)], "v double, mostly double"
    )
    assert clean.clip_bounds(df, ["v"], 1.0)["v"] == (1.75 - 3.0, 4.75 + 3.0)
    out = clean.clip_outliers(df, 1.0, ["v"])
    assert sorted((r["v"] for r in out.collect()), key=lambda x: (x is None, x)) == [1.0, 2.0, 3.0, 7.75, None]
    flat = spark.createDataFrame([(0.0,)] * 9 + [(5.0,)], "z double")
    assert {r[0] for r in clean.clip_outliers(flat, 3.0).collect()} == {0.0}
    assert {r[0] for r in clean.clip_outliers(flat, 3.0, skip_zero_iqr=True).collect()} == {0.0, 5.0}


def test_cleaning_order(spark):
    rows = [
        (1, "10.0.0.1", "1", "x"), (2, "10.0.0.2", "1", "x"), (3, "10.0.0.1", "1", "x"), (4, "10.0.0.1", "inf", "x")
    ]
    df = spark.createDataFrame(rows, "row_id bigint, `Src IP` string, ` V` string, ` Label` string")
    out = clean.clean_dataframe(df, columns_to_drop=["source_ip", "absent"])
    assert out.columns == ["row_id", "v", "label"]
    assert sorted((r["row_id"], r["v"]) for r in out.collect()) == [(1, 1.0), (2, 1.0), (4, None)]
    # addresses turned NULL first: the second row is then a copy of the first
    out = clean.clean_dataframe(df, columns_to_drop=["source_ip"], compat=True)
    assert sorted(r["row_id"] for r in out.collect()) == [1, 4]
    other = df.withColumnRenamed(" Label", "Kind")
    assert clean.clean_dataframe(other, label_column="kind").select("kind").distinct().count() == 1


# -- ranks -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all values are one value; another column has heavy tails and gaps."""
    return spark.range(9000).selectExpr(
        "id", "case when id % 3 = 0 then 5D else cast(pmod(hash(id), 1000) as double) end as a",
        "case when id % 7 = 0 then null else pow(10D, pmod(hash(id, 1), 300)) end as b",
        "cast(id % 4 as int) as g",
    ).repartition(5).persist()


def test_narrowing_search_equals_direct_quantiles(skewed):
    probs = [0.0, 0.1, 0.25, 0.333, 0.5, 0.75, 1.0]
    direct = quantiles(skewed, ["a", "b"], probs)
    for limit in (10, 500):
        narrowed = quantiles(skewed, ["a", "b"], probs, direct_rows=limit)
        for c in ("a", "b"):
            assert narrowed[c] == pytest.approx(direct[c], rel=1e-12)


def test_sketch_quantiles_are_close(skewed):
    values = quantiles(skewed, ["a"], [0.25, 0.5, 0.9], "approx")["a"]
    n = skewed.count()
    for value, p in zip(values, [0.25, 0.5, 0.9], strict=True):
        below = skewed.filter(F.col("a") < value).count() / n
        upto = skewed.filter(F.col("a") <= value).count() / n
        assert below - 0.01 <= p <= upto + 0.01


def test_all_null_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    for kw in ({}, {"direct_rows": 1}, {"mode": "approx"}):
        got = quantiles(df, ["a", "b"], [0.5], **kw)
        assert got["a"] is None and got["b"] is not None
    with pytest.raises(ValueError):
        quantiles(df, ["a"], [0.5], "other")


def test_order_statistics_by_rank(skewed):
    values = sorted(r[0] for r in skewed.select("a").collect())
    ranks = [0, 1, 17, 4500, 8998, 8999]
    got = order_statistics(skewed, [("a", r) for r in ranks], [9000] * len(ranks), 20)
    assert got == [values[r] for r in ranks]


@pytest.mark.parametrize("keys", [["a", "id"], ["s", "id"], ["d", "id"]])
def test_positions_by_key(spark, skewed, keys):
    df = skewed.selectExpr(
        "id", "a", "case when id % 5 = 0 then null else concat('name-', id % 11, repeat('é', id % 2)) end as s",
        "date_add(date'1960-01-01', cast(id % 13 as int)) as d",
    )
    order = [F.asc_nulls_first(k) for k in keys]
    listed = [r["id"] for r in df.orderBy(*order).select("id").collect()]
    for position in (0, 1, 4321, 8999):
        for limit in (100_000, 50):
            reached = {r["id"] for r in df.filter(at_or_after(df, keys, position, limit)).collect()}
            assert reached == set(listed[position:])
    assert df.filter(at_or_after(df, keys, 9000)).count() == 0


def test_hash_quota_refines_prefixes(skewed):
    counts = {g: 2250 for g in range(4)}
    quotas = {0: 0, 1: 2250, 2: 1, 3: 777}
    picks = []
    for limit in (100_000, 100, 3):
        rows = skewed.filter(hash_quota(skewed, "g", "id", 7, quotas, counts, limit))
        picks.append({r["id"] for r in rows.collect()})
        assert {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()} == {1: 2250, 2: 1, 3: 777}
    assert picks[0] == picks[1] == picks[2]


def test_ordinals_and_totals_in_buckets(skewed):
    one = hash_ordinals(skewed, "g", "id", 1, 2250)
    many = hash_ordinals(skewed, "g", "id", 1, 2250, bucket_rows=40)
    assert {(r["id"], r["ordinal"]) for r in one.collect()} == {(r["id"], r["ordinal"]) for r in many.collect()}
    table = skewed.groupBy("g", "a").count()
    plain = running_totals(table, ["g"], "a", {"count": "c"}, 9000)
    cut = running_totals(table, ["g"], "a", {"count": "c"}, 9000, bucket_rows=300)
    assert {tuple(r) for r in plain.select("g", "a", "c").collect()} == {
        tuple(r) for r in cut.select("g", "a", "c").collect()
    }
