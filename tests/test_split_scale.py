import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import scale, split


@pytest.fixture(scope="module")
def flows(spark):
    return spark.range(1000).selectExpr(
        "id as row_id", "case when id % 50 = 0 then 2 when id % 5 = 0 then 1 else 0 end as y",
        "case when id % 9 = 0 then null else cast(id % 17 as double) end as a", "cast(id as double) as b",
        "3D as flat", "cast(null as double) as gone",
        "element_at(array('Monday-x', 'TUESDAY', 'friday pm', 'Saturday', 'monday friday', null), cast(id % 6 + 1 as int)) as source_file",
    )


def sizes(df, *by):
    return {tuple(r)[:-1]: r["count"] for r in df.groupBy(*by).count().collect()}


def test_quotas_follow_largest_remainder():
    assert split.stratified_quotas({"a": 100, "b": 10, "c": 2}, 0.2) == {"a": 21, "b": 2, "c": 0}
    got = split.stratified_quotas({0: 7, 1: 7, 2: 7}, 0.3)
    assert sum(got.values()) == math.ceil(21 * 0.3)
    with pytest.raises(ValueError):
        split.stratified_quotas({"a": 100, "b": 1}, 0.2)
    with pytest.raises(ValueError):
        split.stratified_quotas({"a": 3, "b": 3, "c": 3}, 0.1)


def test_stratified_split_is_stable_and_complete(spark, flows):
    one = split.stratified_split(flows, "y", 0.2)
    two = split.stratified_split(flows.repartition(13), "y", 0.2)
    pick = lambda d: {(r["row_id"], r["split"]) for r in d.collect()}
    assert pick(one) == pick(two)
    assert sizes(one, "y", "split") == {
        (0, "train"): 640, (0, "test"): 160, (1, "train"): 144, (1, "test"): 36,
        (2, "train"): 16, (2, "test"): 4,
    }
    assert pick(one) != pick(split.stratified_split(flows, "y", 0.2, seed=7))
    three = sizes(split.stratified_split(flows, "y", 0.2, 0.1), "split")
    assert three == {("train",): 700, ("val",): 100, ("test",): 200}


def test_day_split(flows):
    got = sizes(split.day_split(flows), "source_file", "split")
    assert set(got) == {
        ("Monday-x", "train"), ("TUESDAY", "train"), ("friday pm", "test"), ("Saturday", "train"),
        ("monday friday", "train"), ("monday friday", "test"), (None, "train"),
    }
    real_val = split.day_split(flows, {"train": ["tue"], "val": ["mon"], "test": ["fri"]})
    assert ("Monday-x", "val") in sizes(real_val, "source_file", "split")
    with pytest.raises(KeyError):
        split.day_split(flows.drop("source_file"))


def test_ordered_split(flows):
    got = split.ordered_split(flows, "row_id", 0.2555)
    assert {r["row_id"] for r in got.filter("split = 'test'").collect()} == set(range(745, 1000))
    assert split.ordered_split(flows, "row_id", 0.0).filter("split = 'test'").count() == 0


def test_dispatch(flows):
    for name in ("random", " Day_Based", "time_based"):
        done = split.split_dataset(flows, "y", name)
        assert "source_file" not in done.columns and "split" in done.columns
    with pytest.raises(ValueError):
        split.split_dataset(flows, "y", "other")


def as_dict(params, *names):
    return {r["feature"]: tuple(r[n] for n in names) for r in params.collect()}


@pytest.mark.parametrize("strategy", ["median", "mean", "most_frequent", "zero"])
def test_imputer_sees_training_rows_only(flows, strategy):
    rows = split.ordered_split(flows, "row_id", 0.2)
    params = as_dict(scale.fit_imputer(rows, ["a", "b", "gone"], strategy), "fill")
    a = np.array([i % 17 for i in range(800) if i % 9], dtype=float)
    values, counts = np.unique(a, return_counts=True)
    expected = {
        "median": np.median(a), "mean": a.mean(), "most_frequent": values[counts.argmax()], "zero": 0.0
    }[strategy]
    assert params["a"][0] == pytest.approx(expected)
    assert params["gone"][0] == 0.0
    changed = rows.withColumn("a", F.when(F.col("split") == "test", 1e9).otherwise(F.col("a")))
    assert as_dict(scale.fit_imputer(changed, ["a", "b", "gone"], strategy), "fill") == params
    filled = scale.apply_imputer(rows, scale.fit_imputer(rows, ["a", "gone"], strategy))
    assert filled.filter("a is null or gone is null").count() == 0


@pytest.mark.parametrize("scaler", ["standard", "robust", "minmax", "none"])
@pytest.mark.parametrize("limit", [1_000_000, 50])
def test_scalers(flows, scaler, limit, monkeypatch):
    import sievewright.functions.ranks as ranks

    monkeypatch.setattr(ranks.quantiles, "__defaults__", ("exact", limit))
    rows = split.ordered_split(flows, "row_id", 0.2)
    params = as_dict(scale.fit_scaler(rows, ["a", "b", "flat", "gone"], scaler), "center", "scale")
    a = np.array([i % 17 for i in range(800) if i % 9], dtype=float)
    q = np.percentile(a, [25, 50, 75])
    expected = {
        "standard": (a.mean(), a.std()), "robust": (q[1], q[2] - q[0]), "minmax": (0.0, 16.0),
        "none": (0.0, 1.0),
    }[scaler]
    assert params["a"] == pytest.approx(expected)
    assert params["flat"][1] == 1.0 and params["gone"] == (0.0, 1.0)


def test_unknown_names(flows):
    with pytest.raises(ValueError):
        scale.fit_imputer(flows, ["a"], "drop")
    with pytest.raises(ValueError):
        scale.fit_scaler(flows, ["a"], "other")
    assert scale.drop_incomplete(flows, ["a"]).count() == 1000 - 112
