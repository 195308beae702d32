import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.operators import balance, neighbors
from sievewright.operators.neighbors import nearest_neighbours


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    y = np.array([0] * 50 + [1] * 8 + [2] * 3)
    return rng.normal(size=(61, 2)) + y[:, None] * 0.7, y


@pytest.fixture(scope="module")
def frame(spark, points):
    x, y = points
    return spark.createDataFrame(
        [(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(y, x))],
        "row_id bigint, y int, a double, b double",
    ).persist()


def brute(x, k, same=None):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    if same is not None:
        d[same[:, None] != same[None]] = np.inf
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


@pytest.mark.parametrize("pivots,block_rows", [(None, 4096), (1, 7), (5, 4096), (9, 5)])
@pytest.mark.parametrize("group", [None, "y"])
def test_neighbours_equal_brute_force(frame, points, pivots, block_rows, group):
    x, y = points
    rows = frame.withColumn("features", F.array("a", "b"))
    found = nearest_neighbours(rows, rows, 2, group=group, pivots=pivots, block_rows=block_rows)
    expected, _ = brute(x, 2, y if group else None)
    got = {}
    for r in found.collect():
        got[(r["row_id"], r["rank"])] = r["nn_id"]
    assert got == {(i, j + 1): int(expected[i, j]) for i in range(61) for j in range(2)}


def test_neighbours_of_copies(spark):
    rows = spark.range(40).withColumn("features", F.array(F.lit(1.5), F.lit(2.5)))
    for kw in ({}, {"pivots": 3, "block_rows": 6}):
        found = nearest_neighbours(rows, rows, 3, "id", **kw).collect()
        assert len(found) == 120 and {r["distance"] for r in found} == {0.0}
        assert all(r["nn_id"] != r["id"] for r in found)
        assert {r["nn_id"] for r in found if r["id"] == 7} == {0, 1, 2}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_rows_are_routed(spark):
    """In clusters far apart hardly any query leaves its own block, and base rows are not shuffled again."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 6)) * 100
    x = np.repeat(centres, 40, axis=0) + rng.normal(size=(1200, 6))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    s = neighbors._shown(frame, "row_id", "features", None, None)
    index = neighbors.build_index(s, block_rows=64)
    assert len(index.pivots[""].upper) > 3
    own = neighbors.own_block(index, None, 4)
    assert "Exchange" not in plan_of(own).split("InMemoryRelation")[0]
    own = own.persist()
    blocks = index.rows.select("block").distinct().count()
    sent = neighbors.routed(index, s, own, 4).count()
    assert blocks >= 19 and sent < 0.1 * 1200 * (blocks - 1)
    index.close()
    own.unpersist()
    expected, _ = brute(x, 4)
    got = {(r["row_id"], r["rank"]): r["nn_id"] for r in nearest_neighbours(frame, frame, 4, block_rows=64).collect()}
    assert got == {(i, j + 1): int(expected[i, j]) for i in range(1200) for j in range(4)}


def test_queries_stream_past_their_block():
    """A block's queries are never held together: candidates come as they arrive, lists of blocks for a part of a batch."""
    rng = np.random.default_rng(3)

    def batch(block, asks, first, x):
        n = len(x)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.int32()), pa.array([asks] * n), pa.array(range(first, first + n)), pa.array([None] * n, pa.int32()),
             pa.array(x.tolist()), pa.array([np.inf] * n)], names=["block", "asks", "id", "tag", "vec", "bound"])

    base, asked, pulled = rng.normal(size=(30, 4)), rng.normal(size=(50, 300, 4)), []

    def batches():
        for number in (0, 1):
            pulled.append(number)
            yield pa.concat_batches([batch(number, False, 0, base[:20]), batch(number, False, 20, base[20:])])
            for i, x in enumerate(asked):
                pulled.append(number)
                yield batch(number, True, 1000 + 300 * i, x)
        yield batch(7, True, 0, asked[0])  # a block without base rows

    met = neighbors._block_candidates(2)(batches())
    out = [next(met)]
    assert len(pulled) <= 3
    out = pa.Table.from_batches([*out, *met])
    d = np.sqrt(((asked.reshape(-1, 1, 4) - base) ** 2).sum(-1))
    near = np.argsort(d, axis=1, kind="stable")[:, :2]
    assert out["nn_id"].to_pylist() == near.ravel().tolist() * 2
    assert np.allclose(out["distance"].to_numpy(), np.tile(np.take_along_axis(d, near, 1).ravel(), 2))
    assert out["met"].to_pylist() == [0] * 30_000 + [1] * 30_000


def test_meeting_holds_no_group(spark):
    rows = spark.range(60).select(F.col("id").alias("row_id"), F.array(F.rand(1), F.rand(2)).alias("features")).persist()
    s = neighbors._shown(rows, "row_id", "features", None, None)
    index = neighbors.build_index(s, block_rows=8)
    own = neighbors.own_block(index, None, 2).persist()
    assert "Group" not in plan_of(own).split("InMemoryRelation")[0]
    assert "InArrow" not in plan_of(neighbors._meet(index, neighbors.routed(index, s, own, 2), 2)).replace("MapInArrow", "")
    for cached in (own, rows, index.rows):
        cached.unpersist()


def test_other_queries_and_strange_groups(spark):
    rng = np.random.default_rng(10)
    base = [(f"b{i:03}", "xy"[i % 2], rng.normal(size=3).tolist()) for i in range(90)] + [("lone", "z", [0.0, 0.0, 0.0])]
    asked = [(f"q{i}", "xyzw"[i % 4], rng.normal(size=3).tolist()) for i in range(20)]
    schema = "row_id string, g string, features array<double>"
    found = nearest_neighbours(
        spark.createDataFrame(asked, schema), spark.createDataFrame(base, schema), 3, group="g", carry="g", block_rows=8
    ).collect()
    got = {(r["row_id"], r["rank"]): (r["nn_id"], r["nn_g"]) for r in found}
    want = {}
    for i, g, v in asked:
        near = sorted((float(np.linalg.norm(np.subtract(v, w))), j, h) for j, h, w in base if h == g)[:3]
        want.update({(i, n + 1): (j, h) for n, (_, j, h) in enumerate(near)})
    assert got == want


def test_targets_and_plan():
    counts = {0: 50, 1: 8, 2: 3}
    assert balance.over_targets(counts) == {1: 42, 2: 47}
    assert balance.over_targets(counts, "minority") == {2: 47}
    assert balance.over_targets(counts, "not majority") == {1: 42, 2: 47}
    assert balance.over_targets(counts, {1: 20}) == {1: 12}
    assert balance.over_targets({0: 50, 1: 8}, 0.5) == {1: 17}
    assert balance.under_targets(counts) == {0: 3, 1: 3, 2: 3}
    assert balance.under_targets(counts, "majority") == {0: 3, 1: 8, 2: 3}
    assert balance.under_targets(counts, {0: 10}) == {0: 10, 1: 8, 2: 3}
    for bad in ("some", {1: 5}):
        with pytest.raises(ValueError):
            balance.over_targets(counts, bad)
    with pytest.raises(ValueError):
        balance.under_targets(counts, {2: 5})
    plan = balance.plan_oversampling(counts)
    assert (plan.add, plan.neighbours, plan.tiny) == ({1: 42}, 2, (2,))
    assert balance.plan_oversampling({0: 50, 1: 3}).add == {}
    assert balance.plan_oversampling(counts, "minority").add == {2: 47}


def counts_of(df):
    return {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}


def test_random_methods(frame):
    over = balance.resample(frame, "y", ["a", "b"], "Random_Over ")
    assert counts_of(over) == {0: 50, 1: 50, 2: 50}
    assert over.select("row_id").distinct().count() == 150
    again = balance.resample(frame.repartition(9), "y", ["a", "b"], "random_over")
    assert {tuple(r) for r in over.collect()} == {tuple(r) for r in again.collect()}
    originals = {(r["y"], r["a"]) for r in frame.collect()}
    assert {(r["y"], r["a"]) for r in over.collect()} == originals
    under = balance.resample(frame, "y", ["a", "b"], "random_under")
    assert counts_of(under) == {0: 3, 1: 3, 2: 3}


def test_smote_rows_lie_between_neighbours(frame, points):
    x, y = points
    grown = balance.resample(frame, "y", ["a", "b"], "smote")
    assert counts_of(grown) == {0: 50, 1: 50, 2: 3}  # the tiny class is left alone
    near, _ = brute(x, 2, y)
    new = [r for r in grown.collect() if "#" in r["row_id"]]
    assert len(new) == 42
    for r in new:
        at = np.array([r["a"], r["b"]])
        fits = False
        for i in np.flatnonzero(y == 1):
            for j in near[i]:
                step = x[j] - x[i]
                u = (at - x[i]) @ step / (step @ step)
                fits |= -1e-9 <= u <= 1 and np.allclose(x[i] + u * step, at, atol=1e-9)
        assert fits


def test_adasyn_counts_follow_foreign_neighbours(frame, points):
    x, y = points
    plan = balance.plan_oversampling({0: 50, 1: 8, 2: 3})
    near, _ = brute(x, plan.neighbours)
    foreign = np.array([(y[near[i]] != 1).sum() for i in np.flatnonzero(y == 1)])
    expected = np.rint(foreign / foreign.sum() * 42).astype(int)
    grown = balance.resample(frame, "y", ["a", "b"], "adasyn")
    new = [r["row_id"].split("#")[1] for r in grown.collect() if "#" in r["row_id"]]
    rows = np.flatnonzero(y == 1)
    assert [new.count(str(i)) for i in rows] == list(expected)


def test_adasyn_needs_foreign_neighbours(spark):
    far = [(i, 0, float(i) / 100) for i in range(20)] + [(50 + i, 1, 1000.0 + i / 100) for i in range(8)]
    df = spark.createDataFrame(far, "row_id bigint, y int, a double")
    with pytest.raises(ValueError):
        balance.resample(df, "y", ["a"], "adasyn")


def test_adasyn_with_nothing_to_share(spark):
    near = [(i, i % 2, float(i)) for i in range(40)] + [(40, 0, 40.5)]
    df = spark.createDataFrame(near, "row_id bigint, y int, a double")
    with pytest.raises(ValueError):
        balance.resample(df, "y", ["a"], "adasyn")


def test_cleaning_methods(frame, points):
    x, y = points
    near, _ = brute(x, 3)
    mutual = {
        i for i in range(61) if near[near[i, 0], 0] == i and y[near[i, 0]] != y[i]
    }
    assert {r["row_id"] for r in balance.tomek_links(frame, "y", ["a", "b"]).collect()} == mutual
    kept = {r["row_id"] for r in balance.remove_tomek(frame, "y", ["a", "b"]).collect()}
    assert kept == set(range(61)) - mutual
    agree = {i for i in range(61) if (y[near[i]] == y[i]).all()}
    kept = {r["row_id"] for r in balance.remove_disagreeing(frame, "y", ["a", "b"]).collect()}
    assert kept == agree
    for method in ("smote_tomek", "smote_enn"):
        grown = balance.resample(frame, "y", ["a", "b"], method)
        assert grown.columns == frame.columns and 0 < grown.count() < 103


def test_only_training_rows_change(frame):
    marked = frame.withColumn("split", F.expr("case when row_id % 5 = 0 then 'test' else 'train' end"))
    done = balance.resample(marked, "y", ["a", "b"], "smote", min_class_samples=3)
    rest = {int(r["row_id"]) for r in done.filter("split = 'test'").collect()}
    assert rest == set(range(0, 61, 5))
    assert done.filter("split = 'train'").groupBy("y").count().count() == 3
    with pytest.raises(ValueError):
        balance.resample(marked, "y", ["a", "b"], "other")


def test_nothing_to_grow(spark):
    df = spark.createDataFrame([(i, 0 if i < 9 else 1, float(i)) for i in range(11)],
                               "row_id bigint, y int, a double")
    assert balance.resample(df, "y", ["a"], "smote").count() == 11


def test_weights(frame):
    weights = {r["class"]: r["weight"] for r in balance.class_weights(frame, "y").collect()}
    assert weights == pytest.approx({0: 61 / 150, 1: 61 / 24, 2: 61 / 9})
    own = balance.class_weights(frame, "y", {1: 4.0})
    assert {r["class"]: r["weight"] for r in own.collect()} == {0: 1.0, 1: 4.0, 2: 1.0}
    weighted = balance.with_weights(frame, "y", own)
    assert weighted.agg(F.sum("weight")).first()[0] == 50 + 32 + 3
    for bad in ("other", {9: 1.0}):
        with pytest.raises(ValueError):
            balance.class_weights(frame, "y", bad)
    assert balance.benign_rows(frame, "y").count() == 50
