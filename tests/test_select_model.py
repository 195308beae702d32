import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import model, select


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    n = 600
    y = rng.integers(0, 3, n)
    a = rng.normal(size=n) + y
    return {
        "a": a, "twice": 2 * a + 1, "minus": -a, "noise": rng.normal(size=n), "flat": np.full(n, 0.1),
        "steps": rng.integers(0, 5, n).astype(float),
    }, y


@pytest.fixture(scope="module")
def frame(spark, table):
    x, y = table
    rows = [(i, int(y[i]), *[float(x[c][i]) for c in x]) for i in range(len(y))]
    return spark.createDataFrame(rows, "row_id bigint, y int, " + ", ".join(f"{c} double" for c in x)).persist()


NAMES = ["a", "twice", "minus", "noise", "flat", "steps"]


def test_variance(frame, table):
    got = {r[0]: r[1] for r in select.variance_table(frame, NAMES).collect()}
    assert got == pytest.approx({c: table[0][c].var() if c != "flat" else 0.0 for c in NAMES})
    kept, names = select.variance_filter(frame, NAMES)
    assert names == [c for c in NAMES if c != "flat"] and "flat" not in kept.columns


def test_correlations_with_gaps_and_without(frame, table):
    x, _ = table
    gaps = frame.withColumn("noise", F.when(F.col("row_id") % 3 == 0, None).otherwise(F.col("noise")))
    mask = np.arange(600) % 3 != 0
    got = {(r["feature_i"], r["feature_j"]): r["r"] for r in select.correlation_matrix(gaps, NAMES).collect()}
    assert got[("a", "noise")] == pytest.approx(np.corrcoef(x["a"][mask], x["noise"][mask])[0, 1])
    assert got[("a", "minus")] == pytest.approx(-1.0) and got[("flat", "steps")] is None
    many = frame.select(*NAMES, *[(F.col("noise") * i + F.col("a")).alias(f"m{i}") for i in range(15)])
    wide = {(r["feature_i"], r["feature_j"]): r["r"] for r in select.correlation_matrix(many).collect()}
    assert len(wide) == 21 * 20 // 2 and wide[("a", "flat")] is None
    assert wide[("a", "m3")] == pytest.approx(np.corrcoef(x["a"], 3 * x["noise"] + x["a"])[0, 1])
    dropped = select.correlation_filter(frame, NAMES)[1]
    assert dropped == ["twice", "minus"]


def brute_knn_mi(c, y, k=3):
    """Ross (2014) by sorting all distances."""
    def digamma(n):
        return -0.5772156649015329 + sum(1 / i for i in range(1, n))

    c = c / c.std()
    total = []
    for i in range(len(c)):
        own = np.sort(np.abs(c[y == y[i]] - c[i]))[1:]
        kk = min(k, len(own))
        m = (np.abs(c - c[i]) < own[kk - 1]).sum()
        total.append(digamma(kk) - digamma((y == y[i]).sum()) - digamma(m))
    return max(0.0, digamma(len(c)) + np.mean(total))


def test_knn_information(frame, table, monkeypatch):
    x, y = table
    got = {r[0]: r[1] for r in select.mutual_info_knn(frame, ["a", "noise"], "y").collect()}
    for c in ("a", "noise"):
        assert got[c] == pytest.approx(brute_knn_mi(x[c], y), abs=1e-6)
    # small blocks and buckets must not change anything
    monkeypatch.setattr(select._reach, "__defaults__", (7,))
    monkeypatch.setattr(select.running_totals, "__defaults__", (50,))
    again = {r[0]: r[1] for r in select.mutual_info_knn(frame, ["a", "noise"], "y").collect()}
    assert again == pytest.approx(got, abs=1e-9)


def test_ranking(frame):
    ranked = [r["feature"] for r in select.mutual_info_ranking(frame, NAMES, "y").collect()]
    assert set(ranked[:3]) == {"a", "twice", "minus"} and len(ranked) == 6
    assert select.mutual_info_ranking(frame, NAMES, "y", 2).count() == 2
    with pytest.raises(ValueError):
        select.mutual_info_ranking(frame, NAMES, "y", method="other")


def test_logistic_regression_is_at_the_optimum(frame, table, tmp_path):
    x, y = table
    rows = frame.withColumn("y", (F.col("y") > 0).cast("int"))
    fitted = model.train_logistic_regression(rows, ["a", "noise"], "y", tol=1e-10)
    stage = model.coefficients(fitted)
    b, b0 = np.array(stage.coefficients), stage.intercept
    t = (y > 0).astype(float)
    w = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (1 - t).sum()))
    m = np.column_stack([x["a"], x["noise"]])
    p = 1 / (1 + np.exp(-(m @ b + b0)))
    assert np.abs(b + m.T @ (w * (p - t))).max() < 1e-3
    assert abs((w * (p - t)).sum()) < 1e-3
    model.save_model(fitted, str(tmp_path / "lr"))
    loaded = model.load_model(str(tmp_path / "lr"))
    scored = model.score(rows, loaded).select("row_id", "p").orderBy("row_id").collect()
    assert [r["p"] for r in scored] == pytest.approx(list(p), abs=1e-9)


def test_tuning_holds_out_rows_and_does_not_refit(frame):
    from sievewright.operators.split import stratified_split

    tuned = model.fit_and_tune(frame, ["a", "noise"], "y", tune=True, tune_size=0.2)
    assert 0.01 <= tuned.threshold <= 0.99 and tuned.tuning["f1"] > 0.5
    binary = model.binary_from_codes(frame, "y")
    part = stratified_split(binary, "y", 0.2).filter("split = 'train'")
    alone = model.train_logistic_regression(part, ["a", "noise"], "y")
    assert np.array(model.coefficients(tuned.model).coefficients) == pytest.approx(
        np.array(model.coefficients(alone).coefficients), rel=1e-4
    )
    plain = model.fit_and_tune(frame, ["a"], "y", threshold=0.3)
    assert plain.threshold == 0.3 and plain.tuning is None
    got = model.predict(binary, plain)
    assert got.filter((F.col("p") >= 0.3) != (F.col("prediction") == 1)).count() == 0
    with pytest.raises(ValueError):
        model.fit_and_tune(frame, ["a"], "y", model="rf")
