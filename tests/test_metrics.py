import numpy as np
import pytest

from sievewright.operators import metrics
from sievewright.operators.profile import histogram, leakage_columns, missing_values, sample_rows


def tall(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def scored(spark, n=400, seed=0, levels=40):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, levels, n) / levels
    y = (rng.random(n) < p).astype(int)
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double"), y, p


def brute_areas(y, p):
    """Pairwise ROC area and threshold-by-threshold precision areas."""
    pos, neg = p[y == 1], p[y == 0]
    roc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    recall, precision = [0.0], [1.0]
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall.append((y[hit] == 1).sum() / len(pos))
        precision.append((y[hit] == 1).sum() / hit.sum())
    r, q = np.array(recall), np.array(precision)
    return roc, (np.diff(r) * (q[1:] + q[:-1]) / 2).sum(), (np.diff(r) * q[1:]).sum()


@pytest.mark.parametrize("bucket_rows", [1_000_000, 60])
@pytest.mark.parametrize("levels", [3, 40, 100_000])
def test_areas(spark, bucket_rows, levels):
    df, y, p = scored(spark, levels=levels)
    got = tall(metrics.probability_metrics(df, bucket_rows=bucket_rows))
    expected = brute_areas(y, p)
    assert (got["roc_auc"], got["pr_auc"], got["average_precision"]) == pytest.approx(expected)


def test_single_class_truth_has_no_areas(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    assert tall(metrics.probability_metrics(df)) == {}
    same = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert tall(metrics.probability_metrics(same))["roc_auc"] == 0.5


def test_curves(spark):
    df, y, p = scored(spark, levels=7)
    full = metrics.roc_points(df, drop_collinear=False).orderBy("fpr", "tpr").collect()
    assert (full[0]["fpr"], full[0]["tpr"], full[0]["threshold"]) == (0.0, 0.0, float("inf"))
    assert len(full) == 8 and (full[-1]["fpr"], full[-1]["tpr"]) == (1.0, 1.0)
    area = sum(
        (b["fpr"] - a["fpr"]) * (b["tpr"] + a["tpr"]) / 2 for a, b in zip(full, full[1:])
    )
    assert area == pytest.approx(brute_areas(y, p)[0])
    even = spark.createDataFrame(
        [(i % 2, s) for s in (0.1, 0.2, 0.3, 0.4) for i in range(4)] + [(1, 0.25)], "y int, p double"
    )
    kept = {r["threshold"] for r in metrics.roc_points(even).collect()}
    assert kept == {float("inf"), 0.4, 0.3, 0.25, 0.1}  # 0.2 repeats the step below it
    pr = metrics.pr_points(df).collect()
    assert len(pr) == 8 and pr[-1]["recall"] == 0.0 and pr[-1]["precision"] == 1.0
    assert pr[0]["baseline"] == pytest.approx(y.mean())


def test_sweep(spark):
    df, y, p = scored(spark, 500, 3, 100)
    table = {r["threshold"]: r for r in metrics.threshold_table(df).collect()}
    assert list(sorted(table)) == [float(t) for t in np.linspace(0.01, 0.99, 99)]
    for t, r in table.items():
        hit = p >= t
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (
            (y[hit] == 1).sum(), (y[hit] == 0).sum(), (y[~hit] == 1).sum(), (y[~hit] == 0).sum()
        )
    best = metrics.best_threshold(df).first()
    top = max(r["f1"] for r in table.values())
    assert best["threshold"] == min(t for t, r in table.items() if r["f1"] == top)
    own = metrics.threshold_table(df, thresholds=[0.5, -1.0, 2.0]).orderBy("threshold").collect()
    assert [r["tp"] + r["fp"] for r in own] == [500, (p >= 0.5).sum(), 0]
    edge = spark.createDataFrame([(1, -5.0), (1, 1e300), (0, 0.06), (0, float("inf"))], "y int, p double")
    assert metrics.threshold_table(edge).filter("threshold > 0.98").first()["tp"] == 1


def test_multiclass_area_skips_absent_classes(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    probs = rng.random((200, 3))
    df = spark.createDataFrame(
        [(int(a), [float(x) for x in b]) for a, b in zip(y, probs)], "y int, probabilities array<double>"
    )
    per = {r["class"]: r for r in metrics.one_vs_rest_auc(df, [0, 1, 2]).collect()}
    assert set(per) == {0, 1}
    areas = [brute_areas((y == c).astype(int), probs[:, c])[0] for c in (0, 1)]
    assert [per[c]["roc_auc"] for c in (0, 1)] == pytest.approx(areas)
    support = [(y == c).sum() for c in (0, 1)]
    got = tall(metrics.multiclass_auc(df, [0, 1, 2]))["roc_auc_ovr_weighted"]
    assert got == pytest.approx(np.average(areas, weights=support))


def test_confusion_and_report(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 1)]
    df = spark.createDataFrame(pairs, "y int, prediction int")
    table = {(r[0], r[1]): r[2] for r in metrics.confusion_table(df, labels=[0, 1, 2]).collect()}
    assert len(table) == 9 and table[(0, 1)] == 2 and table[(2, 2)] == 0
    report = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert report["0"]["recall"] == pytest.approx(5 / 7) and report["2"]["precision"] == 0.0
    assert report["1"]["precision"] == 0.5 and report["accuracy"]["f1"] == pytest.approx(8 / 11)
    assert report["macro avg"]["recall"] == pytest.approx((5 / 7 + 1 + 0) / 3)
    assert report["weighted avg"]["support"] == 11
    core = tall(metrics.core_metrics(df, task="multiclass"))
    assert core["balanced_accuracy"] == pytest.approx((5 / 7 + 1 + 0) / 3)
    none = spark.createDataFrame([(0, 0), (0, 0)], "y int, prediction int")
    flat = tall(metrics.core_metrics(none))
    assert flat["f1"] == flat["precision"] == flat["recall"] == flat["fpr"] == 0.0
    assert flat["accuracy"] == flat["balanced_accuracy"] == 1.0 and flat["tn"] == 2.0


def test_evaluate_lists_everything(spark):
    df, *_ = scored(spark)
    found = metrics.evaluate(metrics.apply_threshold(df, 0.5), "m", names={0: "BENIGN", 1: "Attack"})
    keys = [r["metric"] for r in metrics.key_metrics(found).collect()]
    assert keys == sorted(
        "accuracy balanced_accuracy precision recall f1 tp fp fn tn fpr roc_auc pr_auc average_precision".split()
    )
    classes = {r["class"] for r in found.filter("class is not null").collect()}
    assert classes == {"BENIGN", "Attack", "accuracy", "macro avg", "weighted avg"}


def test_profile(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i), 3.0) for i in range(101)],
                               "Flow_ID int, a double, flat double")
    missing = {r[0]: r[1] for r in missing_values(df).collect()}
    assert missing == {"Flow_ID": 0, "a": 26, "flat": 0, "TOTAL": 26}
    bins = histogram(df, ["Flow_ID", "flat"], bins=10).collect()
    ids = {r["bin"]: r["count"] for r in bins if r["feature"] == "Flow_ID"}
    assert ids == {**dict.fromkeys(range(9), 10), 9: 11}
    counts, edges = np.histogram([3.0] * 101, bins=10)
    flat = [r for r in bins if r["feature"] == "flat"]
    assert len(flat) == 1 and flat[0]["bin"] == counts.argmax()
    assert flat[0]["low"] == pytest.approx(edges[counts.argmax()])
    assert [r[0] for r in leakage_columns(df).collect()] == ["Flow_ID"]
    one, two = (sample_rows(d, 10, "Flow_ID").collect() for d in (df, df.repartition(7)))
    assert one == two and len(one) == 10
