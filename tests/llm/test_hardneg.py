import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import hardneg


def brute(rows, positives=5, negatives=10):
    usable = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) for x in v]
        usable[i] = min(usable.get(i, (str(label), v)), (str(label), v))
    out = []
    for a, (label, q) in usable.items():
        if a % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in usable.items() if i != a and len(v) == len(q)]
        for ps, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and 30 * -ps <= 100 * -x[0] <= 90 * -ps)
            out += [(a, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, score int, block int")
    found = hardneg.hard_negatives(df, F.expr("vec_id % 10 = 0"), F.col("label"), **options)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("block,words", [(16, 4), (8192, 32)])
def test_brute_force(spark, monkeypatch, block, words):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "ANCHORS", 7)
    monkeypatch.setattr(hardneg, "WORDS", words)
    monkeypatch.setattr(hardneg, "BATCH", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 7))
    rows = [(i, (centres[i % 5] + rng.normal(size=7) * rng.choice([0.1, 0.6])).tolist(), int(rng.integers(3))) for i in range(150)]
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(30)]  # ties
    rows += [(2000 + i, rows[3][1], 7 + i % 2) for i in range(30)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (10, None, 1), (20, [nan, 1.0], 1), (30, [inf, 1.0], 1), (40, [None, 1.0], 1), (50, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
        (60, [1.0, 1.0], 1), (60, [1.0, 1.0], 1), (61, [1.0, 1.0], 1), (61, [0.5, 1.0], 1), (62, [0.4, 0.5], 2), (63, [0.0, 0.0], 2),
        (64, [-1.0, -1.0], 1), (70, [0.0, 0.0], 2), (71, [1.0, 1.0, 1.0], 2), (80, [], 5), (81, [], 5), (82, [], 6), (90, [3.0], 9),
        (91, [2.0], 9), (92, [1.0], 8), (93, [1e5], 8),
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows[:6]) == mined(spark, []) == []


def test_large_scores_stay_whole(spark):
    rows = [(10, [4e6, 4e6 + 1 / 256], 1), (11, [4e6, 4e6], 1), (12, [2e6, 2e6 + 1 / 256], 2), (13, [2e6, 2e6], 2)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="a component is beyond"):
        mined(spark, [(10, [1e9], 1)])


def test_cells_are_left_out():
    """The heap stops early where clusters lie far apart."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 1000
    x = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 8)) * 5).astype(np.int32)
    import pyarrow as pa

    words = (hardneg.codebook(x[:, :4].astype(float)), hardneg.codebook(x[:, 4:].astype(float)))
    i, j = (hardneg._nearest(h.astype(float), w).astype(np.int32) for h, w in zip((x[:, :4], x[:, 4:]), words))
    table = pa.table({"id": np.arange(2000), "i": i, "j": j, "vector": [v.tobytes() for v in x]})
    cells = hardneg.Cells(table, 8, np.zeros(2000, int), words)
    best = hardneg.Best(5)
    scored = hardneg.fill(cells, x[0].astype(np.int64), 0, 0, [best], True)
    s = x.astype(np.int64) @ x[0].astype(np.int64)
    s[0] = -(2**62)
    assert best.scores.tolist() == sorted(s.tolist(), reverse=True)[:5]
    assert scored < 500
