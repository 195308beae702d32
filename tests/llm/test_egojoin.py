import numpy as np
import pytest

from sievewright.llm import egojoin


def brute(rows, cosine):
    def usable(v):
        return bool(v) and None not in v and np.isfinite(v).all() and any(v)

    links = {i: 0 for i in range(len(rows))}
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (a, v, label) in enumerate(rows):
        for y, (b, w, other) in enumerate(rows[:x]):
            if None in (a, b, label) or label != other or not usable(v) or not usable(w) or len(v) != len(w):
                continue
            p, q = (np.array(z, float) / max(map(abs, z)) for z in (v, w))
            if p @ q / np.sqrt((p @ p) * (q @ q)) >= cosine:
                links[x] += 1
                links[y] += 1
                s, t = sorted((find(a), find(b)))
                root[t] = s
    return sorted(((a, links[i], None if a is None else find(a)) for i, (a, _, _) in enumerate(rows)), key=str)


def check(spark, rows, cosine=0.93):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, kept int")
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in egojoin.similar_vectors(df, cosine).collect()]
    assert sorted(got, key=str) == brute(rows, cosine)


@pytest.mark.parametrize("block,leaf", [(8, 4), (1024, 128)])
def test_clusters(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(egojoin, "BLOCK", block)
    monkeypatch.setattr(egojoin, "LEAF", leaf)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(90):
        v = centres[i % 6] * (1 + i) + rng.normal(size=12) * rng.choice([0.05, 0.3, 0.8])
        rows.append((int(rng.integers(0, 10**6)), v.tolist(), int(i % 2)))
    rows += [(10**7 + i, rows[0][1], rows[0][2]) for i in range(5)]
    check(spark, rows)
    check(spark, rows[:40], 0.5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [inf, 1.0], 1),
        (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1),
        (12, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (13, [1e300, 0.0], 1), (14, [-1.0, -0.0], 1), (15, [1.0, -0.0], 1), (16, [4.0], 3), (17, [5.0], 3),
    ]
    check(spark, rows)
    check(spark, [])
    check(spark, rows[:6])
