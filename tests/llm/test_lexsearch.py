import math
import re
from collections import Counter

import numpy as np
import pytest

from sievewright.llm import lexsearch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    texts = {}
    for i, t in items:
        if t is not None:
            texts[i] = min(texts.get(i, t), t)
    out = []
    for item, text in texts.items():
        scored = []
        for doc, c, n in counted:
            m = 25 + (75 * n * total) // length
            s = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms(text) if t in c
            )
            if s > 0:
                scored.append((-s, doc is None, doc))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(scored[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, filtered=True):
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, shelf int, m int")
    i = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, term int, doc_id int")
    index = lexsearch.build_index(d, i if filtered else None)
    return sorted((tuple(r) for r in lexsearch.search(index, i).collect()), key=str)


def corpus(n=300):
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in ("Wort", "été", "x", "日本", "A1") for b in range(40)]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    weights /= weights.sum()

    def text(size):
        return "".join(rng.choice(vocabulary, p=weights) + str(rng.choice([" ", ", ", "-", "\n", "_"])) for _ in range(size))

    docs = [(int(i), text(int(rng.choice([1, 3, 30, 30, 200])))) for i in rng.permutation(n)]
    return docs, [(i, text(12)) for i in range(20)]


@pytest.mark.parametrize("shelf,filtered", [(16, True), (2048, False)])
def test_brute_force(spark, monkeypatch, shelf, filtered):
    monkeypatch.setattr(lexsearch, "SHELF", shelf)
    monkeypatch.setattr(lexsearch, "ITEMS", 7)
    docs, items = corpus()
    docs += [(10_000 + i, docs[5][1]) for i in range(40)]  # a stratum of ties
    assert found(spark, docs, items, filtered) == brute(docs, items)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " -- !"), (4, "alpha beta"), (4, "alpha beta"), (5, "ALPHA alpha\x00beta"), (None, "alpha beta"),
        (6, "gamma " * 100_000), (7, "É é alpha"), (8, "delta"), (9, " alpha"),
    ]
    items = [(1, "alpha alpha"), (1, "alpha"), (2, None), (3, ""), (4, "nowhere"), (None, "gamma é"), (5, "É delta\talpha"), (6, "beta " * 5000)]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs[:3], items) == found(spark, docs, []) == found(spark, [], items) == []


def test_bounds_leave_strata_out(spark):
    """Documents far longer than those that fill the ranks are not scored."""
    docs = [(i, "rare word " + "filler " * (i // 20)) for i in range(400)] + [(i, "filler") for i in range(400, 900)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = lexsearch.build_index(df)
    table = index.strata.toArrow()
    import pyarrow as pa

    items = pa.table({"item_id": [1], "terms": [["rare", "word"]], "weights": [[900, 900]]})
    hits = lexsearch._searcher(10)(None, items, table)
    assert table.num_rows > 15 and hits["visited"][0].as_py() <= 2
    assert sorted(hits["doc_id"].to_pylist()) == list(range(10))
