import random

import numpy as np
import pytest

from sievewright.llm import minhash
from sievewright.llm.components import components


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """{row: (n, component)} by comparing all pairs; rows of one id are one node."""
    sets = [shingle_set(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (a, _) in enumerate(rows):
        for y, (b, _) in enumerate(rows[:x]):
            if a is not None and b is not None and sets[x] and sets[y]:
                common = len(sets[x] & sets[y])
                if 100 * common >= 75 * (len(sets[x]) + len(sets[y]) - common):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return [(i, len(s), None if i is None else find(i) if s else i) for (i, _), s in zip(rows, sets, strict=True)]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_groups_of_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)  # many blocks per band
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(4):
        base = rnd.choices(words, k=120)
        for edits in (0, 0, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 6, 7, 7, 8, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((rnd.randrange(10**6), " ".join(copy)))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (None, "one two"), (None, None),
        (7, "É a b c d"), (8, "é a b c d"), (9, "a\x0bb\x0cc\rd e f"), (9, "a\x0bb\x0cc\rd e f"), (10, "a b c d e f"),
        (11, "x " * 6000), (12, "x x x x x"), (13, "a\xa0b c d e"), (14, " ".join(map(str, range(20_000)))), (4, "other text"),
    ]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    hashes, universal = minhash._WordHashes(), minhash._universal()
    for keep in (0.9, 0.75, 0.5):
        words = rng.integers(0, 10**9, 4000)
        other = np.concatenate([words[: int(4000 * keep)], rng.integers(0, 10**9, int(4000 * (1 - keep)))])
        a, b = (minhash.shingles(" ".join(map(str, w)), hashes) for w in (words, other))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        guess = (minhash.signature(a, *universal) == minhash.signature(b, *universal)).mean()
        assert abs(exact - guess) < 0.16


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(70)]
    edges += [(500, i) for i in range(501, 540)] + [(7, 7), (3, 4), (4, 3)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert dict(components(df).collect()) == {i: find(i) for i in root if i not in loops}
    assert components(df.filter("a > 9999")).count() == 0
