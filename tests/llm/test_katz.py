import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import katz

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return ["<start>", *re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "<end>"]


class Plain:
    """The model over dictionaries, one probability at a time."""

    def __init__(self, texts, many):
        self.one, self.two, self.after = Counter(), Counter(), defaultdict(Counter)
        for t in texts:
            t = tokens(t)
            self.one.update(t[1:])
            for v, w in zip(t, t[1:]):
                self.two[v, w] += 1
                self.after[v][w] += 1
        self.d1, self.d2 = (self.ratios(x) for x in (self.one, self.two))
        self.n, self.many = sum(self.one.values()), many

    @staticmethod
    def ratios(counts):
        of = Counter(counts.values())
        for k in (5, 4, 3, 2):
            if all(of[r] for r in range(1, k + 2)) and (k + 1) * of[k + 1] < of[1]:
                last = (k + 1) * of[k + 1] / of[1]
                d = {r: ((r + 1) * of[r + 1] / (r * of[r]) - last) / (1 - last) for r in range(1, k + 1)}
                if all(0 < x < 1 for x in d.values()):
                    return d
        return {}

    def single(self, w):
        whole = self.n + (not self.d1)
        if w in self.one:
            return self.d1.get(self.one[w], 1) * self.one[w] / whole
        return 1 - sum(self.d1.get(c, 1) * c for c in self.one.values()) / whole

    def chance(self, v, w):
        following = self.after.get(v)
        if not following:
            return self.single(w)
        count = sum(following.values())
        total = count + (count > self.many or not any(c in self.d2 for c in following.values()))
        seen = {x: self.d2.get(c, 1) * c / total for x, c in following.items()}
        if w in seen:
            return seen[w]
        return (1 - sum(seen.values())) / (1 - sum(self.single(x) for x in seen)) * self.single(w)

    def score(self, text):
        t = tokens(text)
        base = sum(math.log10((self.one[w] + 1) / (self.n + len(self.one) + 1)) for w in t[1:])
        return len(t) - 1, sum(w in self.one for w in t[1:]), self.n, base, sum(math.log10(self.chance(v, w)) for v, w in zip(t, t[1:]))


def scored(spark, docs, train):
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, w int, score int")
    model = katz.train(df.filter(train))
    rows = katz.log_probabilities(df, model, [F.col("doc_id"), F.col("text")]).collect()
    return model, rows


def compare(rows, plain, n):
    assert len(rows) == n
    seen = {}
    for r in rows:
        want = seen.setdefault(r["text"], plain.score(r["text"]))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert (r["base_score"], r["score"]) == pytest.approx(want[3:], rel=1e-9, abs=1e-9)


def corpus(n):
    rng = np.random.default_rng(4)
    words = np.array([f"W{i}é" if i % 3 else f"w{i}" for i in range(6000)])
    p = 1 / np.arange(1, 6001)
    p /= p.sum()
    return [(i, " \t".join(rng.choice(words, int(rng.choice([1, 5, 40])), p=p))) for i in range(n)]


@pytest.mark.parametrize("known,entries,many,portion", [(1 << 20, 4_000_000, 1 << 16, 1 << 24), (20, 300, 40, 500), (0, 700, 1 << 16, 1 << 24)])
def test_plain_model(spark, monkeypatch, known, entries, many, portion):
    """Also with rare tokens outside the known ones, and with contexts and pairs that are spread."""
    for name, value in (("KNOWN", known), ("ENTRIES", entries), ("MANY", many)):
        monkeypatch.setattr(katz, name, value)
    monkeypatch.setattr(katz.splitting, "PORTION", portion)
    docs = corpus(250)
    docs += [(1000 + i, "the same passage, over and over") for i in range(150)]
    model, rows = scored(spark, docs, "doc_id % 5 <> 2")
    assert len(model.one) >= 2 and len(model.two) >= 2
    if known == 20:
        assert model.contexts and model.pairs
    compare(rows, Plain([t for i, t in docs if i % 5 != 2], many), len(docs))


def test_probabilities_of_a_context_add_up(spark):
    docs = corpus(120)
    plain = Plain([t for _, t in docs], 1 << 16)
    model, rows = scored(spark, docs, "true")
    compare(rows, plain, len(docs))
    for v in ("<start>", "w0", "w3", "w5999", "nowhere"):
        assert sum(plain.chance(v, w) for w in plain.one) + plain.chance(v, "never seen") == pytest.approx(1)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n "), (4, "a"), (4, "a"), (4, "b a"), (None, "A a"), (5, "x " * 30_000), (6, "É\x0bé\x85a"), (7, "a")]
    for train in ("true", "false", "doc_id > 3", "doc_id = 1"):
        _, rows = scored(spark, docs, train)
        chosen = [t for i, t in docs if train == "true" or (i is not None and (i > 3 if train == "doc_id > 3" else train != "false" and i == 1))]
        compare(rows, Plain(chosen, 1 << 16), len(docs))
    assert scored(spark, [], "true")[1] == []


def test_ratios():
    assert katz.discounts([100, 40, 20, 12, 8, 5]) == pytest.approx(
        [(x - 0.3) / 0.7 for x in (80 / 100, 60 / 80, 48 / 60, 40 / 48, 30 / 40)]
    )
    assert katz.discounts([100, 0, 20, 12, 8, 5]) == [] and katz.discounts([0] * 6) == []
    assert len(katz.discounts([100, 30, 10, 9, 0, 0])) in (0, 2, 3)
