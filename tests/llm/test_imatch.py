import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from sievewright.llm import imatch, queries
from sievewright.llm.following import with_next

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_next_rows(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice([None, rnd.randrange(20)]), rnd.randrange(-9, 9), str(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, t long, v string")
    got = with_next(df, "k", "t", ["k", "t"]).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    assert len(got) == n
    follows = {}
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        follows.setdefault(a[:2], set()).add(b[:2])
    for r in got:
        assert (r["next_k"], r["next_t"]) in follows[(r["k"], r["t"])]
    assert sorted(str(r[:2]) for r in order) == sorted(str((r["k"], r["t"])) for r in got)


def test_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    order = sorted(docs, key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_imatch"](spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    prints = {}
    for i, row in enumerate(order):
        after = order[(i + 1) % len(order)]["text"]
        text, half = row["text"], len(row["text"]) // 2
        edited = text[: len(text) - half] + after[:half]
        mine = got[row["doc_id"]]
        assert mine["n_chars"] == len(text)
        assert mine["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, mine["fingerprint"]) == mine["fingerprint"]
        assert 0 <= mine["near_edited"] <= 1 and 0 <= mine["near_next"] <= 1
    different = [r for i, r in enumerate(order) if r["text"] != order[(i + 1) % len(order)]["text"]]
    mean = lambda c: sum(got[r["doc_id"]][c] for r in different) / len(different)
    assert mean("near_edited") > mean("near_next") + 0.1


def plain_hash(data, seed=42):
    if isinstance(data, str):
        return xxhash.xxh64_intdigest(data.encode(), seed=seed)
    for h in data:  # a list of longs: one after the other
        seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=seed)
    return seed


def plain_fingerprints(corpus, texts):
    """Fingerprints as lists of levels, each a list of subsets' digits."""
    terms = lambda t: {plain_hash(w) for w in re.split(r"[\W_]+", t.lower()) if w}
    df = Counter(h for t in corpus for h in terms(t))
    n = len(corpus)
    band = {h for h, c in df.items() if imatch.BAND[0] <= math.log(n / c) / math.log(n) <= imatch.BAND[1]}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    result = []
    for t in texts:
        mine = terms(t)
        mine = mine & band if len(mine & band) >= imatch.LEAST_TERMS else mine
        levels = []
        for i in range(imatch.LEVELS):
            subsets = [[] for _ in range(min(4**i, imatch.PARTS))]
            for h in sorted(mine, key=signed):
                part = (h >> (63 - 8 * i)) & (4**i - 1) if i else 0
                if part < len(subsets):
                    subsets[part].append(h)
            levels.append([f"{plain_hash(s):016X}"[-4:] if s else "----" for s in subsets])
        result.append(levels)
    return result


def plain_likeness(a, b):
    if a == b:
        return 1.0
    shares = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        same = sum(p == q != "----" for p, q in zip(x, y, strict=True))
        used = sum(p != "----" or q != "----" for p, q in zip(x, y, strict=True))
        shares.append(same / max(used, imatch.LEAST_PARTS if i else 1))
    return max(shares)


def test_fingerprints_and_likeness_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    order = sorted(docs, key=lambda r: -r["doc_id"])
    texts = [r["text"] or "" for r in order]
    after = [*texts[1:], texts[0]]
    edited = [t[: len(t) - len(t) // 2] + s[: len(t) // 2] for t, s in zip(texts, after, strict=True)]
    own, changed = plain_fingerprints(texts, texts), plain_fingerprints(texts, edited)
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_imatch"](spark, SF_DIR).collect()}
    text_of = lambda levels: "".join(d for level in levels for d in level)
    for i, row in enumerate(order):
        mine = got[row["doc_id"]]
        assert mine["fingerprint"] == text_of(own[i])
        assert mine["edited_fingerprint"] == text_of(changed[i])
        assert mine["near_edited"] == pytest.approx(plain_likeness(own[i], changed[i]), abs=1e-12)
        assert mine["near_next"] == pytest.approx(plain_likeness(own[i], own[(i + 1) % len(own)]), abs=1e-12)


@pytest.mark.parametrize("frequent", [0, imatch.FREQUENT_TERMS])
def test_large_lexicons_are_joined_with_the_same_result(spark, monkeypatch, frequent):
    monkeypatch.setattr(imatch, "FREQUENT_TERMS", frequent)
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "a")], "doc_id long, text string"))
    words = imatch.lexicon(df)
    assert words.filter("not frequent").count() > 100
    held = imatch.with_fingerprint(df, words, "text", "fp")
    joined = imatch.with_fingerprint(df, words, "text", "fp", local_terms=0)
    assert held.exceptAll(joined).count() == 0 == joined.exceptAll(held).count()


def test_odd_texts(spark):
    rows = [(1, None, 9), (1, "", 9), (2, "...", 9), (3, "a", 9), (3, "a", 9), (4, "w " * 9000 + "é x1 日本", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    words = imatch.lexicon(df)
    got = imatch.with_fingerprint(df, words, "text", "fp").collect()
    assert len(got) == 6
    assert got[0]["fp"] == got[1]["fp"] == got[2]["fp"] and set(got[0]["fp"]) == {"-"}
    assert got[3]["fp"] == got[4]["fp"] != got[5]["fp"]
    empty = df.filter("doc_id > 99")
    assert imatch.with_fingerprint(empty, imatch.lexicon(empty), "text", "fp").count() == 0


def test_small_edits_stay_alike(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [[rnd.choice(vocabulary) for _ in range(300)] for _ in range(60)]
    near = [[*t[:-5], *rnd.choices(vocabulary, k=5)] for t in texts]
    rows = [(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(zip(texts, near, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, near string")
    words = imatch.lexicon(df)
    both = imatch.with_fingerprint(imatch.with_fingerprint(df, words, "text", "a"), words, "near", "b")
    assert both.agg(F.avg(imatch.likeness("a", "b"))).first()[0] > 0.6


def test_rare_terms_stay_out_of_the_band_whatever_the_vocabulary(spark):
    # 64 terms a document seen once, 5 million in all, above 4 million hash slots; all documents share eight terms of the band
    n, once = 80_000, 64
    rare = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(once - 1)), lambda i: F.concat(F.lit("r"), F.col("id") * once + i)), " ")
    mid = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit("m"), F.col("id") % 500, F.lit("x"), i)), " ")
    df = spark.range(0, n, 1, 8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the of"), mid, rare).alias("text"))
    words = imatch.lexicon(df)
    want = spark.range(500).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.xxhash64(F.concat(F.lit("m"), F.col("id"), F.lit("x"), i)))).alias("term"))
    assert words.filter("not frequent").count() == 4000 == words.filter("not frequent").join(want, "term", "left_semi").count()
    assert words.filter("frequent").count() == 2
    some = df.filter("doc_id < 2000")
    got = imatch.with_fingerprint(some, words, "text", "fp").groupBy(F.col("doc_id") % 500).agg(F.countDistinct("fp").alias("n"))
    assert got.filter("n > 1").count() == 0


def test_no_row_carries_the_lexicon(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}x{j % 9}" for j in range(40))) for i in range(200)]
    df = spark.createDataFrame([*rows, (200, None), (201, "w1x1 w2x2")], "doc_id long, text string")
    words = imatch.lexicon(df)
    assert words.filter("not frequent").count() > 5
    done = imatch.with_fingerprint(df, words, "text", "fp")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    # the hash table is a subquery within the look-up, not a column that is copied into every row
    assert "scalar-subquery" in plan and "AS __table" not in plan
    texts = [r["text"] or "" for r in df.orderBy("doc_id").collect()]
    want = ["".join(d for level in levels for d in level) for levels in plain_fingerprints(texts, texts)]
    assert [r["fp"] for r in done.orderBy("doc_id").collect()] == want


def test_likeness_of_single_subsets(spark):
    size = sum(imatch._subsets(i) for i in range(imatch.LEVELS))
    rnd, rows = random.Random(8), []
    for _ in range(200):
        a = [rnd.choice(["0A1F", "33BC", imatch.NONE]) for _ in range(size)]
        b = [x if rnd.random() < 0.5 else rnd.choice(["0A1F", "FFFF", imatch.NONE]) for x in a]
        rows.append(("".join(a), "".join(b)))
    rows += [(imatch.NONE * size,) * 2, (imatch.NONE * size, rows[0][0]), (rows[1][0], rows[1][0])]
    levels = [sum(imatch._subsets(j) for j in range(i)) for i in range(imatch.LEVELS + 1)]
    cut = lambda s: [[s[k * 4 : k * 4 + 4] for k in range(x, y)] for x, y in zip(levels, levels[1:])]  # noqa: B905, E731
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", imatch.likeness("a", "b").alias("l")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["l"] == pytest.approx(plain_likeness(cut(r["a"]), cut(r["b"])), abs=1e-12)
