from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sievewright.llm import mix, queries


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 0.9, "b": 0.05, "c": 0.05}, {f"s{i}": 1 + i**2 for i in range(40)}])
def test_deviation_stays_below_one_block(weights):
    shares = mix.whole_shares(weights, 1000)
    assert sum(shares.values()) == 1000 and min(shares.values()) >= 1
    had = Counter()
    for t, s in enumerate(mix.schedule(shares), 1):
        had[s] += 1
        assert all(abs(had[x] - Fraction(a * t, 1000)) < 1 for x, a in shares.items())
    assert had == shares


def rows_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, source string, position string")
    return mix.mix_sources(df, [F.col("doc_id")], **options).collect()


def check(rows, got, block):
    """Gapless positions, whole blocks of one source, every row used, passes of one source in order."""
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    used = Counter((r["doc_id"], r["source"]) for r in got if r["pass"] == 0)
    assert used == Counter((r[0], r[1]) for r in rows)
    by_place = sorted(got, key=lambda r: r["position"])
    for i in range(0, len(by_place), block):
        assert len({r["source"] for r in by_place[i : i + block]}) == 1
    for s in {r["source"] for r in got}:
        own = [(r["pass"], r["doc_id"]) for r in by_place if r["source"] == s]
        if None not in [d for _, d in own]:
            assert own == sorted(own)


@pytest.mark.parametrize("block", [1, 4])
def test_mix_of_uneven_sources(spark, block):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", None) for i in range(200)] + [(500, None, "x"), (501, "", "x")]
    got = rows_of(spark, rows, block_rows=block)
    check(rows, got, block)
    assert "position" in got[0].asDict() and isinstance(got[0]["position"], int)


def test_given_weights_repeat_small_sources(spark):
    rows = [(i, "big", None) for i in range(100)] + [(i, "small", None) for i in range(1000, 1005)]
    got = rows_of(spark, rows, weights={"big": 1, "small": 1, "other": 5}, block_rows=1)
    n = Counter(r["source"] for r in got)
    assert n["big"] >= 100 and abs(n["big"] - n["small"]) <= 1
    with pytest.raises(ValueError, match="without a weight"):
        rows_of(spark, rows, weights={"big": 1})


def test_copies_nulls_and_empty_tables(spark):
    rows = [(None, None, None)] * 5 + [(1, "a", None)] * 3
    got = rows_of(spark, rows, block_rows=2)
    assert Counter((r["doc_id"], r["source"]) for r in got if r["pass"] == 0) == Counter((r[0], r[1]) for r in rows)
    assert rows_of(spark, []) == []


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()
    got = queries.QUERIES["op1_mix"](spark, sf_dir).collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    assert Counter((r["doc_id"], r["source"]) for r in got if r["pass"] == 0) == Counter(map(tuple, rows))
    shares = mix.whole_shares({f"={s}": n**mix.TEMPER for s, n in Counter(r["source"] for r in rows).items()}, mix.FRAME)
    had, by_place = Counter(), sorted(got, key=lambda r: r["position"])
    for t in range(len(got) // mix.BLOCK_ROWS):
        had["=" + by_place[t * mix.BLOCK_ROWS]["source"]] += 1
        assert all(abs(had[s] - (t + 1) * a / mix.FRAME) < 1 for s, a in shares.items())


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"big": 1e6, "one": 1e-2, "two": 3}, {f"s{i}": (1 + i) ** 0.7 for i in range(30)}])
def test_no_drift_from_the_given_weights_over_many_frames(weights):
    names = sorted(weights)
    exact = mix.exact_shares(weights)
    shares, done, state = [exact[s] for s in names], [0] * len(names), [0] * len(names)
    total = sum(map(Fraction, weights.values()))
    entitled = [Fraction(weights[s]) / total for s in names]
    t, slots = 0, []
    for frame in range(8):
        for i in mix.deal(shares, frame * mix.FRAME, (frame + 1) * mix.FRAME, done):
            t += 1
            state[i] += 1
            slots.append(i)
            assert abs(state[i] - entitled[i] * t) < 1
        assert state == done and all(abs(n - w * t) < 1 for n, w in zip(done, entitled, strict=True))
    assert slots == list(mix.deal(shares, 0, 8 * mix.FRAME, [0] * len(names)))


def test_mix_keeps_thirds_over_many_frames(spark):
    n = 3 * mix.FRAME
    df = spark.range(3 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    got = mix.mix_sources(df, [F.col("doc_id")], block_rows=1).orderBy("position").select("source").toArrow()["source"].to_pylist()
    assert len(got) == 3 * n
    had = Counter()
    for t, s in enumerate(got, 1):
        had[s] += 1
        assert abs(3 * had[s] - t) < 3
    assert set(had.values()) == {n}


def test_one_row_beside_a_large_source_is_not_lifted(spark):
    df = spark.range(400_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "one").otherwise("big").alias("source"))
    got = mix.mix_sources(df, [F.col("doc_id")])
    n = got.filter("source = 'one'").count()
    slots = got.count() // mix.BLOCK_ROWS
    weight = 1 / (1 + 400_000**mix.TEMPER)
    assert n % mix.BLOCK_ROWS == 0 and abs(n / mix.BLOCK_ROWS - weight * slots) < 1


def test_wide_rows_mix_like_narrow_ones(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", f"text {i}" * 9, None) for i in range(150)]
    rows += [(500, "hot", None, "x"), (500, None, "hot", "x")] + [(700, "s1", "copy", None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, position string")
    got = mix.mix_rows(df, [F.col("doc_id")], block_rows=4).collect()
    narrow = mix.mix_sources(df.select("doc_id", "source"), [F.col("doc_id")], block_rows=4).collect()
    assert sorted((r["position"], r["doc_id"], r["source"]) for r in got) == sorted((r["position"], r["doc_id"], r["source"]) for r in narrow)
    used = Counter((r["doc_id"], r["source"], r["text"]) for r in got if r["pass"] == 0)
    assert used == Counter(r[:3] for r in rows)
    assert mix.mix_rows(df.limit(0), [F.col("doc_id")]).count() == 0
