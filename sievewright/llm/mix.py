"""Mix sources to target weights by Pfair scheduling.

Time is cut into slots, each of which takes one block of rows of one source. The j-th block of a
source with weight w is released at floor(j / w) and due at ceil((j + 1) / w); the earliest deadline goes first.
At every slot each source has then had within one block of what its weight entitles it to, however long
the table: weights are exact fractions, nothing is rounded and nothing repeats. The driver walks through the slots once
and keeps how many blocks every source had at the start of each frame; tasks deal the frames again from there.

The mix lasts until every row of every source was used once; sources that are through earlier begin another pass.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Callable, Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.numbering import number_rows
from sievewright.session import small_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Slots that a task deals at a time; grows to 8 per source when there are many sources. The mix does not depend on it.
FRAME = 4096
MOST_SOURCES = 20_000
BLOCK_ROWS = 8
#: Default weights are row counts to this power.
TEMPER = 0.7
#: A source may be repeated so often; beyond it the weights are called wrong.
MOST_PASSES = 10_000
#: Partitions of the frames.
MOST_TASKS = 2000


def whole_shares(weights: Mapping[str, float], frame: int) -> dict[str, int]:
    """Slots per frame, at least one each, in all ``frame``; largest remainders get what is left.

    For schedules of a fixed length only: `mix_sources` uses `exact_shares`.
    """
    if len(weights) > frame:
        raise ValueError("more sources than slots")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total, free = sum(weights.values()), frame - len(weights)
    exact = {s: w / total * free for s, w in weights.items()}
    shares = {s: 1 + int(x) for s, x in exact.items()}
    rest = sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in rest[: frame - sum(shares.values())]:
        shares[s] += 1
    return shares


def exact_shares(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the weights (a float is a fraction)."""
    if any(not 0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive")
    parts = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(x.denominator for x in parts.values()))
    whole = {s: int(x * common) for s, x in parts.items()}
    shared = math.gcd(*whole.values())
    return {s: x // shared for s, x in whole.items()}


def deal(shares: list[int], start: int, stop: int, done: list[int]) -> Iterator[int]:
    """The source (a place in ``shares``) of every slot from ``start`` to before ``stop``.

    ``done`` holds the blocks that every source had before ``start``, and is counted up.
    """
    total = sum(shares)
    waiting = [(done[i] * total // a, i) for i, a in enumerate(shares)]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for now in range(start, stop):
        while waiting and waiting[0][0] <= now:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[i] + 1) * total // shares[i]), i))
        due, i = heapq.heappop(ready)
        if due <= now:
            raise AssertionError("a block missed its deadline")
        done[i] += 1
        heapq.heappush(waiting, (done[i] * total // shares[i], i))
        yield i


def schedule(shares: Mapping[str, int]) -> list[str]:
    """The source of every slot of a frame of ``sum(shares)`` slots."""
    names = sorted(shares)
    return [names[i] for i in deal([shares[s] for s in names], 0, sum(shares.values()), [0] * len(names))]


def _walk(shares: list[int], need: list[int], frame: int) -> tuple[list[tuple[int, bytes]], list[int], int]:
    """Frames, blocks per source and slots of the run in which every source gets the blocks it needs.

    A frame is its first slot and, one byte per source, the blocks had by then above the whole part of the entitlement
    (0 or 1).
    """
    total, done, left, frames, start = sum(shares), [0] * len(shares), len(shares), [], 0
    while True:
        frames.append((start, bytes(d - start * a // total for d, a in zip(done, shares, strict=True))))
        for slot, i in enumerate(deal(shares, start, start + frame, done), start):
            left -= done[i] == need[i]
            if not left:
                return frames, done, slot + 1
        start += frame


def _dealer(shares: list[int], frame: int, end: int) -> Callable:
    """(source, block, slot) of every slot of the frames that a task gets."""
    total = sum(shares)
    names = ["__index", "__block", "__slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, above in zip(batch["start"].to_pylist(), batch["above"].to_pylist(), strict=True):
                done = [start * a // total + x for a, x in zip(shares, above, strict=True)]
                rows = [(i, done[i] - 1, at) for at, i in enumerate(deal(shares, start, min(start + frame, end), done), start)]
                columns = zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=names)

    return run


def mix_sources(
    df: DataFrame, order: list[Column], source: str = "source", weights: Mapping[str | None, float] | None = None,
    block_rows: int = BLOCK_ROWS, frame: int = FRAME,
) -> DataFrame:
    """``df`` with ``position`` (long, gapless from 0) and ``pass`` (int, from 0).

    Within a source rows follow ``order`` (a hash gives a reproducible shuffle), in blocks of ``block_rows``; the last
    block of a pass goes on with the first rows of the next, so all blocks are full. Every row occurs at least
    once. ``weights`` name every source of the table (others are ignored); without them they are the row counts
    to the power `TEMPER`, which lifts small sources. NULL is a source like any other; an empty table stays
    empty; columns named position or pass are replaced. Rows that differ in no column are rows of their own.
    """
    spark = df.sparkSession
    plain = df.drop("position", "pass")
    named = plain.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    counts = dict(named.groupBy("__source").count().limit(MOST_SOURCES + 1).collect())
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not counts:
        return plain.select("*", F.lit(0).cast("long").alias("position"), F.lit(0).alias("pass"))
    if weights is None:
        wanted = {s: n**TEMPER for s, n in counts.items()}
    else:
        given = {"" if s is None else f"={s}": w for s, w in weights.items()}
        if missing := sorted(counts.keys() - given.keys()):
            raise ValueError(f"sources without a weight: {missing[:5]}")
        wanted = {s: given[s] for s in counts}
    frame = max(frame, 8 * len(counts))
    names = sorted(counts, key=str.encode)
    exact = exact_shares(wanted)
    shares = [exact[s] for s in names]
    total = sum(shares)
    need = [-(-counts[s] // block_rows) for s in names]
    least = max((n - 1) * total // a + 1 for n, a in zip(need, shares, strict=True))  # slots of the run at least
    for s, a in zip(names, shares, strict=True):
        if least * a // total * block_rows > MOST_PASSES * counts[s]:
            raise ValueError(f"source {s[1:]!r} would be repeated more than {MOST_PASSES} times")
    frames, done, end = _walk(shares, need, frame)
    start, facts = 0, []
    for i, s in enumerate(names):
        facts.append((s, i, start, counts[s], done[i] * block_rows))
        start += counts[s]
    # a fixed size: MOST_SOURCES rows
    sources = small_table(spark, facts, "__source string, __index int, __start long, __n long, __used long")
    # one row per frame; its slots are dealt by a task
    begun = small_table(spark, frames, "start long, above binary").repartition(min(len(frames), MOST_TASKS), "start")
    slots = begun.mapInArrow(_dealer(shares, frame, end), "__index int, __block long, __slot long")
    numbered = number_rows(named, [F.col("__source"), *order], "__row").join(F.broadcast(sources), "__source")
    at = F.col("__row") - F.col("__start")
    passes = numbered.withColumn("__at", at).withColumn(
        "pass", F.explode(F.expr("sequence(0, cast((__used - __at - 1) div __n as int))"))
    )
    dealt = passes.withColumn("__go", F.col("pass") * F.col("__n") + F.col("__at")).withColumn(
        "__block", F.expr(f"__go div {block_rows}")
    )
    position = F.expr(f"__slot * {block_rows} + __go % {block_rows}")
    # the planner takes the slots for as small as the frames and would broadcast them
    return dealt.join(slots.hint("merge"), ["__index", "__block"]).select(
        *plain.columns, position.cast("long").alias("position"), "pass"
    )


def mix_rows(df: DataFrame, order: list[Column], source: str = "source", **options) -> DataFrame:
    """`mix_sources` for wide rows: keys of rows are mixed, and the rows join them once.

    A row's key is 128 bits of all its columns; equal rows are interchangeable, so one of them stands for all. ``options`` and
    results are those of `mix_sources`.
    """
    plain = df.drop("position", "pass")
    cells = [x for c in plain.columns for x in (F.col(c), F.col(c).isNull())]
    keys = [F.xxhash64(F.lit(seed), *cells).alias(f"__key{seed}") for seed in (0, 1)]
    ordered = [c.alias(f"__order{i}") for i, c in enumerate(order)]
    narrow = plain.select(*keys, F.col(source).alias("__named"), *ordered)
    mixed = mix_sources(narrow, [F.col(f"__order{i}") for i in range(len(order))], "__named", **options)
    places = mixed.select("__key0", "__key1", "position", "pass")
    rows = plain.select(*keys, "*").dropDuplicates(["__key0", "__key1"])
    return rows.join(places, ["__key0", "__key1"]).select(*plain.columns, "position", "pass")
