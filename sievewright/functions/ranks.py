"""Ranks without a global sort: order statistics, quantiles, quotas, ordinals, running totals.

Nothing here puts a whole table, column or class behind one task. Each function first narrows
the question with small mergeable summaries (sketches, hash-prefix counts, bucket sums) and
then touches only a bounded remainder. All answers are exact and independent of partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions.hashing import row_hash
from sievewright.session import stage

DIRECT_ROWS = 1_000_000  # values one task may hold
SKETCH_K = 8192
SKETCH_ERROR = 0.0015  # rank slack asked of a sketch of that size, twice its usual error
SALTS = 256
LEVEL_BUCKETS = 256  # value buckets of one level; a sketch errs by a fraction of one


# -- order statistics -------------------------------------------------------------------


@dataclass(frozen=True)
class _Target:
    """Search state for the value of ascending ``rank`` in ``column``: it lies in (low, high).

    Targets of one ``pair`` (the two ranks of a quantile) are counted together while their interval is the same.
    """

    key: int
    pair: int
    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int
    value: float | None = None

    def interval(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high

    def group(self) -> tuple:
        return self.pair, *self.interval()


def _matched(df: DataFrame, intervals: list[tuple[str, float, float]]) -> DataFrame:
    """``(g, v)``: every value with the number of each interval it lies in; others are dropped before they multiply."""
    columns = list(dict.fromkeys(c for c, _, _ in intervals))
    of_column = [
        F.array(*[
            F.struct(F.lit(g).alias("g"), F.lit(low).alias("low"), F.lit(high).alias("high"))
            for g, (c, low, high) in enumerate(intervals) if c == name
        ])
        for name in columns
    ]
    cells = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)])
    tall = df.select(F.explode(cells).alias("x")).select("x.i", "x.v").filter(F.col("v").isNotNull())
    within = F.filter(
        F.element_at(F.array(*of_column), F.col("i")), lambda t: (F.col("v") > t["low"]) & (F.col("v") < t["high"])
    )
    return tall.select(F.explode(F.transform(within, lambda t: t["g"])).alias("g"), "v")


def _sketch_brackets(df: DataFrame, targets: list[_Target]) -> dict[tuple, tuple[float, float]]:
    """Two data values per group of targets that very likely enclose it.

    Groups in the same interval share a sketch. Sketches are merged in two steps (salt, then all) so no reducer meets
    one per input task; the driver gets two numbers per group.
    """
    intervals = list(dict.fromkeys(t.interval() for t in targets))
    groups = list(dict.fromkeys(t.group() for t in targets))
    edges: list[list[float]] = [[] for _ in intervals]
    places: dict[tuple, tuple[int, int]] = {}
    for group in groups:
        own = [t for t in targets if t.group() == group]
        at = intervals.index(group[1:])
        share = [(t.rank - t.below) / max(t.inside - 1, 1) for t in own]
        places[group] = (at, len(edges[at]))
        edges[at] += [max(min(share) - SKETCH_ERROR, 0.0), min(max(share) + SKETCH_ERROR, 1.0)]
    salted = _matched(df, intervals).groupBy("g", (F.spark_partition_id() % SALTS).alias("_salt")).agg(
        F.kll_sketch_agg_double("v", F.lit(SKETCH_K)).alias("s")
    )
    merged = salted.groupBy("g").agg(F.kll_merge_agg_double("s").alias("s"))
    asked = F.lit(None)  # the ranks asked of a sketch have to be literals
    for g, own in enumerate(edges):
        quantiles_ = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(e) for e in own]))
        asked = quantiles_ if g == 0 else F.when(F.col("g") == g, quantiles_).otherwise(asked)
    found = {r["g"]: r["q"] for r in merged.select("g", asked.alias("q")).collect()}
    return {group: tuple(found[at][k : k + 2]) for group, (at, k) in places.items()}


def _narrow(df: DataFrame, targets: list[_Target]) -> list[_Target]:
    """One round: bracket by sketch, then count exactly on which side every target lies."""
    brackets = _sketch_brackets(df, targets)
    groups = list(brackets)
    low, high = (F.element_at(F.array(*[F.lit(brackets[g][k]) for g in groups]), F.col("g") + 1) for k in (0, 1))
    value = F.col("v")
    rows = _matched(df, [g[1:] for g in groups]).groupBy("g").agg(
        F.count_if(value < low).alias("below"), F.count_if(value == low).alias("at_low"),
        F.count_if((value > low) & (value < high)).alias("inside"), F.count_if(value == high).alias("at_high"),
    )
    counted = {groups[r["g"]]: r for r in rows.collect()}
    result = []
    for t in targets:
        low, high = brackets[t.group()]
        row = counted[t.group()]
        below, at_low, inside = row["below"], row["at_low"], row["inside"]
        at_high = row["at_high"] if high > low else 0
        offset = t.rank - t.below
        if offset < below:
            t = replace(t, high=low, inside=below)
        elif offset < below + at_low:
            t = replace(t, value=low)
        elif offset < below + at_low + inside:
            t = replace(t, low=low, high=high, below=t.below + below + at_low, inside=inside)
        elif offset < below + at_low + inside + at_high:
            t = replace(t, value=high)
        else:
            passed = below + at_low + inside + at_high
            t = replace(t, low=high, below=t.below + passed, inside=t.inside - passed)
        result.append(t)
    return result


def _resolve(df: DataFrame, targets: list[_Target]) -> dict[int, float]:
    """Look the targets up among the few remaining values of their interval; one group per interval."""
    intervals = list(dict.fromkeys(t.interval() for t in targets))
    wanted: list[list[int]] = [[] for _ in intervals]
    places = {}
    for t in targets:
        at = intervals.index(t.interval())
        places[t.key] = (at, len(wanted[at]))
        wanted[at].append(t.rank - t.below + 1)
    offsets = F.element_at(F.array(*[F.array(*[F.lit(o) for o in os]) for os in wanted]), F.col("g") + 1)
    values = _matched(df, intervals).groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("values"))
    found = {r["g"]: r["q"] for r in values.select(
        "g", F.transform(offsets, lambda o: F.element_at("values", o)).alias("q")).collect()}
    return {key: found[at][k] for key, (at, k) in places.items()}


def order_statistics(
    df: DataFrame,
    wanted: list[tuple[str, int]],
    counts: list[int],
    direct_rows: int = DIRECT_ROWS,
    pairs: list[int] | None = None,
) -> list[float]:
    """Exact values at ascending 0-based ranks of double columns (NULLs do not count).

    ``counts`` are the non-null counts of the same columns; ranks with equal ``pairs`` lie close together.
    """
    inf = float("inf")
    targets = [
        _Target(i, pairs[i] if pairs else i, col, rank, -inf, inf, 0, n)
        for i, ((col, rank), n) in enumerate(zip(wanted, counts, strict=True))
    ]
    done: dict[int, float] = {}
    while True:
        wide = [t for t in targets if t.value is None and t.inside > direct_rows]
        if not wide:
            break
        moved = {t.key: t for t in _narrow(df, wide)}
        targets = [moved.get(t.key, t) for t in targets]
    done.update({t.key: t.value for t in targets if t.value is not None})
    rest = [t for t in targets if t.value is None]
    if rest:
        done.update(_resolve(df, rest))
    return [done[i] for i in range(len(wanted))]


def quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    mode: str = "exact",
    direct_rows: int = DIRECT_ROWS,
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles of the non-null values; None for an all-null column.

    ``exact`` narrows the two ranks around each quantile until a task can hold what is left. ``approx`` answers from
    mergeable sketches in one pass.
    """
    if mode not in ("exact", "approx"):
        raise ValueError(f"unknown quantile mode {mode!r}; use exact or approx")
    if not columns:
        return {}
    narrow = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if mode == "approx":
        return _sketched_quantiles(narrow, columns, probs)
    row = narrow.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    counts = {c: row[c] for c in columns}
    wanted, sizes, plan = [], [], []
    for c in columns:
        n = counts[c]
        for p in probs:
            if n == 0:
                continue
            place = p * (n - 1)
            lower = math.floor(place)
            plan.append((c, len(wanted), place - lower))
            for rank in (lower, min(lower + 1, n - 1)):
                wanted.append((c, rank))
                sizes.append(n)
    pairs = [i // 2 for i in range(len(wanted))]
    values = order_statistics(narrow, wanted, sizes, direct_rows, pairs) if wanted else []
    result: dict[str, list[float] | None] = {c: None for c in columns}
    for c, at, share in plan:
        low, high = values[at], values[at + 1]
        result[c] = (result[c] or []) + [low + (high - low) * share]
    return result


def _sketched_quantiles(df, columns, probs):
    salted = df.groupBy((F.spark_partition_id() % SALTS).alias("_salt")).agg(
        *[
            F.kll_sketch_agg_double(F.col(c), F.lit(SKETCH_K)).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    ranks = F.array(*[F.lit(float(p)) for p in probs])
    merged = salted.agg(
        *[F.kll_merge_agg_double(F.col(f"s{i}")).alias(f"m{i}") for i in range(len(columns))]
    )
    answers = []
    for i in range(len(columns)):
        sketch = F.col(f"m{i}")
        filled = F.kll_sketch_get_n_double(sketch) > 0
        answers.append(
            F.when(filled, F.kll_sketch_get_quantile_double(sketch, ranks)).alias(f"q{i}")
        )
    row = merged.select(*answers).first()
    return {c: list(row[f"q{i}"]) if row[f"q{i}"] else None for i, c in enumerate(columns)}


# -- the key at a position ---------------------------------------------------------------

_HALF = 31  # a BIGINT is compared as two doubles that hold it exactly
_STEP = 5  # bytes of a text that one number holds, with their count
DIRECT_BYTES = 1 << 26  # text that one task may hold


def _key_digits(df: DataFrame, name: str) -> list[Column]:
    """Double columns whose lexicographic order is the order of one key column, NULLs first; a text is one binary column."""
    dtype = df.schema[name].dataType
    col = F.col(name)
    present = F.when(col.isNull(), 0.0).otherwise(1.0)
    if isinstance(dtype, T.StringType):
        return [present, F.coalesce(col.cast("binary"), F.lit(b""))]
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        parts = [col.cast("double")]
    elif isinstance(dtype, T.TimestampNTZType):
        # day and time of day: a detour over the session time zone could reorder local times
        second = F.hour(col) * 3600 + F.minute(col) * 60 + F.date_part(F.lit("SECOND"), col)
        parts = [F.unix_date(col.cast("date")).cast("double"), second.cast("double")]
    else:
        if isinstance(dtype, T.TimestampType):
            number = F.unix_micros(col)
        elif isinstance(dtype, T.DateType):
            number = F.unix_date(col).cast("bigint")
        elif isinstance(dtype, T.IntegralType):
            number = col.cast("bigint")
        else:
            raise TypeError(f"column {name} of type {dtype} cannot order rows")
        low = F.lit((1 << _HALF) - 1).cast("bigint")
        parts = [F.shiftright(number, _HALF).cast("double"), number.bitwiseAND(low).cast("double")]
    return [present, *[F.coalesce(p, F.lit(0.0)) for p in parts]]


def _bytes_after(col: Column, start: int) -> Column:
    """Number in the order of the `_STEP` bytes after the first ``start``; where a text ends, it comes before longer ones."""
    part = F.substring(col, start + 1, _STEP)
    number = F.conv(F.rpad(F.hex(part), 2 * _STEP, "0"), 16, 10).cast("double")
    return number * (_STEP + 1) + F.octet_length(part)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning of two different byte strings."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def at_or_after(
    df: DataFrame, order_by: list[str], position: int, direct_rows: int = 200_000
) -> Column:
    """Predicate for the rows from 0-based ``position`` on in the order of unique keys.

    Finds the key at that position digit by digit, so the split itself is a row-wise filter
    with literals: no sort, no shuffle and no dependence on the partitioning. In a text, what all rows left
    begin with is skipped (the least and the greatest tell), and the next `_STEP` bytes leave those rows that share them with the
    key; the length of the texts does not matter. Texts compare by their UTF-8 bytes.
    """
    digits = [d for name in order_by for d in _key_digits(df, name)]
    names = [f"d{i}" for i in range(len(digits))]
    rows = df.select(*[d.alias(n) for d, n in zip(digits, names, strict=True)])
    texts = {f.name for f in rows.schema if isinstance(f.dataType, T.BinaryType)}
    cut: dict[str, float | bytes] = {}
    while len(cut) < len(names):
        left = [n for n in names if n not in cut]
        lengths = [F.max(F.octet_length(n)) for n in left if n in texts]
        spread = rows.agg(
            F.count(F.lit(1)).alias("n"), sum(lengths, F.lit(0)).alias("bytes"),
            *[f(n).alias(f"{f.__name__}_{n}") for n in left for f in (F.min, F.max)],
        ).first()
        if position >= spread["n"]:
            return F.lit(False)
        if spread["n"] <= direct_rows and spread["n"] * spread["bytes"] <= DIRECT_BYTES:
            keys = F.sort_array(F.collect_list(F.struct(*left)))
            key = rows.agg(F.element_at(keys, position + 1).alias("key")).first()["key"]
            cut.update({n: key[n] for n in left})
            break
        for name in left:
            low, high = spread[f"min_{name}"], spread[f"max_{name}"]
            if low < high:
                digit = _bytes_after(F.col(name), _common(low, high)) if name in texts else F.col(name)
                here = rows.withColumn("digit", digit)
                value = order_statistics(here, [("digit", position)], [spread["n"]])[0]
                position -= here.filter(F.col("digit") < value).count()
                rows = here.filter(F.col("digit") == value).drop("digit")
                if name not in texts:
                    cut[name] = value
                break
            cut[name] = low
    reached = F.lit(True)
    for digit, name in reversed(list(zip(digits, names, strict=True))):
        value = F.lit(bytes(cut[name]) if name in texts else cut[name])
        reached = (digit > value) | ((digit == value) & reached)
    return reached


# -- quotas by hash -----------------------------------------------------------------------


def by_literal(col: Column, values: dict) -> Column:
    """Look a class up in a small driver-side dict."""
    return F.coalesce(*[F.when(col == F.lit(k), F.lit(v)) for k, v in values.items()], F.lit(None))


def hash_quota(
    df: DataFrame, group: str, key: str, seed: int | str, quotas: dict, counts: dict,
    direct_rows: int = 20_000,
) -> Column:
    """Predicate for the ``quotas[g]`` rows of lowest ``md5(key|seed)`` in every group.

    The cut-off digest of each group is found from counts per digest prefix, then among the
    few digests that share the decisive prefix. Equals ``row_number() <= quota`` over the
    group, without sending any group to one task. ``key`` must be unique.
    """
    digest = row_hash(F.col(key), seed)
    cutoff = {g: "" for g, q in quotas.items() if q <= 0}  # no digest is below the empty text
    cutoff.update({g: "g" for g, q in quotas.items() if q >= counts.get(g, 0) > 0})
    open_groups = {g: q for g, q in quotas.items() if 0 < q < counts.get(g, 0)}
    prefix = {g: "" for g in open_groups}
    inside = {g: counts[g] for g in open_groups}
    rows = df.select(F.col(group).alias("_g"), digest.alias("_h"))
    while open_groups:
        length = len(next(iter(prefix.values())))
        here = rows.filter(F.col("_g").isin(list(open_groups)))
        if length:
            # one mention of the digest: a filter pushed below it would repeat each one
            here = here.filter(
                F.substring("_h", 1, length) == by_literal(F.col("_g"), prefix)
            )
        largest = max(inside.values())
        if largest <= direct_rows:
            ranked = here.withColumn(
                "_n", F.row_number().over(Window.partitionBy("_g").orderBy("_h"))
            ).filter(F.col("_n") == by_literal(F.col("_g"), open_groups))
            cutoff.update({r["_g"]: r["_h"] for r in ranked.collect()})
            break
        step = min(3, max(1, math.ceil(math.log(largest / direct_rows, 16))))
        tally = here.groupBy("_g", F.substring("_h", length + 1, step).alias("_p")).count()
        found: dict = {}
        for r in tally.collect():
            found.setdefault(r["_g"], []).append((r["_p"], r["count"]))
        for g, parts in found.items():
            prefix[g], open_groups[g], inside[g] = _crossing(
                prefix[g], sorted(parts), open_groups[g]
            )
    return F.coalesce(digest <= by_literal(F.col(group), cutoff), F.lit(False))


def _crossing(prefix: str, parts: list[tuple[str, int]], quota: int) -> tuple[str, int, int]:
    for part, n in parts:
        if quota <= n:
            return prefix + part, quota, n
        quota -= n
    raise AssertionError("quota exceeds the group")


def hash_ordinals(
    df: DataFrame, group: str, key: str, seed: int | str, largest: int,
    name: str = "ordinal", bucket_rows: int = 200_000,
) -> DataFrame:
    """Number the rows of every group 0, 1, … in digest order.

    Rows are numbered inside digest-prefix buckets, which hold about ``bucket_rows`` rows
    whatever the group sizes, and shifted by the sizes of the earlier buckets.
    """
    digest = row_hash(F.col(key), seed)
    length = max(0, math.ceil(math.log(max(largest, 1) / bucket_rows, 16)))
    rows = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, length))
    within = Window.partitionBy(group, "_b").orderBy("_h")
    rows = rows.withColumn(name, F.row_number().over(within).cast("bigint") - 1)
    if length:
        sizes = df.groupBy(group, F.substring(digest, 1, length).alias("_b")).agg(
            F.count(F.lit(1)).alias("_n")
        )
        earlier = Window.partitionBy(group).orderBy("_b").rowsBetween(
            Window.unboundedPreceding, -1
        )
        shifts = sizes.select(
            group, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_s")
        )
        rows = rows.join(shifts, [group, "_b"]).withColumn(name, F.col(name) + F.col("_s"))
        rows = rows.drop("_s")
    return rows.drop("_h", "_b")


# -- running totals -------------------------------------------------------------------------


def _value_buckets(table: DataFrame, by: str, pieces: int) -> DataFrame:
    """``table`` with about ``pieces`` buckets as a long ``_b`` that never falls along ``by``; NULLs lowest, NaN highest.

    Levels of at most `LEVEL_BUCKETS`: every bucket of a level is cut at the quantiles of its own sketch. The edges of a level are a
    small staged table with one row per bucket, so the plan does not grow with the rows.
    """
    value = F.col(by).cast("double")
    table = table.withColumn("_b", F.lit(0).cast("bigint"))
    buckets = 1
    while pieces > 1:
        width = min(pieces, LEVEL_BUCKETS)
        pieces = math.ceil(pieces / width)
        salted = table.groupBy("_b", (F.spark_partition_id() % SALTS).alias("_salt")).agg(
            F.kll_sketch_agg_double(value, F.lit(SKETCH_K)).alias("s")
        )
        merged = salted.groupBy("_b").agg(F.kll_merge_agg_double("s").alias("s"))
        shares = F.array(*[F.lit(i / width) for i in range(1, width)])
        asked = F.when(F.kll_sketch_get_n_double("s") > 0, F.kll_sketch_get_quantile_double("s", shares))
        edges = stage(merged.select("_b", F.array_distinct(asked).alias("_edges")), "bucket-edges")
        steps = F.array(*[F.lit(1 << i) for i in range((width - 1).bit_length() - 1, -1, -1)])
        # binary search: the number of edges at or below the value
        below = F.aggregate(
            steps, F.lit(0), lambda at, s: at + F.when(F.get("_edges", at + s - 1) <= value, s).otherwise(0)
        )
        if buckets <= LEVEL_BUCKETS:  # half a megabyte at most; past that no bucket holds many rows
            edges = F.broadcast(edges)
        table = table.join(edges, "_b", "left").withColumn("_b", F.col("_b") * width + below).drop("_edges")
        buckets *= width
    return table


def running_totals(
    table: DataFrame, group: list[str], by: str, sums: dict[str, str], rows: int,
    bucket_rows: int = DIRECT_ROWS, *, then: list[str] | None = None,
) -> DataFrame:
    """Inclusive running sums over descending ``by`` inside each group.

    ``table`` has one row per (group, by), or few that follow each other by the columns ``then``. A single global window would run on one task; here
    values are cut into sketch-based buckets (`_value_buckets`), summed inside each bucket, and shifted by the
    totals of the higher buckets.
    """
    pieces = math.ceil(rows / bucket_rows)
    order = [F.desc(by), *(then or [])]
    if pieces <= 1:
        window = Window.partitionBy(*group).orderBy(*order) if group else (
            Window.partitionBy(F.lit(0)).orderBy(*order)
        )
        window = window.rowsBetween(Window.unboundedPreceding, 0)
        return table.select(
            "*", *[F.sum(c).over(window).alias(out) for c, out in sums.items()]
        )
    bucketed = _value_buckets(table, by, pieces)
    keys = [*group, "_b"]
    totals = bucketed.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    higher = (
        Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("_b"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{c}").over(higher), F.lit(0)).alias(f"_s_{c}") for c in sums],
    )
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    inside = bucketed.select("*", *[F.sum(c).over(window).alias(out) for c, out in sums.items()])
    joined = inside.join(shifts, keys)
    for c, out in sums.items():
        joined = joined.withColumn(out, F.col(out) + F.col(f"_s_{c}"))
    return joined.drop("_b", *[f"_s_{c}" for c in sums])
