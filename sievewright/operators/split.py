"""Train/test splits. Every frame keeps one row per input row with a ``split`` column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.ranks import at_or_after, hash_quota
from sievewright.operators.labels import require_column

# Keywords of the day names in source files, by split.
DAY_ASSIGNMENT = {
    "train": ["monday", "tuesday", "wednesday", "thursday"],
    "val": [],
    "test": ["friday"],
}


MOST_CLASSES = 10_000


def class_counts(df: DataFrame, target: str) -> dict:
    """Rows per class as a small dict; more than `MOST_CLASSES` classes are an error."""
    counted = df.groupBy(target).count().limit(MOST_CLASSES + 1).collect()
    if len(counted) > MOST_CLASSES:
        raise ValueError(f"{target!r} has more than {MOST_CLASSES} classes")
    return {r[target]: r["count"] for r in counted if r[target] is not None}


def stratified_quotas(counts: dict, test_size: float) -> dict:
    """Test rows per class for ``ceil(n * test_size)`` test rows in all.

    Training rows are shared out in proportion to class size, the left-over ones by largest
    remainder (equal remainders in class order); the test part is what is left.
    """
    n = sum(counts.values())
    n_test = math.ceil(n * test_size)
    n_train = n - n_test
    if min(counts.values(), default=0) < 2:
        raise ValueError("every class needs at least 2 rows for a stratified split")
    if min(n_train, n_test) < len(counts):
        raise ValueError("each side of the split needs at least one row per class")
    exact = {c: k / n * n_train for c, k in counts.items()}
    train = {c: math.floor(x) for c, x in exact.items()}
    by_remainder = sorted(exact, key=lambda c: (train[c] - exact[c], c))
    for c in by_remainder[: n_train - sum(train.values())]:
        train[c] += 1
    return {c: counts[c] - train[c] for c in counts}


def stratified_split(
    df: DataFrame, target: str, test_size: float = 0.2, val_size: float = 0.0,
    seed: int = 42, key: str = "row_id",
) -> DataFrame:
    """Random split with class proportions kept; rows are chosen by the hash of their key."""
    counts = class_counts(df, target)
    test = stratified_quotas(counts, test_size)
    is_test = hash_quota(df, target, key, seed, test, counts)
    split = F.when(is_test, "test")
    if val_size:
        rest = {c: counts[c] - test[c] for c in counts}
        n = sum(counts.values())
        val = stratified_quotas(rest, val_size * n / sum(rest.values()))
        both = {c: test[c] + val[c] for c in counts}
        split = split.when(hash_quota(df, target, key, seed, both, counts), "val")
    return df.filter(F.col(target).isNotNull()).withColumn("split", split.otherwise("train"))


def day_split(
    df: DataFrame, assignment: dict[str, list[str]] | None = None,
    source: str = "source_file",
) -> DataFrame:
    """Split by keywords (case-insensitive patterns) in the source name.

    A row that matches several sides is in each of them; one that matches none is train.
    """
    require_column(df, source)
    assignment = assignment or DAY_ASSIGNMENT
    name = F.lower(F.col(source))
    hits = {
        side: F.coalesce(name.rlike("|".join(f"(?:{w.lower()})" for w in words)), F.lit(False))
        for side, words in assignment.items()
        if words
    }
    found = [F.when(hit, side).otherwise("") for side, hit in hits.items()]
    matched = F.array_remove(F.array(*found), "")
    sides = F.when(F.size(matched) == 0, F.array(F.lit("train"))).otherwise(matched)
    return df.withColumn("split", F.explode(sides))


def ordered_split(
    df: DataFrame, order_by: str | list[str] = "row_id", test_size: float = 0.2,
    val_size: float = 0.0,
) -> DataFrame:
    """The last ``int(n * test_size)`` rows in key order are test (and those before them val).

    The key at the cut is found by selection, so rows are split by a literal comparison.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    n = df.count()
    n_test = int(n * test_size)
    n_val = int(n * val_size)
    split = F.when(at_or_after(df, order, n - n_test), "test")
    if n_val:
        split = split.when(at_or_after(df, order, n - n_test - n_val), "val")
    return df.withColumn("split", split.otherwise("train"))


def split_dataset(
    df: DataFrame, target: str, strategy: str = "day_based", test_size: float = 0.2,
    val_size: float = 0.0, seed: int = 42, day_assignment: dict | None = None,
    key: str = "row_id", order_by: str | list[str] | None = None,
) -> DataFrame:
    """Split by strategy name; the source tag is dropped because it is not a feature."""
    ways = {
        "random": lambda: stratified_split(df, target, test_size, val_size, seed, key),
        "day_based": lambda: day_split(df, day_assignment),
        "time_based": lambda: ordered_split(df, order_by or key, test_size, val_size),
    }
    way = ways.get(strategy.lower().strip())
    if way is None:
        raise ValueError(f"no split is called {strategy!r}, only {', '.join(sorted(ways))}")
    return way().drop("source_file")
