"""Data-quality profiles of prepared frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.hashing import row_hash
from sievewright.functions.names import numeric_columns
from sievewright.session import small_table

# Identity columns a feature table must not contain.
IDENTITY_COLUMNS = [
    "flow_id", "source_ip", "destination_ip", "timestamp", "source_port", "destination_port",
    "src_ip", "dst_ip",
]


def class_counts_table(df: DataFrame, target: str) -> DataFrame:
    """``(class, count)`` in class order."""
    return df.groupBy(F.col(target).alias("class")).count().orderBy("class")


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(feature, missing)`` per column plus a TOTAL row, from one pass."""
    columns = df.columns if columns is None else columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns), F.lit(0)).alias("TOTAL")
    return counts.select("*", total).unpivot([], [*columns, "TOTAL"], "feature", "missing")


def histogram(
    df: DataFrame, columns: list[str] | None = None, bins: int = 50
) -> DataFrame:
    """``(feature, bin, low, high, count)``: equal-width bins over each column's own range.

    Bins are half-open except the last; a constant column gets the unit range around its
    value. All rows count. Only filled bins are listed.
    """
    columns = numeric_columns(df) if columns is None else columns
    stats = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        stats += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    row = df.agg(*stats).first()
    cells = []
    for i, c in enumerate(columns):
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        if low is None:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        width = (high - low) / bins
        place = F.floor((F.col(c).cast("double") - F.lit(low)) / F.lit(width)).cast("int")
        cells.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.least(place, F.lit(bins - 1)).alias("bin"),
                F.lit(low).alias("start"),
                F.lit(width).alias("width"),
            )
        )
    if not cells:
        return small_table(
            df.sparkSession, [], "feature string, bin int, low double, high double, count bigint"
        )
    counts = (
        df.select(F.explode(F.array(*cells)).alias("x"))
        .select("x.*")
        .filter(F.col("bin").isNotNull())
        .groupBy("feature", "bin", "start", "width")
        .count()
    )
    return counts.select(
        "feature", "bin",
        (F.col("start") + F.col("bin") * F.col("width")).alias("low"),
        (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        "count",
    )


def leakage_columns(df: DataFrame) -> DataFrame:
    """Identity columns still present, as ``(column)``."""
    found = [(c,) for c in df.columns if c.lower() in IDENTITY_COLUMNS]
    return small_table(df.sparkSession, found, "column string")


def sample_rows(df: DataFrame, n: int, key: str = "row_id", seed: int = 42) -> DataFrame:
    """``n`` random rows, the same for every run; a top-n, so tasks keep n rows each."""
    return df.orderBy(row_hash(F.col(key), seed)).limit(n)
