"""Row numbers 0, 1, 2, … over a whole table without a single-task window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.session import stage


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` staged in ``order`` with a gapless long column ``name`` starting at 0.

    ``order`` holds expressions that sort ascending, NULLs first. The table is range-partitioned and sorted within partitions, written once, and the sizes of
    the earlier partitions (one number each) are added when it is read. The position in the input
    is the last sort key: copies of one row, however many, spread over several partitions.
    An empty table stays empty.
    """
    spark = df.sparkSession
    keys = [F.col(f"__k{i}") for i in range(len(order))] + [F.col("__place")]
    placed = df.select(
        "*", *[c.alias(f"__k{i}") for i, c in enumerate(order)],
        F.monotonically_increasing_id().alias("__place"),
    )
    dealt = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    written = stage(
        dealt.select(
            *df.columns, F.shiftright(at, 33).alias("__part"),
            at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"),
        ),
        "numbered",
    )
    sizes = dict(written.groupBy("__part").count().collect())  # one row per written partition
    parts = range(max(sizes, default=-1) + 1)
    starts = [0, *accumulate(sizes.get(p, 0) for p in parts)]
    start = F.element_at(F.lit(starts), F.col("__part").cast("int") + 1)
    if not sizes:
        start = F.lit(0)
    return written.select(*df.columns, (start + F.col("__at")).cast("long").alias(name))
