"""Bring every row together with the one that follows it in the order of an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.session import small_table

CELLS = 4096


def with_next(df: DataFrame, key: str, tie: str, values: list[str], prefix: str = "next_") -> DataFrame:
    """``df`` with the ``values`` of the next row as ``prefix`` columns, descending ``key``; after the
    last row comes the first.

    ``tie`` is a long column that orders rows of one key (a hash of the rest); NULL keys come last.
    The order is cut into `CELLS` cells at quantiles of (key, tie); a cell is one window, and its
    first row is also sent to the cell before. One shuffle of the rows. What is kept per cell has a
    fixed size. A single row follows itself; an empty table stays empty.
    """
    spark = df.sparkSession
    share = F.col(tie) / F.lit(2.0**64) + F.lit(0.5)
    # one number that never falls along the order: the key, plus the tie as a fraction
    place = F.when(F.col(key).isNull(), F.lit(-2e19) + share * 1e19).otherwise(F.col(key).cast("double") + share)
    placed = df.withColumn("__x", place)
    cuts = [i / CELLS for i in range(1, CELLS)]
    bounds = placed.agg(F.percentile_approx("__x", cuts, 50_000)).first()[0]
    if not bounds:  # no rows
        return placed.drop("__x").select("*", *[F.col(c).alias(prefix + c) for c in values])
    steps = F.array(*[F.lit(1 << i) for i in range(CELLS.bit_length() - 2, -1, -1)])
    limits = F.lit([float(b) for b in bounds])
    # binary search: the number of bounds below or at x
    cell: Column = F.aggregate(
        steps, F.lit(0), lambda at, s: at + F.when(F.get(limits, at + s - 1) <= F.col("__x"), s).otherwise(0)
    )
    placed = placed.withColumn("__cell", cell)
    top = F.max(F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("k"), F.col(tie).alias("t")))
    tops = sorted((r["__cell"], r["k"], r["t"]) for r in  # at most CELLS rows
                  placed.groupBy("__cell").agg(top.alias("top")).select("__cell", "top.k", "top.t").collect())
    above = [tops[(i + 1) % len(tops)][0] for i in range(len(tops))]
    kind = df.schema[key].dataType.simpleString()
    info = small_table(
        spark, [(c, k, t, a) for (c, k, t), a in zip(tops, above, strict=True)],
        f"__cell int, __k {kind}, __t long, __above int",
    )
    first = F.col(key).eqNullSafe(F.col("__k")) & (F.col(tie) == F.col("__t"))
    here = F.struct(F.col("__cell").alias("cell"), F.lit(0).alias("copy"))
    there = F.struct(F.col("__above").alias("cell"), F.lit(1).alias("copy"))
    sent = placed.join(F.broadcast(info), "__cell").select(
        *df.columns, F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))).alias("__to")
    )
    order = [F.col("__to.copy"), F.col(key).desc_nulls_last(), F.col(tie).desc()]
    window = Window.partitionBy("__to.cell").orderBy(*order)
    return sent.select(
        "*", *[F.lead(c).over(window).alias(prefix + c) for c in values]
    ).filter("__to.copy = 0").drop("__to")
