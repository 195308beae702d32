"""Imputing and scaling with parameters fitted on the training part only.

``fit_*`` returns a small DataFrame with one row per feature, which can be written, read and
applied later; ``apply_*`` is a single projection with literals, usable on batch frames and
on streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.ranks import quantiles
from sievewright.session import small_table

IMPUTE_SCHEMA = "feature string, fill double"
SCALE_SCHEMA = "feature string, center double, scale double"


def training_rows(df: DataFrame) -> DataFrame:
    """The rows parameters may be fitted on."""
    return df.filter(F.col("split") == "train") if "split" in df.columns else df


def _means(df: DataFrame, features: list[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(F.col(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(features)}


def _modes(df: DataFrame, features: list[str]) -> dict[str, float | None]:
    """Most frequent value per feature, the smallest on ties.

    Counting by (feature, value) first keeps a value-to-count map out of any single task.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in features]
    )
    best = (
        df.select(F.explode(cells).alias("x"))
        .select("x.f", "x.v")
        .filter(F.col("v").isNotNull())
        .groupBy("f", "v")
        .count()
        .groupBy("f")
        .agg(F.max(F.struct("count", (-F.col("v")).alias("minus"))).alias("top"))
    )
    found = {r["f"]: -r["top"]["minus"] for r in best.collect()}
    return {c: found.get(c) for c in features}


def fit_imputer(
    df: DataFrame, features: list[str], strategy: str = "median", mode: str = "exact"
) -> DataFrame:
    """Fill values from the training rows; a feature without any value is filled with 0."""
    train = training_rows(df)
    if strategy == "median":
        fills = {c: q and q[0] for c, q in quantiles(train, features, [0.5], mode).items()}
    elif strategy == "mean":
        fills = _means(train, features)
    elif strategy == "most_frequent":
        fills = _modes(train, features)
    elif strategy == "zero":
        fills = dict.fromkeys(features, 0.0)
    else:
        raise ValueError(
            f"unknown imputing strategy {strategy!r}; use median, mean, most_frequent or zero"
        )
    rows = [(c, 0.0 if fills[c] is None else float(fills[c])) for c in features]
    return small_table(df.sparkSession, rows, IMPUTE_SCHEMA)


def apply_imputer(df: DataFrame, params: DataFrame) -> DataFrame:
    fills = {r["feature"]: r["fill"] for r in params.collect()}
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()}
    )


def drop_incomplete(df: DataFrame, features: list[str]) -> DataFrame:
    """Keep only rows with a value in every feature."""
    return df.dropna(subset=features)


def fit_scaler(
    df: DataFrame, features: list[str], scaler: str = "standard", mode: str = "exact"
) -> DataFrame:
    """Centre and scale per feature from the training rows; a zero spread scales by 1.

    ``standard``: mean and population deviation. ``robust``: median and interquartile range.
    ``minmax``: minimum and range. ``none``: 0 and 1.
    """
    train = training_rows(df)
    name = scaler.lower().strip()
    if name == "none":
        found = {c: (0.0, 1.0) for c in features}
    elif name == "robust":
        found = {
            c: (q[1], q[2] - q[0]) if q else (None, None)
            for c, q in quantiles(train, features, [0.25, 0.5, 0.75], mode).items()
        }
    elif name in ("standard", "minmax"):
        stats = []
        for i, c in enumerate(features):
            value = F.col(c).cast("double")
            spread = F.max(value) - F.min(value)
            if name == "standard":
                # min = max decides constancy: a deviation may round to a tiny non-zero value
                spread = F.when(spread == 0, 0.0).otherwise(F.stddev_pop(value))
                stats.append(F.avg(value).alias(f"c{i}"))
            else:
                stats.append(F.min(value).alias(f"c{i}"))
            stats.append(spread.alias(f"s{i}"))
        row = train.agg(*stats).first()
        found = {c: (row[f"c{i}"], row[f"s{i}"]) for i, c in enumerate(features)}
    else:
        raise ValueError(
            f"unknown scaler {scaler!r}; use standard, robust, minmax or none"
        )
    rows = [(c, float(found[c][0] or 0.0), float(found[c][1] or 1.0)) for c in features]
    return small_table(df.sparkSession, rows, SCALE_SCHEMA)


def apply_scaler(df: DataFrame, params: DataFrame) -> DataFrame:
    found = {r["feature"]: (r["center"], r["scale"]) for r in params.collect()}
    return df.withColumns(
        {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in found.items()}
    )


def impute(
    df: DataFrame, features: list[str], strategy: str = "median", mode: str = "exact"
) -> tuple[DataFrame, DataFrame]:
    params = fit_imputer(df, features, strategy, mode)
    return apply_imputer(df, params), params


def scale(
    df: DataFrame, features: list[str], scaler: str = "standard", mode: str = "exact"
) -> tuple[DataFrame, DataFrame]:
    params = fit_scaler(df, features, scaler, mode)
    return apply_scaler(df, params), params
