"""Cleaning: coercion, infinities, keep-first deduplication, outlier clipping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions.names import normalise_columns, numeric_columns
from sievewright.functions.numbers import INF, as_number, clamp, finite, is_infinite
from sievewright.functions.ranks import quantiles
from sievewright.session import small_table, stage

INF_STRATEGIES = ("nan", "clip")


def coerce_numbers(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Make every column but ``keep`` a double, NULL where a value is not a number.

    Infinities survive for ``handle_infinities``; NaN becomes NULL at once.
    """
    kept = set(keep)
    return df.select(
        *[
            F.col(f.name)
            if f.name in kept
            else _nan_to_null(as_number(F.col(f.name), f.dataType), f).alias(f.name)
            for f in df.schema.fields
        ]
    )


def _nan_to_null(col: Column, field) -> Column:
    if field.dataType.typeName() in ("boolean", "array", "map", "struct"):
        return col
    return F.nullif(col, F.lit(float("nan")))


def count_infinities(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row with the number of infinite cells over all numeric columns."""
    columns = numeric_columns(df) if columns is None else columns
    cells = sum((F.coalesce(is_infinite(F.col(c)).cast("int"), F.lit(0)) for c in columns),
                F.lit(0))
    return df.agg(F.coalesce(F.sum(cells), F.lit(0)).alias("infinite_cells"))


def finite_extremes(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest finite value per column, in one pass."""
    if not columns:
        return {}
    wanted = []
    for i, c in enumerate(columns):
        value = finite(F.col(c).cast("double"))
        wanted += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    row = df.agg(*wanted).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def handle_infinities(
    df: DataFrame,
    strategy: str = "nan",
    columns: list[str] | None = None,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Turn infinities into NULL, or into the column's finite extremes (0 if it has none)."""
    if strategy not in INF_STRATEGIES:
        raise ValueError(f"unknown infinity strategy {strategy!r}; use one of {INF_STRATEGIES}")
    columns = numeric_columns(df) if columns is None else columns
    if strategy == "nan":
        return df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    extremes = finite_extremes(df if fit_on is None else fit_on, columns)
    clipped = {}
    for c in columns:
        low, high = (0.0 if v is None else v for v in extremes[c])
        value = F.col(c).cast("double")
        clipped[c] = (
            F.when(value == F.lit(INF), F.lit(high))
            .when(value == F.lit(-INF), F.lit(low))
            .otherwise(F.nullif(value, F.lit(float("nan"))))
        )
    return df.withColumns(clipped)


def keep_first(
    df: DataFrame, order_by: str | list[str], ignore: Iterable[str] = ("source_file",)
) -> DataFrame:
    """One row per distinct content, the first in ``order_by``; NULL equals NULL.

    An aggregate over the compared columns: copies collapse on the map side, so a row that makes up a
    third of the table costs nothing extra. Ignored columns come from the same row; among rows equal in
    ``order_by`` too, the smallest ignored columns are kept. Without ignored columns a single numeric key
    needs no sort (its buffer has a fixed width), which is why ingest keeps the source inside the key.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    carried = [c for c in df.columns if c in set(ignore) and c not in order]
    compared = [c for c in df.columns if c not in carried and c not in order]
    kept = [*order, *carried]
    if len(kept) == 1:
        first = df.groupBy(*compared).agg(F.min(kept[0]).alias(kept[0]))
    else:
        first = df.groupBy(*compared).agg(F.min(F.struct(*kept)).alias("_first")).select(
            *compared, *[F.col("_first")[c].alias(c) for c in kept]
        )
    return first.select(*df.columns)


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist."""
    return df.drop(*names)


def clip_bounds(
    df: DataFrame,
    columns: list[str] | None = None,
    factor: float = 3.0,
    mode: str = "exact",
    skip_zero_iqr: bool = False,
) -> dict[str, tuple[float, float]]:
    """``[Q1 - factor*IQR, Q3 + factor*IQR]`` per column; all-null columns have no bounds."""
    columns = numeric_columns(df) if columns is None else columns
    bounds = {}
    for c, q in quantiles(df, columns, [0.25, 0.75], mode).items():
        if q is None:
            continue
        spread = q[1] - q[0]
        if spread == 0 and skip_zero_iqr:
            continue
        bounds[c] = (q[0] - factor * spread, q[1] + factor * spread)
    return bounds


def clip_outliers(
    df: DataFrame,
    factor: float = 3.0,
    columns: list[str] | None = None,
    mode: str = "exact",
    fit_on: DataFrame | None = None,
    skip_zero_iqr: bool = False,
) -> DataFrame:
    """Clip to the interquartile fences; NULL stays NULL."""
    columns = numeric_columns(df) if columns is None else columns
    bounds = clip_bounds(df if fit_on is None else fit_on, columns, factor, mode, skip_zero_iqr)
    return df.withColumns({c: clamp(F.col(c), *b) for c, b in bounds.items()})


def count_clipped(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Cells outside the bounds, per column, as ``(feature, clipped_cells)``."""
    counts = [
        F.count_if((F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high))).alias(c)
        for c, (low, high) in bounds.items()
    ]
    return df.agg(*counts).unpivot([], list(bounds), "feature", "clipped_cells")


def clean_dataframe(
    df: DataFrame,
    order_by: str | list[str] = "row_id",
    columns_to_drop: Iterable[str] = (),
    inf_strategy: str = "nan",
    deduplicate: bool = True,
    do_clip_outliers: bool = False,
    clip_factor: float = 3.0,
    label_column: str = "label",
    quantile_mode: str = "exact",
    compat: bool = False,
) -> DataFrame:
    """Names, coercion, infinities, deduplication, drops, then clipping.

    Columns about to be dropped stay text until after deduplication so that addresses and
    flow ids still tell rows apart; ``compat=True`` coerces them first, which turns them NULL.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    df = normalise_columns(df)
    dropped = [c for c in columns_to_drop if c in df.columns]
    tags = {"source_file", label_column, *order}
    text = tags if compat else tags | set(dropped)
    df = coerce_numbers(df, keep=text)
    numbers = [c for c in numeric_columns(df) if c not in order and c not in tags]
    df = handle_infinities(df, inf_strategy, [c for c in numbers if c not in dropped or compat])
    if deduplicate:
        df = keep_first(df, order)
    df = drop_columns(df, dropped)
    if do_clip_outliers:
        features = [c for c in numbers if c not in dropped]
        df = stage(df, "clean")  # the fences are fitted in several passes
        df = clip_outliers(df, clip_factor, features, quantile_mode)
    return df


def remaining_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row with the number of NULL cells over the numeric columns."""
    columns = numeric_columns(df) if columns is None else columns
    cells = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(cells), F.lit(0)).alias("null_cells"))
