"""Quality profile of prepared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.operators.profile import (
    class_counts_table,
    histogram,
    leakage_columns,
    missing_values,
)
from sievewright.operators.select import correlation_matrix
from sievewright.sources import tables


def profile_splits(
    train: DataFrame, test: DataFrame, features: list[str], target: str
) -> dict[str, DataFrame]:
    """Class counts, missing values, histograms, correlations and leakage, by name."""
    return {
        "classes_train": class_counts_table(train, target),
        "classes_test": class_counts_table(test, target),
        "missing_train": missing_values(train, features),
        "missing_test": missing_values(test, features),
        "histograms": histogram(train, features),
        "correlations": correlation_matrix(train, features),
        "leakage": leakage_columns(train.select(features)),
    }


def profile_folder(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    features = tables.load_features(spark, folder)
    train, test = (tables.load_split(spark, folder, s, fmt) for s in ("train", "test"))
    target = "label_multi" if "label_multi" in train.columns else "label_binary"
    return profile_splits(train, test, features, target)
