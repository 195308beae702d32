"""Sinks and sources of prepared tables, parameters and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators.metrics import METRICS_SCHEMA
from sievewright.session import small_table
from sievewright.sources.arrow import load_arrow, save_arrow

#: Feather files are Arrow IPC files.
FORMATS = {"parquet": "parquet", "orc": "orc", "feather": "feather", "csv": "csv"}


def save(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a frame in the named format to ``<path>.<format>``; returns where."""
    kind = FORMATS.get(fmt.lower())
    if kind is None:
        raise ValueError(f"unsupported format {fmt!r}; use one of {list(FORMATS)}")
    target = f"{path}.{kind}"
    if kind == "feather":
        save_arrow(df, target)
        return target
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(target)
    return target


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    kind = FORMATS[fmt.lower()]
    if kind == "feather":
        return load_arrow(spark, f"{path}.{kind}")
    reader = spark.read
    if kind == "csv":
        reader = reader.option("header", True)
    return reader.format(kind).load(f"{path}.{kind}")


#: Formats whose tables can be laid out in buckets of the key.
BUCKETED = ("parquet", "orc")


def save_split(
    df: DataFrame, folder: str, split: str, targets: list[str], features: list[str],
    fmt: str = "parquet", key: str = "row_id", csv_copy: bool = False,
) -> None:
    """Features (in ``fmt``) and targets (always Parquet) of one split, both with the key.

    Both tables are written in equal buckets of the key, sorted, by one shuffle for both; so they join without one however often
    they are read. Features in another format are written as they come.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.filter(F.col("split") == split)
    kind = FORMATS.get(fmt.lower())
    if kind in BUCKETED:
        rows = rows.repartition(buckets, key)
        _save_buckets(rows.select(key, *features), f"{folder}/X_{split}.{kind}", kind, key, buckets)
        _save_buckets(rows.select(key, *targets), f"{folder}/y_{split}.parquet", "parquet", key, buckets)
    else:
        save(rows.select(key, *features), f"{folder}/X_{split}", fmt)
        save(rows.select(key, *targets), f"{folder}/y_{split}", "parquet")
    layout = small_table(spark, [(key, buckets if kind in BUCKETED else 0)], "key string, buckets int")
    layout.coalesce(1).write.mode("overwrite").json(f"{folder}/layout_{split}")
    if csv_copy:
        save(rows.select(key, *features), f"{folder}/X_{split}", "csv")


def _save_buckets(df: DataFrame, path: str, kind: str, key: str, buckets: int) -> None:
    name = f"split_{uuid.uuid4().hex}"
    df.write.format(kind).mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    df.sparkSession.sql(f"drop table {name}")  # the name only: the files lie outside the warehouse


def _load_buckets(spark: SparkSession, path: str, kind: str, key: str, buckets: int) -> DataFrame:
    """The files of a bucketed table, read as one whatever catalog wrote them."""
    name, quoted = f"split_{uuid.uuid4().hex}", key.replace("`", "``")
    columns = ", ".join("`" + f.name.replace("`", "``") + f"` {f.dataType.simpleString()}" for f in spark.read.format(kind).load(path).schema)
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"create table {name} ({columns}) using {kind} clustered by (`{quoted}`) sorted by (`{quoted}`) into {buckets} buckets location '{where}'"
    )
    df = spark.table(name)
    spark.sql(f"drop table {name}")
    return df


def load_split(
    spark: SparkSession, folder: str, split: str, fmt: str = "parquet", key: str = "row_id"
) -> DataFrame:
    """Features and targets of one split joined on their key: bucket by bucket, without a shuffle, if both have buckets."""
    kind = FORMATS[fmt.lower()]
    layout = spark.read.schema("key string, buckets int").json(f"{folder}/layout_{split}").first()
    if layout["buckets"] and kind in BUCKETED and layout["key"] == key:
        x = _load_buckets(spark, f"{folder}/X_{split}.{kind}", kind, key, layout["buckets"])
        y = _load_buckets(spark, f"{folder}/y_{split}.parquet", "parquet", key, layout["buckets"])
    else:
        x, y = load(spark, f"{folder}/X_{split}", fmt), load(spark, f"{folder}/y_{split}")
    return x.join(y, key)


def save_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON lines in one small file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)


def save_parameters(params: DataFrame, folder: str, name: str) -> None:
    """A fitted-parameter table (imputer, scaler, features, weights, label map)."""
    params.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_parameters(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def feature_table(spark: SparkSession, features: list[str]) -> DataFrame:
    """Feature names with their position."""
    return small_table(
        spark, list(enumerate(features)), "position bigint, feature string"
    )


def load_features(spark: SparkSession, folder: str) -> list[str]:
    rows = load_parameters(spark, folder, "features").orderBy("position").collect()
    return [r["feature"] for r in rows]
