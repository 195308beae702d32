"""Session helpers: a local session for tests and staged (lineage-cutting) tables."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def local_session(cores: int | str = "*", app: str = "sievewright", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own session."""
    n = os.cpu_count() if cores == "*" else cores
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.checkpoint.dir": os.path.join(tempfile.gettempdir(), "sievewright"),
        # no call-site capture per column expression: wide plans build several times faster
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir``, else a folder in the session's warehouse.

    What an application stages there goes when its session's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
        spark.sparkContext.setCheckpointDir(root)
    root = root.rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{spark.sparkContext.applicationId}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return root


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of staged tables."""
    return f"{staging_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-side rows (parameters, label maps) as a local relation: reading it is no job."""
    fields = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [() for _ in fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    arrays = [pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=fields.names), fields)


def stage_observed(
    df: DataFrame, name: str, measures: dict[str, Column], partition_by: str | None = None
) -> tuple[DataFrame, dict]:
    """`stage` and aggregates of the rows written, taken by the writing job itself.

    They are observed in its last stage, whose tasks count once for each partition, so a lost executor changes nothing.
    """
    seen = Observation()
    observed = df.observe(seen, *[c.alias(n) for n, c in measures.items()])
    return stage(observed, name, partition_by), dict(seen.get)


def stage_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """`stage` and the number of rows written, without another job."""
    staged, seen = stage_observed(df, name, {"rows": F.count(F.lit(1))})
    return staged, seen["rows"]


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to a new table in the staging folder and read it back.

    Cuts lineage so that later passes (fits, counts, writes) reread pruned Parquet columns
    instead of recomputing shuffles, and so that a lost executor costs one task, not the job.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
