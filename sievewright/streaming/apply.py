"""Row-wise operators on streams.

Coercion, labels, targets, imputing, scaling and scoring are plain column expressions, so the
batch functions run on a streaming frame as they are. What needs a rank over all rows is
replaced by stored parameters or by state bounded with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions.names import normalise_columns
from sievewright.functions.numbers import finite
from sievewright.operators.clean import coerce_numbers, drop_columns
from sievewright.operators.labels import binary_target, normalise_labels
from sievewright.operators.model import score
from sievewright.operators.scale import apply_imputer, apply_scaler


def clean_stream(
    stream: DataFrame, columns_to_drop: tuple[str, ...] = (), label_column: str | None = "label",
    keep: tuple[str, ...] = ("row_id", "source_file"),
) -> DataFrame:
    """Names, coercion, infinities to NULL, drops and, if there is a label, its target."""
    rows = drop_columns(normalise_columns(stream), columns_to_drop)
    kept = {*keep, *([label_column] if label_column else [])} & set(rows.columns)
    rows = coerce_numbers(rows, keep=kept)
    rows = rows.withColumns(
        {
            f.name: finite(F.col(f.name))
            for f in rows.schema.fields
            if f.dataType.typeName() == "double" and f.name not in kept
        }
    )
    if label_column and label_column in rows.columns:
        rows = binary_target(normalise_labels(rows, label_column), label_column)
    return rows


def prepare_stream(stream: DataFrame, imputer: DataFrame, scaler: DataFrame | None) -> DataFrame:
    """Impute and scale with parameters fitted on batch training rows."""
    rows = apply_imputer(stream, imputer)
    return rows if scaler is None else apply_scaler(rows, scaler)


def score_stream(
    stream: DataFrame, model: PipelineModel, threshold: float = 0.5, task: str = "binary"
) -> DataFrame:
    scored = score(stream, model, task)
    if task == "binary":
        scored = scored.withColumn("prediction", (F.col("p") >= F.lit(threshold)).cast("int"))
    return scored


def count_scores(scored: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """``(actual, prediction, bin, rows)`` of a scored binary stream: confusion and score counts.

    The state is one count for each pair of classes and each of the equal ``bins`` of ``p`` (1 is in the last), whatever
    has passed. Rows without a target are counted under NULL.
    """
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(F.col(target).alias("actual"), "prediction", bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def write_counts(counts: DataFrame, path: str, checkpoint: str):
    """Start a query that writes all counts so far after every micro-batch, each epoch in its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        counts.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts after the last epoch."""
    counts = spark.read.parquet(path)
    last = counts.agg(F.max("epoch")).first()[0]
    return counts.filter(F.col("epoch") == last).drop("epoch")


def drop_repeats(
    stream: DataFrame, time: str, compare: list[str], delay: str = "10 minutes"
) -> DataFrame:
    """First arrival of every distinct content within the watermark delay.

    Times without a zone are read in the session's zone, as watermarks need.
    """
    if stream.schema[time].dataType.typeName() == "timestamp_ntz":
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(compare)


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, transform: Callable | None = None
):
    """Start a query that appends (transformed) micro-batches as Parquet, once per epoch.

    Every epoch has its own folder, overwritten on a retry, so a replayed batch leaves no copy.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
