"""Raw folder to model-ready training and test tables."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.config import Config
from sievewright.functions.names import numeric_columns
from sievewright.operators import balance, labels, scale, select
from sievewright.operators.clean import clean_dataframe, clip_outliers
from sievewright.operators.split import split_dataset
from sievewright.session import small_table, stage, stage_counted, stage_observed
from sievewright.sources import tables
from sievewright.sources.csv import FILE_BITS, file_sources, read_folder_counted

TARGETS = ("label_binary", "label_multi")
SPLITS = ("test", "train", "val")


SUMMARY = "stage string, metric string, value string"


def split_rows() -> dict[str, Column]:
    """Rows of each split, to be observed."""
    return {name: F.count_if(F.col("split") == name) for name in SPLITS}


@dataclass
class Prepared:
    """One frame with key, features, targets and split, and all fitted parameter tables."""

    data: DataFrame
    features: list[str]
    targets: list[str]
    target: str
    label_map: DataFrame | None = None
    imputer: DataFrame | None = None
    scaler: DataFrame | None = None
    weights: DataFrame | None = None
    benign: DataFrame | None = None
    sizes: dict[str, int] = field(default_factory=dict)  # rows of each split
    summary: list[tuple[str, str, str]] = field(default_factory=list)

    def note(self, stage_name: str, metric: str, value) -> None:
        self.summary.append((stage_name, metric, str(value)))

    def split(self, name: str) -> DataFrame:
        return self.data.filter(F.col("split") == name)


    def summary_table(self) -> DataFrame:
        """What the run noted, as (stage, metric, value), in the order of the stages."""
        return small_table(self.data.sparkSession, self.summary, SUMMARY)


def prepare(raw: DataFrame, config: Config | None = None, sources: DataFrame | None = None
            ) -> Prepared:
    """Clean, label, split, impute, scale, rebalance and weigh a raw frame.

    ``raw`` needs ``row_id`` and the label; ``source_file`` only for a day-based split.
    ``sources`` maps file numbers to names where the number is in the high bits of the key:
    the source then need not be carried through deduplication.

    Each shuffle-heavy step ends in a staged table, because the fits after it reread it. The
    split table is partitioned by split, so fits read the training files only.
    """
    config = config or Config()
    cleaning, seed = config.cleaning, config.random_seed
    mode = config.transform.quantiles
    label = config.labels.label_column

    carried = raw.drop("source_file") if sources is not None else raw
    clip_all = cleaning.clip_outliers and cleaning.fit_on == "all"
    clean = clean_dataframe(
        carried, "row_id", cleaning.columns_to_drop, cleaning.replace_inf_with,
        cleaning.remove_duplicates, False, cleaning.clip_factor, label, mode, cleaning.compat,
    )
    clean, rows = stage_counted(clean, "clean")
    not_features = {"row_id", "source_file", label, *TARGETS, "split"}
    features = [c for c in numeric_columns(clean) if c not in not_features]
    if clip_all:
        clean = clip_outliers(clean, cleaning.clip_factor, features, mode)
    if sources is not None:
        number = F.shiftright("row_id", FILE_BITS)
        clean = clean.withColumn("file_number", number).join(sources, "file_number")
        clean = clean.drop("file_number")

    labelled = labels.normalise_labels(clean, label)
    labelled, target, mapping = labels.choose_target(labelled, config.labels.task_mode, label)
    targets = [c for c in TARGETS if c in labelled.columns]
    split = split_dataset(
        labelled, target, config.split.strategy, config.split.test_size, config.split.val_size,
        seed, config.split.day_assignment, "row_id", config.split.order_by,
    )
    data, sizes = stage_observed(split.select("row_id", *features, *targets, "split"), "split", split_rows(), "split")
    result = Prepared(data, features, targets, target, mapping, sizes=sizes)
    result.note("clean", "rows", rows)
    result.note("clean", "columns", len(features))
    result.note("labels", "task_mode", config.labels.task_mode)
    result.note("labels", "target", target)
    for name, n in sizes.items():
        if n:
            result.note("split", name, n)

    if cleaning.clip_outliers and not clip_all:
        data = clip_outliers(
            data, cleaning.clip_factor, features, mode, fit_on=scale.training_rows(data)
        )
    if cleaning.nan_strategy == "drop_rows":
        data = scale.drop_incomplete(data, features)
    else:
        data, result.imputer = scale.impute(data, features, cleaning.nan_strategy, mode)
    result.note("impute", "strategy", cleaning.nan_strategy)

    chosen = config.feature_selection
    if chosen.enabled:
        data = stage(data, "imputed")
        data, features = select.variance_filter(data, features, chosen.variance_threshold)
        data, gone = select.correlation_filter(data, features, chosen.correlation_threshold)
        features = [c for c in features if c not in gone]
        if chosen.mutual_info_top_k:
            how = {"method": chosen.mutual_info_method}
            if chosen.mutual_info_method == "knn":
                how["key"] = "row_id"
            best = select.mutual_info_ranking(data, features, target, chosen.mutual_info_top_k, **how)
            kept = {r["feature"] for r in best.collect()}
            data = data.drop(*[c for c in features if c not in kept])
            features = [c for c in features if c in kept]
        result.note("select", "features", len(features))

    data, result.scaler = scale.scale(data, features, config.transform.scaler, mode)
    result.note("scale", "scaler", config.transform.scaler)

    if config.imbalance.enabled:
        data = stage(data, "scaled")
        data = balance.resample(
            data, target, features, config.imbalance.method, config.imbalance.min_class_samples,
            config.imbalance.smote_k_neighbors, config.imbalance.sampling_strategy, seed,
        )
        if "label_binary" in targets and target == "label_multi":
            data = data.withColumn("label_binary", (F.col(target) > 0).cast("int"))
        data, result.sizes = stage_observed(data, "resampled", split_rows())
        result.note("resample", config.imbalance.method, result.sizes["train"])
    train = data.filter(F.col("split") == "train")
    if config.class_weights.enabled:
        result.weights = balance.class_weights(train, target, config.class_weights.mode)
        for r in result.weights.collect():
            result.note("weights", str(r["class"]), r["weight"])
    if config.anomaly_detection.enabled:
        benign = balance.benign_rows(data, target, config.anomaly_detection.benign_label)
        result.benign = benign.select("row_id", *features)
    result.data, result.features = data, features
    return result


def prepare_folder(spark: SparkSession, folder: str, config: Config | None = None) -> Prepared:
    config = config or Config()
    started = time.time()
    raw, rows = read_folder_counted(spark, folder, config.ingest.encoding, config.ingest.fallback_encoding)
    done = prepare(raw, config, file_sources(spark, folder))
    done.summary.insert(0, ("ingest", "columns", str(len(raw.columns) - 1)))
    done.summary.insert(0, ("ingest", "rows", str(rows)))
    done.note("run", "seconds", round(time.time() - started, 1))
    return done


def write_prepared(done: Prepared, folder: str, config: Config | None = None) -> None:
    """Everything a training run needs, in one folder that a later run replaces."""
    config = config or Config()
    fmt, spark = config.transform.save_format, done.data.sparkSession
    for name in ("train", "val", "test"):
        if name != "val" or done.sizes["val"]:
            tables.save_split(
                done.data, folder, name, done.targets, done.features, fmt,
                csv_copy=config.output.save_csv_copy and name != "val",
            )
    if done.benign is not None:
        tables.save(done.benign, f"{folder}/X_train_benign", fmt)
    parameters = {
        "imputer": done.imputer,
        "scaler": done.scaler,
        "class_weights": done.weights,
        "label_map": done.label_map,
        "features": tables.feature_table(spark, done.features),
    }
    for name, table in parameters.items():
        if table is not None:
            tables.save_parameters(table, folder, name)
    summary = [*done.summary, ("save", "format", fmt)]
    if config.output.summary_to_file:
        frame = small_table(spark, summary, SUMMARY)
        frame.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
