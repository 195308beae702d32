"""Prepared tables to a fitted model and its metrics on the test split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators import labels
from sievewright.operators.metrics import METRICS_SCHEMA, evaluate
from sievewright.operators.model import Fitted, binary_from_codes, fit_and_tune, predict, save_model
from sievewright.session import small_table, stage
from sievewright.sources import tables


def train_and_evaluate(
    train: DataFrame, test: DataFrame, features: list[str], target: str, task: str = "binary",
    model: str = "lr", threshold: float = 0.5, tune: bool = False, tune_size: float = 0.1,
    seed: int = 42, label_map: DataFrame | None = None, weights: DataFrame | None = None,
) -> tuple[Fitted, DataFrame]:
    """Fit on train, decide on test, and list every metric in tall form."""
    fitted = fit_and_tune(
        train, features, target, task, model, threshold, tune, tune_size, seed, weights=weights
    )
    if task == "binary":
        test = binary_from_codes(test, target)
        codes, names = [0, 1], {0: "BENIGN", 1: "Attack"}
    else:
        seen = labels.all_classes(train, test, target).withColumnRenamed(target, "class")
        named = labels.class_names(seen, label_map).collect()
        names = {int(r["class"]): r["class_name"] for r in named}
        codes = sorted(names)
    scored = predict(test, fitted)
    shown = ["row_id", F.col(target).alias("y"), "prediction"]
    if task == "binary":
        shown.append("p")
        score = "p"
    else:
        # the model lists a probability per code up to its largest one
        shown.append(
            F.array(
                *[F.coalesce(F.get("probabilities", F.lit(c)), F.lit(0.0)) for c in codes]
            ).alias("probabilities")
        )
        score = "probabilities"
    scored = stage(scored.select(*shown), "scored")
    run = f"{task}_{model}_test"
    metrics = evaluate(scored, run, task, "y", "prediction", score, codes, names)
    if fitted.tuning:
        rows = [(run, "threshold_tuning", k, float(v)) for k, v in fitted.tuning.items()]
        extra = small_table(train.sparkSession, rows, METRICS_SCHEMA)
        metrics = metrics.unionByName(extra)
    return fitted, metrics


def train_from_folder(
    spark: SparkSession, folder: str, out: str, task: str = "binary", model: str = "lr",
    threshold: float = 0.5, tune: bool = False, tune_size: float = 0.1, seed: int = 42,
    fmt: str = "parquet",
) -> tuple[Fitted, DataFrame]:
    """Read prepared tables, train, and write the model and its metrics."""
    features = tables.load_features(spark, folder)
    train, test = (tables.load_split(spark, folder, s, fmt) for s in ("train", "test"))
    held = [c for c in ("label_multi", "label_binary") if c in train.columns]
    target = held[0] if task == "multiclass" or len(held) == 1 else "label_binary"
    mapping = weights = None
    if task == "multiclass":
        if target != "label_multi":
            raise FileNotFoundError("the prepared tables have no multiclass target")
        mapping = tables.load_parameters(spark, folder, "label_map")
        weights = tables.load_parameters(spark, folder, "class_weights")
    fitted, metrics = train_and_evaluate(
        train, test, features, target, task, model, threshold, tune, tune_size, seed, mapping,
        weights,
    )
    save_model(fitted.model, f"{out}/models/{task}_{model}")
    tables.save_metrics(metrics, f"{out}/metrics/{task}_{model}_test")
    return fitted, metrics
