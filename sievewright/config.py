"""Run configuration as frozen dataclasses, filled from plain dicts."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from sievewright.operators.split import DAY_ASSIGNMENT


@dataclass(frozen=True)
class Ingest:
    encoding: str = "utf-8"
    fallback_encoding: str = "latin-1"


@dataclass(frozen=True)
class Cleaning:
    columns_to_drop: tuple[str, ...] = (
        "flow_id", "source_ip", "destination_ip", "source_port", "destination_port", "timestamp",
    )
    replace_inf_with: str = "nan"
    nan_strategy: str = "median"  # median | mean | most_frequent | zero | drop_rows
    remove_duplicates: bool = True
    clip_outliers: bool = True
    clip_factor: float = 5.0
    fit_on: str = "all"  # all | train: rows the clip fences are fitted on
    compat: bool = False


@dataclass(frozen=True)
class Labels:
    label_column: str = "label"
    task_mode: str = "binary"  # binary | multiclass | both


@dataclass(frozen=True)
class Split:
    strategy: str = "day_based"  # random | day_based | time_based
    test_size: float = 0.2
    val_size: float = 0.0
    day_assignment: dict = field(default_factory=lambda: dict(DAY_ASSIGNMENT))
    order_by: str | None = None


@dataclass(frozen=True)
class Transform:
    scaler: str = "standard"  # robust | standard | minmax | none
    save_format: str = "parquet"  # parquet | orc | feather (as orc) | csv
    quantiles: str = "exact"  # exact | approx


@dataclass(frozen=True)
class Imbalance:
    enabled: bool = False
    method: str = "smote"
    min_class_samples: int = 6
    smote_k_neighbors: int = 5
    sampling_strategy: Any = "auto"


@dataclass(frozen=True)
class ClassWeights:
    enabled: bool = True
    mode: Any = "balanced"


@dataclass(frozen=True)
class FeatureSelection:
    enabled: bool = False
    variance_threshold: float = 0.0
    correlation_threshold: float = 0.95
    mutual_info_top_k: int | None = None
    mutual_info_method: str = "knn"  # knn (nearest neighbours) | binned (one pass, coarser)


@dataclass(frozen=True)
class AnomalyDetection:
    enabled: bool = True
    benign_label: int = 0


@dataclass(frozen=True)
class Output:
    save_csv_copy: bool = False
    summary_to_file: bool = True


@dataclass(frozen=True)
class Config:
    random_seed: int = 42
    ingest: Ingest = Ingest()
    cleaning: Cleaning = Cleaning()
    labels: Labels = Labels()
    split: Split = field(default_factory=Split)
    transform: Transform = Transform()
    imbalance: Imbalance = Imbalance()
    class_weights: ClassWeights = ClassWeights()
    feature_selection: FeatureSelection = FeatureSelection()
    anomaly_detection: AnomalyDetection = AnomalyDetection()
    output: Output = Output()

    @classmethod
    def from_dict(cls, given: dict) -> Config:
        """Defaults replaced by the given sections and keys; keys without a meaning are skipped."""
        config = cls()
        changes: dict[str, Any] = {}
        for f in fields(cls):
            if f.name not in given or given[f.name] is None:
                continue
            current = getattr(config, f.name)
            if is_dataclass(current):
                known = {x.name for x in fields(current)}
                part = {k: v for k, v in given[f.name].items() if k in known}
                if "columns_to_drop" in part:
                    part["columns_to_drop"] = tuple(part["columns_to_drop"] or ())
                changes[f.name] = replace(current, **part)
            else:
                changes[f.name] = given[f.name]
        return replace(config, **changes)

    def override(
        self, task: str | None = None, split: str | None = None, scaler: str | None = None,
        resample: str | None = None, seed: int | None = None,
    ) -> Config:
        """Command-style overrides; naming a resampling method also turns it on."""
        config = self
        if task:
            config = replace(config, labels=replace(config.labels, task_mode=task))
        if split:
            config = replace(config, split=replace(config.split, strategy=split))
        if scaler:
            config = replace(config, transform=replace(config.transform, scaler=scaler))
        if resample:
            config = replace(
                config, imbalance=replace(config.imbalance, enabled=True, method=resample)
            )
        if seed is not None:
            config = replace(config, random_seed=seed)
        return config
