"""Whole runs from raw files, and the same operators on a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.config import Config
from sievewright.operators.scale import fit_imputer, fit_scaler
from sievewright.plans.prepare import prepare_folder, write_prepared
from sievewright.plans.profile import profile_folder
from sievewright.plans.train import train_from_folder
from sievewright.sources import tables
from sievewright.streaming import apply as streams

DAYS = ["Monday", "Tuesday", "Thursday", "Friday"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Daily files with a text id, dirty numbers, gaps, a repeated line and two encodings."""
    path = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(3)
    for n, day in enumerate(DAYS):
        lines = ["Flow ID, Source IP,Timestamp, Flow Bytes/s,Packets,Const, Label"]
        for i in range(120):
            kind = int(rng.integers(0, 3))
            label = ["BENIGN", "DDoS", "Web Attack \x96 XSS"][kind]
            speed = rng.normal(10 + 8 * kind, 3)
            text = "Infinity" if i % 31 == 0 else ("" if i % 29 == 0 else f"{speed:.4f}")
            lines.append(f"f{day}{i},10.0.0.{i % 9},{n}/7/2017,{text},{rng.integers(1, 50)},7,{label}")
        lines.append(lines[5])
        (path / f"{day}-Hours.csv").write_bytes("\n".join(lines).encode("latin-1"))
    return str(path)


def test_folder_to_tables(spark, folder, tmp_path):
    done = prepare_folder(spark, folder)
    assert done.features == ["flow_bytes_s", "packets", "const"]
    assert {r["split"]: r["count"] for r in done.data.groupBy("split").count().collect()} == {
        "train": 360, "test": 120
    }
    train = done.split("train")
    assert train.filter("flow_bytes_s is null").count() == 0
    row = train.agg(F.avg("packets"), F.stddev_pop("packets"), F.max(F.abs("const"))).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1) and row[2] == 0
    assert done.benign.count() == train.filter("label_binary = 0").count()
    out = str(tmp_path / "out")
    write_prepared(done, out)
    assert tables.load_features(spark, out) == done.features
    assert tables.load_split(spark, out, "train").count() == 360
    notes = {(r["stage"], r["metric"]): r["value"] for r in spark.read.json(f"{out}/summary").collect()}
    assert notes[("ingest", "rows")] == "484" and notes[("clean", "rows")] == "480"
    assert notes[("save", "format")] == "parquet"

    fitted, metrics = train_from_folder(spark, out, str(tmp_path / "run"), tune=True, tune_size=0.2)
    values = {r["metric"]: r["value"] for r in metrics.filter("class is null").collect()}
    assert values["roc_auc"] > 0.9 and values["tp"] + values["fn"] + values["fp"] + values["tn"] == 120
    stored = tables.load_metrics(spark, str(tmp_path / "run/metrics/binary_lr_test"))
    assert stored.count() == metrics.count()
    tuned = {r["class"]: r["value"] for r in stored.filter("metric = 'threshold_tuning'").collect()}
    assert tuned["threshold"] == fitted.threshold

    profile = profile_folder(spark, out)
    assert sum(r["count"] for r in profile["classes_test"].collect()) == 120
    assert profile["leakage"].count() == 0
    assert profile["missing_train"].filter("missing > 0").count() == 0
    assert profile["correlations"].count() == 3


def test_multiclass_run_with_everything_on(spark, folder, tmp_path):
    config = Config.from_dict(
        {
            "cleaning": {"nan_strategy": "mean", "clip_factor": 3.0, "fit_on": "train"},
            "split": {"strategy": "random", "val_size": 0.1, "test_size": 0.2},
            "feature_selection": {"enabled": True, "mutual_info_top_k": 1},
            "transform": {"save_format": "feather"},
            "output": {"save_csv_copy": True},
            "unknown": {"x": 1},
        }
    ).override(task="both", scaler="robust", resample="smote", seed=7)
    assert config.imbalance.enabled and config.random_seed == 7
    done = prepare_folder(spark, folder, config)
    assert done.features == ["flow_bytes_s"] and done.targets == ["label_binary", "label_multi"]
    counts = [r["count"] for r in done.split("train").groupBy("label_multi").count().collect()]
    assert len(set(counts)) == 1
    assert done.data.filter((F.col("label_multi") > 0) != (F.col("label_binary") == 1)).count() == 0
    out = str(tmp_path / "out")
    write_prepared(done, out, config)
    assert tables.load(spark, f"{out}/X_train", "csv").count() == sum(counts)
    assert tables.load_split(spark, out, "val", "feather").count() == 48
    fitted, metrics = train_from_folder(
        spark, out, str(tmp_path / "run"), "multiclass", fmt="feather"
    )
    values = {r["metric"]: r["value"] for r in metrics.filter("class is null").collect()}
    assert values["roc_auc_ovr_weighted"] > 0.8 and fitted.tuning is None
    names = {r["class"] for r in metrics.filter("class is not null").collect()}
    assert {"BENIGN", "DDoS", "Web Attack - XSS"} <= names


def test_drop_rows_and_ordered_split(spark, folder):
    config = Config.from_dict(
        {"cleaning": {"nan_strategy": "drop_rows"}, "split": {"strategy": "time_based", "test_size": 0.25}}
    )
    done = prepare_folder(spark, folder, config)
    assert done.imputer is None
    assert done.data.filter("flow_bytes_s is null").count() == 0
    # files are taken in name order, so the last quarter is the last file by name
    last = done.split("test").agg(F.min(F.shiftright("row_id", 40)), F.max(F.shiftright("row_id", 40))).first()
    assert tuple(last) == (3, 3)


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.range(300).selectExpr(
        "id as row_id", "case when id % 7 = 0 then 'inf' when id % 11 = 0 then '' else cast(id as string) end as ` A`",
        "concat(' ', case when id % 2 = 0 then 'benign' else 'ddos' end) as ` Label`", "'10.0.0.1' as `Src IP`",
    )
    raw.repartition(4).write.parquet(str(tmp_path / "in"))
    batch = streams.clean_stream(spark.read.parquet(str(tmp_path / "in")), ("source_ip",))
    assert batch.columns == ["row_id", "a", "label", "label_binary"]
    imputer, scaler = fit_imputer(batch, ["a"]), None
    scaler = fit_scaler(streams.prepare_stream(batch, imputer, None), ["a"])
    expected = streams.prepare_stream(batch, imputer, scaler)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = streams.prepare_stream(streams.clean_stream(stream, ("source_ip",)), imputer, scaler)
    streams.write_batches(live, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert got.select("epoch").distinct().count() == 4
    assert {tuple(r) for r in got.select(expected.columns).collect()} == {tuple(r) for r in expected.collect()}


def test_stream_repeats(spark, tmp_path):
    rows = spark.range(20).selectExpr(
        "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) as ts", "id % 4 as v"
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    once = streams.drop_repeats(stream, "ts", ["v"])
    streams.write_batches(once, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out") + "/*").count() == 4


def test_sizes_come_from_the_writing_jobs(spark, folder):
    config = Config.from_dict({"imbalance": {"enabled": True, "method": "random_over"}})
    done = prepare_folder(spark, folder, config)
    counted = {r["split"]: r["count"] for r in done.data.groupBy("split").count().collect()}
    assert {k: n for k, n in done.sizes.items() if n} == counted
    notes = {(r["stage"], r["metric"]): r["value"] for r in done.summary_table().collect()}
    assert notes["resample", "random_over"] == str(counted["train"]) and notes["ingest", "rows"] == "484"


@pytest.mark.parametrize("rows", [0, 7])
def test_observed_stage(spark, rows):
    from sievewright.session import stage_observed

    staged, seen = stage_observed(spark.range(rows), "observed", {"rows": F.count(F.lit(1)), "high": F.max("id")})
    assert seen == {"rows": rows, "high": rows - 1 if rows else None} and staged.count() == rows


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    scored = spark.range(90).selectExpr(
        "case when id % 9 < 8 then cast(id % 2 as int) end as y", "id / 89 as p", "cast(id >= 45 as int) as prediction"
    )
    scored.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    streams.write_counts(streams.count_scores(stream, "y"), out, str(tmp_path / "check")).awaitTermination()
    got = streams.latest_counts(spark, out).collect()
    assert sorted(map(str, got)) == sorted(map(str, streams.count_scores(scored, "y").collect()))
    assert sum(r["rows"] for r in got) == 90 and max(r["bin"] for r in got) == 9
