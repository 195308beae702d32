"""Names, numbers and label texts."""

import pytest
from pyspark.sql import functions as F

from sievewright.functions.names import mangle_header, normalise_columns, numeric_columns, tidy_names
from sievewright.functions.numbers import clamp, finite, to_number
from sievewright.operators import labels
from sievewright.operators.clean import coerce_numbers


def test_header_copies_and_blanks():
    assert mangle_header(["A", "B", "B", "b", ""]) == ["A", "B", "B.1", "b", "Unnamed: 4"]
    assert mangle_header(["B", "B.1", "B"]) == ["B", "B.1", "B.2"]


def test_tidy_names():
    raw = [" Flow Bytes/s", "Fwd Header Length", "Fwd Header Length", "a..b", "_x_", "Src IP", " Label"]
    assert tidy_names(raw) == [
        "flow_bytes_s", "fwd_header_length", "fwd_header_length_1", "a_b", "x", "source_ip", "label",
    ]
    assert tidy_names(mangle_header(raw))[2] == "fwd_header_length_1"
    assert tidy_names(["X", "x ", "x!"]) == ["x", "x_1", "x_2"]


def test_normalise_columns_touches_names_only(spark):
    df = spark.createDataFrame([(1, 2.0, "t")], "` Dst IP` int, `A/B c` double, ` Label` string")
    tidy = normalise_columns(df)
    assert tidy.columns == ["destination_ip", "a_b_c", "label"]
    assert numeric_columns(tidy) == ["destination_ip", "a_b_c"]
    assert numeric_columns(tidy, first=1) == ["destination_ip"]


NUMBERS = {
    "Infinity": float("inf"), "-inf": float("-inf"), " 12 ": 12.0, "1.0d": None, "1f": None,
    "0x10": None, "1e3": 1000.0, "": None, "1_000": None, "True": None, "1,000": None,
    "192.168.1.1": None, "NaN": None, "-7": -7.0, ".5": 0.5, "x": None,
}


def test_number_texts(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "v string")
    rows = df.select("v", F.nullif(to_number(F.col("v")), F.lit(float("nan"))).alias("n")).collect()
    assert {r["v"]: r["n"] for r in rows} == NUMBERS
    rows = df.select("v", finite(to_number(F.col("v"))).alias("n")).collect()
    assert {r["v"]: r["n"] for r in rows if r["v"] in ("Infinity", "-inf", "NaN", "1e3")} == {
        "Infinity": None, "-inf": None, "NaN": None, "1e3": 1000.0,
    }


def test_coercion_by_type(spark):
    df = spark.createDataFrame(
        [(1, "2", True, None, float("nan"), "keep")],
        "i int, s string, b boolean, t timestamp, d double, label string",
    )
    out = coerce_numbers(df, keep=["label"])
    assert dict(out.dtypes) == {
        "i": "double", "s": "double", "b": "boolean", "t": "double", "d": "double", "label": "string",
    }
    assert out.first().asDict() == {"i": 1.0, "s": 2.0, "b": True, "t": None, "d": None, "label": "keep"}


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (1.0,), (9.0,), (5.0,)], "v double")
    assert [r[0] for r in df.select(clamp(F.col("v"), 2.0, 6.0)).collect()] == [None, 2.0, 6.0, 5.0]


@pytest.mark.parametrize("dash", ["\x96", "–", "—", "―", "−", "-"])
def test_canonical_labels_with_every_dash(spark, dash):
    raw = [f"  {k.upper().replace('-', dash).replace(' ', '  ')} " for k in labels.CANONICAL_LABELS]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, label string")
    got = [r["label"] for r in labels.normalise_labels(df).orderBy("i").collect()]
    assert got == list(labels.CANONICAL_LABELS.values())


def test_unknown_labels_are_title_cased(spark):
    raw = ["Web Attack  Brute Force", " web attack � xss ", "don't x2y", None, "web-attack"]
    df = spark.createDataFrame([(r,) for r in raw], "label string")
    got = [r[0] for r in labels.normalise_labels(df).collect()]
    assert got == [r.strip().title() for r in raw if r is not None]


def test_missing_label_column(spark):
    with pytest.raises(KeyError):
        labels.normalise_labels(spark.range(1))


def test_targets(spark):
    df = spark.createDataFrame([("DDoS",), ("BENIGN",), ("Bot",), ("BENIGN",)], "label string")
    both, target, mapping = labels.choose_target(df, "both")
    assert target == "label_multi"
    assert {r["label"]: r["code"] for r in mapping.collect()} == {"BENIGN": 0, "Bot": 1, "DDoS": 2}
    assert sorted(tuple(r) for r in both.collect()) == [(0, 0), (0, 0), (1, 1), (1, 2)]
    assert labels.choose_target(df, "binary")[2] is None
    with pytest.raises(ValueError):
        labels.choose_target(df, "other")


def test_distribution_percent_is_of_all_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "label string")
    got = [tuple(r) for r in labels.label_distribution(df).collect()]
    assert got == [("a", 2, 50.0), ("b", 1, 25.0), ("TOTAL", 4, 100.0)]
