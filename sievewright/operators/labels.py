"""Label clean-up and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import normal_form, title_case
from sievewright.session import small_table

# Canonical spelling of every known label, keyed by its normal form.
CANONICAL_LABELS = {
    "benign": "BENIGN",
    "ftp-patator": "FTP-Patator",
    "ssh-patator": "SSH-Patator",
    "dos hulk": "DoS Hulk",
    "dos goldeneye": "DoS GoldenEye",
    "dos slowloris": "DoS Slowloris",
    "dos slowhttptest": "DoS SlowHTTPTest",
    "heartbleed": "Heartbleed",
    "ddos": "DDoS",
    "web attack - brute force": "Web Attack - Brute Force",
    "web attack - xss": "Web Attack - XSS",
    "web attack - sql injection": "Web Attack - SQL Injection",
    "infiltration": "Infiltration",
    "portscan": "PortScan",
    "bot": "Bot",
}
BENIGN = "BENIGN"
#: Labels become literals of the plan; a column with more distinct values is no label.
MOST_LABELS = 5000


def _few(df: DataFrame, what: str) -> list:
    """Rows of a table that has one row per label."""
    rows = df.limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} {what}")
    return rows


def _look_up(value: Column, table: dict) -> Column:
    """A map literal: no join, so the table is not shuffled by its label."""
    if not table:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise KeyError(f"column {name!r} not found; available: {df.columns}")


def normalise_labels(
    df: DataFrame,
    label_column: str = "label",
    mapping: dict[str, str] | DataFrame | None = None,
) -> DataFrame:
    """Drop rows without a label and bring the rest to their canonical spelling.

    Unknown labels keep their own text in title case. ``mapping`` replaces the built-in table:
    a dict, or a DataFrame ``(raw, canonical)`` of at most `MOST_LABELS` normal forms; both become a literal.
    """
    require_column(df, label_column)
    df = df.filter(F.col(label_column).isNotNull())
    label = F.col(label_column).cast("string")
    if isinstance(mapping, DataFrame):
        one = mapping.groupBy(normal_form(F.col("raw")).alias("norm")).agg(F.min("canonical").alias("canonical"))
        mapping = {r["norm"]: r["canonical"] for r in _few(one, "label spellings") if r["norm"] is not None}
    known = CANONICAL_LABELS if mapping is None else mapping
    canonical = _look_up(normal_form(label), known).cast("string")
    return df.withColumn(label_column, F.coalesce(canonical, title_case(label)))


def unknown_labels(df: DataFrame, label_column: str = "label") -> DataFrame:
    """Distinct normal forms outside the canonical table."""
    norm = normal_form(F.col(label_column).cast("string"))
    return (
        df.filter(F.col(label_column).isNotNull())
        .select(norm.alias("label"))
        .filter(~F.col("label").isin(list(CANONICAL_LABELS)))
        .distinct()
    )


def binary_target(
    df: DataFrame, label_column: str = "label", target: str = "label_binary",
    benign: str = BENIGN,
) -> DataFrame:
    return df.withColumn(target, (F.col(label_column) != F.lit(benign)).cast("int"))


def label_map(df: DataFrame, label_column: str = "label", benign: str = BENIGN) -> DataFrame:
    """``(label, code)``: the benign label first, the rest in code-point order, from 0.

    Distinct labels are aggregated on the map side; more than `MOST_LABELS` are an error.
    """
    found = _few(df.select(label_column).filter(F.col(label_column).isNotNull()).distinct(), "labels")
    names = sorted((r[0] for r in found), key=lambda x: (x != benign, x))
    kind = df.schema[label_column].dataType.simpleString()
    return small_table(df.sparkSession, [(x, i) for i, x in enumerate(names)], f"label {kind}, code int")


def multiclass_target(
    df: DataFrame, label_column: str = "label", target: str = "label_multi",
    mapping: DataFrame | None = None, benign: str = BENIGN,
) -> tuple[DataFrame, DataFrame]:
    """Integer target and its label map; labels outside the map have no code."""
    mapping = label_map(df, label_column, benign) if mapping is None else mapping
    codes = {r["label"]: r["code"] for r in _few(mapping.select("label", "code"), "labels")}
    return df.withColumn(target, _look_up(F.col(label_column), codes).cast("int")), mapping


def choose_target(
    df: DataFrame, task_mode: str = "binary", label_column: str = "label"
) -> tuple[DataFrame, str, DataFrame | None]:
    """Add the target columns a task needs and drop the raw label.

    Returns the frame, the main target and the label map (None for a binary task). ``both``
    keeps the binary target beside the main one.
    """
    if task_mode not in ("binary", "multiclass", "both"):
        raise ValueError(f"unknown task mode {task_mode!r}")
    mapping = None
    target = "label_binary"
    if task_mode in ("binary", "both"):
        df = binary_target(df, label_column)
    if task_mode in ("multiclass", "both"):
        df, mapping = multiclass_target(df, label_column)
        target = "label_multi"
    return df.drop(label_column), target, mapping


def class_names(codes: DataFrame, mapping: DataFrame | None, code: str = "class") -> DataFrame:
    """Name every class code, ``class_<code>`` where the label map has none."""
    fallback = F.concat(F.lit("class_"), F.col(code).cast("string"))
    if mapping is None:
        return codes.withColumn("class_name", fallback)
    names = mapping.select(F.col("code").alias(code), F.col("label").alias("_name"))
    return (
        codes.join(names, code, "left")
        .withColumn("class_name", F.coalesce("_name", fallback))
        .drop("_name")
    )


def all_classes(first: DataFrame, second: DataFrame, target: str) -> DataFrame:
    """Classes of two frames, each once."""
    return first.select(target).union(second.select(target)).distinct()


def label_distribution(df: DataFrame, column: str = "label", total: bool = True) -> DataFrame:
    """``(label, count, percent)`` of all rows, most frequent first, then a TOTAL row."""
    rows = df.count()
    share = F.try_divide(F.col("count") * F.lit(100.0), F.lit(rows))
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("label"))
        .count()
        .withColumn("percent", share)
    )
    if not total:
        return counts.orderBy(F.desc("count"), "label")
    last = df.sparkSession.range(1).select(
        F.lit("TOTAL").alias("label"), F.lit(rows).cast("bigint").alias("count"),
        F.lit(100.0).alias("percent"), F.lit(1).alias("_last"),
    )
    ranked = counts.withColumn("_last", F.lit(0)).unionByName(last)
    return ranked.orderBy("_last", F.desc("count"), "label").drop("_last")
