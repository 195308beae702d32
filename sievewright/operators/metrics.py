"""Classification metrics as small tables. Everything exact, no binning of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.numbers import ratio
from sievewright.functions.ranks import DIRECT_ROWS, running_totals
from sievewright.session import small_table

METRICS_SCHEMA = "model string, metric string, class string, value double"
CONFUSION_SCHEMA = "actual int, predicted int, count bigint"
THRESHOLDS = [float(t) for t in np.linspace(0.01, 0.99, 99)]


# -- from the confusion table --------------------------------------------------------------


def _tall(row: DataFrame, names: list[str]) -> DataFrame:
    doubles = row.select(*[F.col(c).cast("double").alias(c) for c in names])
    return doubles.unpivot([], names, "metric", "value")


def confusion_table(
    df: DataFrame, actual: str = "y", predicted: str = "prediction", labels: list | None = None
) -> DataFrame:
    """``(actual, predicted, count)`` for every pair of labels, zeros included.

    ``labels`` fixes the universe; by default it is every label seen on either side. One pass
    over the rows; the metrics below then work on this table of labels squared alone.
    """
    counted = df.groupBy(
        F.col(actual).cast("int").alias("a"), F.col(predicted).cast("int").alias("p")
    ).count().filter("a is not null and p is not null")
    cells = {(r["a"], r["p"]): r["count"] for r in counted.collect()}
    if labels is None:
        labels = sorted({label for pair in cells for label in pair})
    rows = [(int(a), int(p), cells.get((a, p), 0)) for a in labels for p in labels]
    return small_table(df.sparkSession, rows, CONFUSION_SCHEMA)


def class_report(
    df: DataFrame, actual: str = "y", predicted: str = "prediction", labels: list | None = None
) -> DataFrame:
    """Per-class precision, recall, f1 and support, with accuracy and two averages."""
    return report_from(confusion_table(df, actual, predicted, labels))


def _per_class(confusion: DataFrame) -> DataFrame:
    """One row per label: hits, times predicted, times true."""
    sides = confusion.select(
        "count",
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("c"), F.lit(1).alias("true"), F.lit(0).alias("said")),
                F.struct(
                    F.col("predicted").alias("c"), F.lit(0).alias("true"), F.lit(1).alias("said")
                ),
            )
        ).alias("x"),
        (F.col("actual") == F.col("predicted")).cast("int").alias("same"),
    )
    n = F.col("count")
    return sides.groupBy(F.col("x.c").alias("class")).agg(
        F.sum(n * F.col("same") * F.col("x.true")).alias("hits"),
        F.sum(n * F.col("x.said")).alias("said"),
        F.sum(n * F.col("x.true")).alias("support"),
    ).select(
        "class", "hits", "said", "support",
        ratio(F.col("hits"), F.col("said")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("said") + F.col("support")).alias("f1"),
    )


def report_from(confusion: DataFrame) -> DataFrame:
    classes = _per_class(confusion)
    scores = ["precision", "recall", "f1"]
    support = F.sum("support")
    weighted = [
        ratio(F.sum(F.col(c) * F.col("support")), support).alias(c) for c in scores
    ]
    rows = classes.select(F.col("class").cast("string").alias("class"), *scores, "support")
    macro = classes.agg(
        *[F.avg(c).alias(c) for c in scores], support.alias("support")
    ).withColumn("class", F.lit("macro avg"))
    mean = classes.agg(*weighted, support.alias("support")).withColumn(
        "class", F.lit("weighted avg")
    )
    hit_rate = ratio(F.sum("hits"), support)
    accuracy = classes.agg(
        *[hit_rate.alias(c) for c in scores], support.alias("support")
    ).withColumn("class", F.lit("accuracy"))
    return rows.unionByName(accuracy).unionByName(macro).unionByName(mean)


def core_metrics(
    df: DataFrame, actual: str = "y", predicted: str = "prediction", task: str = "binary",
    labels: list | None = None,
) -> DataFrame:
    """Accuracy and balanced accuracy plus the binary or the weighted scores, one per row."""
    if task == "binary":
        labels = [0, 1]
    return core_from(confusion_table(df, actual, predicted, labels), task)


def core_from(confusion: DataFrame, task: str) -> DataFrame:
    classes = _per_class(confusion)
    general = classes.agg(
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )
    tall = _tall(general, ["accuracy", "balanced_accuracy"])
    if task == "binary":
        cell = {
            name: F.sum(
                F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("count"))
                .otherwise(0)
            ).alias(name)
            for name, a, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))
        }
        row = confusion.agg(*cell.values()).withColumns(binary_scores())
        return tall.unionByName(
            _tall(row, ["tp", "fp", "fn", "tn", "fpr", "precision", "recall", "f1"])
        )
    weighted = classes.agg(
        *[
            ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"{c}_weighted")
            for c in ("precision", "recall", "f1")
        ]
    )
    return tall.unionByName(_tall(weighted, [f"{c}_weighted" for c in ("precision", "recall", "f1")]))


def binary_scores() -> dict[str, Column]:
    """Rates from the columns tp, fp, fn, tn, with 0 for 0/0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "fpr": ratio(fp, fp + tn),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * (precision * recall), precision + recall),
    }


# -- from the scores -------------------------------------------------------------------------


def score_table(
    df: DataFrame, actual: str = "y", score: str = "p", group: str | None = None,
    bucket_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """One row per distinct score with its positives and negatives and, counted from the
    highest score down, the true and false positives at that threshold.

    Equal scores are merged on the map side first, so one frequent score is one row.
    """
    keys = [group] if group else []
    positive = (F.col(actual) > 0).cast("bigint")
    rows = df.select(*keys, F.col(score).alias("score"), positive.alias("pos"))
    rows = rows.filter(F.col("score").isNotNull() & F.col("pos").isNotNull())
    table = rows.groupBy(*keys, "score").agg(
        F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg")
    )
    return running_totals(
        table, keys, "score", {"pos": "tp", "neg": "fp"}, rows.count(), bucket_rows
    )


def _areas(table: DataFrame, keys: list[str]) -> DataFrame:
    """Areas and totals per group in one aggregate over the score table.

    With positives P and negatives N known only at the end, each sum is kept unnormalised:
    ROC area = sum(neg * (tp - pos/2)) / (P*N), precision steps weigh pos by precision.
    """
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    now = tp / (tp + fp)
    before = F.coalesce(F.try_divide(tp - pos, tp - pos + fp - neg), F.lit(1.0))
    summed = table.groupBy(*keys).agg(
        F.sum("pos").cast("double").alias("P"),
        F.sum("neg").cast("double").alias("N"),
        F.sum(neg * (tp - pos / 2)).alias("roc"),
        F.sum(pos * now).alias("ap"),
        F.sum(pos * (now + before) / 2).alias("pr"),
    )
    return summed.select(
        *keys, "P", "N",
        F.try_divide("roc", F.col("P") * F.col("N")).alias("roc_auc"),
        F.try_divide("pr", "P").alias("pr_auc"),
        F.try_divide("ap", "P").alias("average_precision"),
    )


def probability_metrics(
    df: DataFrame, actual: str = "y", score: str = "p", bucket_rows: int = DIRECT_ROWS
) -> DataFrame:
    """Exact ROC-AUC, trapezoid PR-AUC and average precision, one per row.

    A truth with a single class has no such areas; those rows are left out.
    """
    areas = _areas(score_table(df, actual, score, None, bucket_rows), [])
    defined = areas.filter((F.col("P") > 0) & (F.col("N") > 0))
    return _tall(defined, ["roc_auc", "pr_auc", "average_precision"])


def one_vs_rest_auc(
    df: DataFrame, classes: list, actual: str = "y", probabilities: str = "probabilities",
    bucket_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """ROC-AUC of every class against the rest: ``(class, support, roc_auc)``.

    ``probabilities`` is an array in the order of ``classes``; classes absent from the truth
    have no area.
    """
    codes = F.array(*[F.lit(int(c)) for c in classes])
    spread = df.select(
        F.col(actual).alias("_y"), F.posexplode(F.col(probabilities)).alias("_i", "p")
    ).select(
        F.element_at(codes, F.col("_i") + 1).alias("class"), "_y", "p"
    )
    table = score_table(
        spread.withColumn("y", (F.col("_y") == F.col("class")).cast("int")), "y", "p", "class",
        bucket_rows,
    )
    return (
        _areas(table, ["class"])
        .filter((F.col("P") > 0) & (F.col("N") > 0))
        .select("class", F.col("P").cast("bigint").alias("support"), "roc_auc")
    )


def multiclass_auc(
    df: DataFrame, classes: list, actual: str = "y", probabilities: str = "probabilities"
) -> DataFrame:
    """Support-weighted one-vs-rest ROC-AUC over the classes present in the truth."""
    areas = one_vs_rest_auc(df, classes, actual, probabilities)
    mean = areas.agg(
        F.try_divide(F.sum(F.col("roc_auc") * F.col("support")), F.sum("support")).alias(
            "roc_auc_ovr_weighted"
        )
    )
    return _tall(mean, ["roc_auc_ovr_weighted"]).filter(F.col("value").isNotNull())


def roc_points(
    df: DataFrame, actual: str = "y", score: str = "p", drop_collinear: bool = True,
    bucket_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """``(threshold, fpr, tpr)``: the origin (infinite threshold), then one point per score.

    ``drop_collinear`` leaves out points inside a straight run, as plots need only corners: a
    point goes if the next lower score adds the same positives and negatives.
    """
    table = score_table(df, actual, score, None, bucket_rows)
    totals = table.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    if drop_collinear:
        table = _mark_corners(table, bucket_rows)
    curve = table.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.lit(float(totals["N"] or 0))).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.lit(float(totals["P"] or 0))).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(curve)


def _mark_corners(table: DataFrame, bucket_rows: int) -> DataFrame:
    """Corner points of the curve: the first, the last and every change of step.

    A step repeats if its neighbour at ``(tp + pos, fp + neg)`` exists, which is an equality
    join on the running counts instead of a table-wide window.
    """
    edges = table.agg(F.max("score").alias("top"), F.min("score").alias("bottom")).first()
    following = table.select(
        (F.col("tp") - F.col("pos")).alias("tp"), (F.col("fp") - F.col("neg")).alias("fp"),
        F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"),
    )
    joined = table.join(following, ["tp", "fp"], "left")
    same = (F.col("pos") == F.col("next_pos")) & (F.col("neg") == F.col("next_neg"))
    ends = F.col("score").isin(edges["top"], edges["bottom"])
    return joined.filter(ends | ~F.coalesce(same, F.lit(False))).select(table.columns)


def pr_points(
    df: DataFrame, actual: str = "y", score: str = "p", bucket_rows: int = DIRECT_ROWS
) -> DataFrame:
    """``(threshold, recall, precision, baseline)``, closed by recall 0 at precision 1."""
    table = score_table(df, actual, score, None, bucket_rows)
    totals = table.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    p, n = (float(totals[c] or 0) for c in ("P", "N"))
    baseline = F.try_divide(F.lit(p), F.lit(p + n)).alias("baseline")
    curve = table.select(
        F.col("score").alias("threshold"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.lit(p)), F.lit(1.0)).alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        baseline,
    )
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"),
        F.lit(1.0).alias("precision"), baseline,
    )
    return curve.unionByName(end)


# -- thresholds --------------------------------------------------------------------------------


def apply_threshold(df: DataFrame, threshold: float, score: str = "p") -> DataFrame:
    return df.withColumn("prediction", (F.col(score) >= F.lit(threshold)).cast("int"))


def threshold_table(
    df: DataFrame, actual: str = "y", score: str = "p", thresholds: list[float] | None = None
) -> DataFrame:
    """Counts and rates at every threshold, from one pass over the rows.

    Each score falls to the number of thresholds it reaches; counts per step are then summed
    from the top over a table with one row per threshold.
    """
    grid = sorted(THRESHOLDS if thresholds is None else thresholds)
    steps = F.array(*[F.lit(t) for t in grid])
    reached = F.size(F.filter(steps, lambda t: t <= F.col(score)))
    if thresholds is None:
        # the grid is even, so the step is known up to rounding: look at the neighbours only
        guess = F.floor(F.least(F.greatest(F.col(score) * 100, F.lit(0.0)), F.lit(99.0)))
        guess = guess.cast("int")
        fence = F.array(F.lit(float("-inf")), *[F.lit(t) for t in grid], F.lit(float("inf")))
        up = (F.element_at(fence, guess + 2) <= F.col(score)).cast("int")
        down = (F.element_at(fence, guess + 1) > F.col(score)).cast("int")
        reached = guess + up - down
    positive = (F.col(actual) > 0).cast("bigint")
    tally = (
        df.filter(F.col(score).isNotNull() & F.col(actual).isNotNull())
        .groupBy(reached.alias("step"))
        .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    )
    frame = df.sparkSession.range(len(grid) + 1).select(F.col("id").cast("int").alias("step"))
    filled = frame.join(tally, "step", "left").na.fill(0, ["pos", "neg"])
    every = Window.partitionBy(F.lit(0))  # one row per threshold
    above = every.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    counted = filled.select(
        "step",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(every).alias("P"),
        F.sum("neg").over(every).alias("N"),
    ).filter(F.col("step") > 0)
    counted = counted.select(
        F.element_at(steps, F.col("step")).alias("threshold"),
        "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"),
    )
    return counted.withColumns(binary_scores()).select(
        "threshold", "f1", "precision", "recall", "fpr", "tp", "fp", "fn", "tn"
    )


def best_threshold(
    df: DataFrame, actual: str = "y", score: str = "p", thresholds: list[float] | None = None
) -> DataFrame:
    """The threshold of highest f1 on the attack class, the lowest one on ties."""
    table = threshold_table(df, actual, score, thresholds)
    return table.orderBy(F.desc("f1"), "threshold").limit(1)


# -- everything at once ------------------------------------------------------------------------

def evaluate(
    df: DataFrame, model_name: str, task: str = "binary", actual: str = "y",
    predicted: str = "prediction", score: str | None = "p", labels: list | None = None,
    names: dict | None = None,
) -> DataFrame:
    """All metrics of a scored frame as ``(model, metric, class, value)``.

    For ``multiclass`` the score column is an array of probabilities in the order of
    ``labels``. ``names`` maps class codes to names for the report rows.
    """
    if task == "binary":
        labels = labels or [0, 1]
    confusion = confusion_table(df, actual, predicted, labels)
    overall = core_from(confusion, task)
    if score is not None:
        if task == "binary":
            overall = overall.unionByName(probability_metrics(df, actual, score))
        else:
            if labels is None:
                labels = sorted(r[0] for r in df.select(actual).distinct().collect())
            overall = overall.unionByName(multiclass_auc(df, labels, actual, score))
    overall = overall.select("metric", F.lit(None).cast("string").alias("class"), "value")
    report = report_from(confusion)
    if names:
        shown = F.create_map(*[F.lit(str(x)) for pair in names.items() for x in pair])
        report = report.withColumn(
            "class", F.coalesce(F.try_element_at(shown, F.col("class")), F.col("class"))
        )
    per_class = report.withColumn("support", F.col("support").cast("double")).unpivot(
        ["class"], ["precision", "recall", "f1", "support"], "metric", "value"
    )
    parts = overall.unionByName(per_class.select("metric", "class", "value"))
    return parts.select(F.lit(model_name).alias("model"), "metric", "class", "value")


def key_metrics(metrics: DataFrame) -> DataFrame:
    """The metrics of the whole frame, without those of single classes, by name."""
    return metrics.filter(F.col("class").isNull()).orderBy("metric")
