"""Feature selection: variance, correlation and mutual information, fitted on training rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.hashing import row_hash, unit_interval
from sievewright.functions.names import numeric_columns
from sievewright.functions.ranks import quantiles, running_totals
from sievewright.operators.scale import training_rows
from sievewright.session import small_table, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def variance_table(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """``(feature, variance)`` with the population variance, exactly 0 for a constant."""
    features = numeric_columns(df) if features is None else features
    stats = []
    for c in features:
        value = F.col(c).cast("double")
        stats.append(F.when(F.max(value) == F.min(value), 0.0).otherwise(F.var_pop(value)).alias(c))
    return training_rows(df).agg(*stats).unpivot([], features, "feature", "variance")


def variance_filter(
    df: DataFrame, features: list[str] | None = None, threshold: float = 0.0
) -> tuple[DataFrame, list[str]]:
    """Drop features whose training variance is at most ``threshold``; returns the kept ones."""
    features = numeric_columns(df) if features is None else features
    variance = {r["feature"]: r["variance"] for r in variance_table(df, features).collect()}
    kept = [c for c in features if variance[c] is not None and variance[c] > threshold]
    return df.drop(*[c for c in features if c not in kept]), kept


def correlation_matrix(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered pair as ``(i, j, feature_i, feature_j, r)``, i < j.

    Pairs count rows where both values are present; r is NULL if either side is constant there. Two passes for any
    number of columns, with gaps or without: means, then sums of products around them, which tasks form as matrix
    products of bounded batches and Spark adds up.
    """
    features = numeric_columns(df) if features is None else features
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)])
    schema = "i int, j int, feature_i string, feature_j string, r double"
    if not features:
        return small_table(df.sparkSession, [], schema)
    means = data.agg(*[F.avg(F.nanvl(F.col(c), F.lit(None))).alias(c) for c in data.columns]).first()
    centre = np.array([0.0 if m is None or not np.isfinite(m) else m for m in means])
    sums = data.mapInArrow(_products(centre), "i int, j int, n double, x double, y double, xx double, yy double,"
                           " xy double, xlo double, xhi double, ylo double, yhi double")
    total = sums.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")],
        *[F.min(c).alias(c) for c in ("xlo", "ylo")], *[F.max(c).alias(c) for c in ("xhi", "yhi")],
    )
    around = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    spread = F.sqrt(F.col("xx") - F.col("x") ** 2 / F.col("n")) * F.sqrt(F.col("yy") - F.col("y") ** 2 / F.col("n"))
    varies = (F.col("xlo") < F.col("xhi")) & (F.col("ylo") < F.col("yhi"))
    known = total.select("i", "j", F.when(varies, F.try_divide(around, spread)).alias("r"))
    pairs = [(i, j, features[i], features[j]) for i, j in combinations(range(len(features)), 2)]
    listed = small_table(df.sparkSession, pairs, "i int, j int, feature_i string, feature_j string")
    return listed.join(known, ["i", "j"], "left").select("i", "j", "feature_i", "feature_j", "r")


def _products(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task and pair: rows with both values, sums of x, y and their products, least and largest values."""
        d = len(centre)
        sums, least = np.zeros((4, d, d)), np.full((d, d), np.inf)
        most = -least
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1).astype(float) - centre
                there = ~np.isnan(x)
                filled, mask = np.where(there, x, 0.0), there.astype(float)
                sums += (mask.T @ mask, filled.T @ mask, (filled**2).T @ mask, filled.T @ filled)
                # least and largest x of column i over the rows where column j is present
                low, high = np.where(there, x, np.inf).min(axis=0), np.where(there, x, -np.inf).max(axis=0)
                full = there.all(axis=0)
                least[:, full] = np.minimum(least[:, full], low[:, None])
                most[:, full] = np.maximum(most[:, full], high[:, None])
                for j in np.flatnonzero(~full):
                    rows = x[there[:, j]]
                    if len(rows):
                        least[:, j] = np.minimum(least[:, j], np.where(np.isnan(rows), np.inf, rows).min(axis=0))
                        most[:, j] = np.maximum(most[:, j], np.where(np.isnan(rows), -np.inf, rows).max(axis=0))
        i, j = np.triu_indices(d, 1)
        n, x, xx, xy = sums
        values = [n[i, j], x[i, j], x[j, i], xx[i, j], xx[j, i], xy[i, j], least[i, j], most[i, j], least[j, i], most[j, i]]
        names = ["i", "j", "n", "x", "y", "xx", "yy", "xy", "xlo", "xhi", "ylo", "yhi"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(v) for v in values]], names=names
        )

    return run


def correlated_features(
    df: DataFrame, features: list[str] | None = None, threshold: float = 0.95
) -> DataFrame:
    """``(feature)``: those with \\|r\\| above the threshold to any earlier feature."""
    pairs = correlation_matrix(training_rows(df), features)
    return (
        pairs.filter(F.abs("r") > threshold)
        .groupBy(F.col("feature_j").alias("feature"))
        .agg(F.min("j").alias("j"))
        .orderBy("j")
        .select("feature")
    )


def correlation_filter(
    df: DataFrame, features: list[str] | None = None, threshold: float = 0.95
) -> tuple[DataFrame, list[str]]:
    dropped = [r["feature"] for r in correlated_features(df, features, threshold).collect()]
    return df.drop(*dropped), dropped


# -- mutual information ------------------------------------------------------------------------


def _cells(df: DataFrame, features: list[str], target: str, value=None) -> DataFrame:
    """``(feature, y, v)`` with one row per present cell."""
    value = value or (lambda c: F.col(c).cast("double"))
    cells = F.array(
        *[F.struct(F.lit(c).alias("f"), value(c).alias("v")) for c in features]
    )
    return (
        df.select(F.col(target).alias("y"), F.explode(cells).alias("x"))
        .select(F.col("x.f").alias("feature"), "y", F.col("x.v").alias("v"))
        .filter(F.col("v").isNotNull() & F.col("y").isNotNull())
    )


def mutual_info_binned(
    df: DataFrame, features: list[str], target: str, bins: int = 10, mode: str = "exact"
) -> DataFrame:
    """``(feature, mi_score)`` in nats from equal-frequency bins of every feature.

    Rows are counted by (feature, bin, class) on the map side; everything after that works on
    ``features * bins * classes`` rows.
    """
    train = training_rows(df)
    probs = [i / bins for i in range(1, bins)]
    edges = {c: sorted(set(q or [])) for c, q in quantiles(train, features, probs, mode).items()}

    def bin_of(c: str) -> Column:
        value = F.col(c).cast("double")
        above = sum(((value > F.lit(e)).cast("int") for e in edges[c]), F.lit(0))
        return F.when(value.isNotNull(), above)

    joint = _cells(train, features, target, bin_of).groupBy("feature", "v", "y").count()
    feature, of_bin, of_class = (
        Window.partitionBy("feature"),
        Window.partitionBy("feature", "v"),
        Window.partitionBy("feature", "y"),
    )
    n = F.col("count").cast("double")
    parts = joint.select(
        "feature", n.alias("n"), F.sum(n).over(feature).alias("t"),
        F.sum(n).over(of_bin).alias("b"), F.sum(n).over(of_class).alias("c"),
    )
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("b") * F.col("c")))
    return parts.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi_score"))


def _digamma(n: Column) -> Column:
    """Digamma of a positive integer.

    Up to 10 as a finite harmonic sum, else by its asymptotic series (error under 1e-12).
    """
    euler = 0.5772156649015329  # fixed value: the Euler-Mascheroni constant
    sums = [-euler]
    for i in range(1, 10):
        sums.append(sums[-1] + 1.0 / i)
    x = n.cast("double")
    series = (
        F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
        + 1 / (240 * x**8) - 1 / (132 * x**10)
    )
    small = F.element_at(
        F.array(*[F.lit(s) for s in sums]), F.least(n, F.lit(10)).cast("int")
    )
    return F.when(n <= 10, small).otherwise(series)


def mutual_info_knn(
    df: DataFrame, features: list[str], target: str, neighbours: int = 3, seed: int = 42,
    key: str = "row_id", noise: float = 1e-10,
) -> DataFrame:
    """``(feature, mi_score)`` by the nearest-neighbour estimator for a continuous feature and
    a discrete class (Ross 2014).

    Values are scaled by their deviation and given a tiny seeded noise, so ties break and all
    values differ. Distances to the k-th neighbour of the same class come from ``lag`` and
    ``lead`` inside value buckets that overlap by k rows; the number of rows of any class
    within that distance from running counts. No class or feature runs in a single task.
    """
    train = training_rows(df)
    stats = train.agg(
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)],
        *[F.avg(F.abs(F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(features)],
    ).first()

    def jittered(c: str) -> Column:
        i = features.index(c)
        spread = stats[f"s{i}"] or 1.0
        size = noise * max(1.0, (stats[f"m{i}"] or 0.0) / spread)
        # two uniform draws summed: a bounded bell around 0
        digest = row_hash(F.col(key), c, seed)
        draw = unit_interval(digest, 1) + unit_interval(digest, 14) - 1
        return F.col(c).cast("double") / F.lit(spread) + draw * F.lit(size)

    cells = _cells(train, features, target, jittered)
    # a class with a single row has no neighbour and does not count; sizes do not need the noise
    sizes = _cells(train, features, target).groupBy("feature", "y").agg(F.count(F.lit(1)).alias("n_y"))
    sizes = sizes.filter(F.col("n_y") > 1)
    rows = train.count() * len(features)
    within = _rows_within(_reach(cells.join(sizes, ["feature", "y"]), neighbours, rows), rows)
    scores = within.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_digamma(F.least(F.lit(neighbours), F.col("n_y") - 1))).alias("of_k"),
        F.avg(_digamma(F.col("n_y"))).alias("of_class"),
        F.avg(_digamma(F.col("m"))).alias("of_m"),
    )
    score = _digamma(F.col("n")) + F.col("of_k") - F.col("of_class") - F.col("of_m")
    return scores.select("feature", F.greatest(score, F.lit(0.0)).alias("mi_score"))


def _reach(cells: DataFrame, k: int, rows: int, block: int = 100_000) -> DataFrame:
    """Open interval of every value up to its k-th nearest value of the same class.

    Values are ranked within (feature, class) and cut into blocks of equal rank ranges; the k
    ranks next to a block edge are copied over it, so every window has what it needs.
    """
    ranked = running_totals(
        cells.withColumn("one", F.lit(1)), ["feature", "y"], "v", {"one": "rank"}, rows
    )
    home = F.floor(F.col("rank") / block)
    copies = F.array_distinct(
        F.array(
            home,
            F.floor(F.greatest(F.col("rank") - k, F.lit(0)) / block),
            F.floor((F.col("rank") + k) / block),
        )
    )
    spread = ranked.withColumn("_home", home).withColumn("_block", F.explode(copies))
    order = Window.partitionBy("feature", "y", "_block").orderBy("rank")
    v = F.col("v")
    others = [f("v", i).over(order) for i in range(1, k + 1) for f in (F.lag, F.lead)]
    near = F.array_sort(
        F.filter(
            F.array(*[F.struct(F.abs(o - v).alias("d"), o.alias("at")) for o in others]),
            lambda x: x["d"].isNotNull(),
        )
    )
    kth = F.element_at(near, F.least(F.lit(k), F.size(near)))
    own = spread.withColumn("_kth", kth).filter(F.col("_home") == F.col("_block"))
    at, d = F.col("_kth.at"), F.col("_kth.d")
    return own.select(
        "feature", "y", "n_y", "rank", "v",
        F.when(at < v, at).otherwise(v - d).alias("low"),
        F.when(at > v, at).otherwise(v + d).alias("high"),
    )


def _rows_within(reach: DataFrame, rows: int) -> DataFrame:
    """Add ``m``, the rows of any class strictly inside ``(low, high)``, by running counts.

    Both ends of every interval are sorted in among the values, as points of weight 0: from the top, the count
    at the lower end is that of the values above it, at the upper end that of the values not below it.
    """
    reach = stage(reach, "mi-reach")  # ranks name the rows: they have to stay what they are
    points = F.array(*[
        F.struct(F.col(at).alias("at"), F.lit(w).alias("w"), F.lit(turn).alias("turn"))
        for at, w, turn in (("low", 0, 0), ("v", 1, 1), ("high", 0, 2))
    ])
    row = ["feature", "y", "n_y", "rank"]
    counted = running_totals(
        reach.select(*row, F.explode(points).alias("e")).select(*row, "e.*"),
        ["feature"], "at", {"w": "from_top"}, 3 * rows, then=["turn"],
    )
    inside = F.sum(F.when(F.col("turn") == 0, F.col("from_top")).otherwise(-F.col("from_top")))
    return counted.filter("turn != 1").groupBy(*row).agg(inside.alias("m"))


def mutual_info_ranking(
    df: DataFrame, features: list[str], target: str, top_k: int | None = None,
    method: str = "binned", **options,
) -> DataFrame:
    """Features by descending mutual information with the class, optionally the first few."""
    if method not in ("binned", "knn"):
        raise ValueError(f"unknown method {method!r}; use binned or knn")
    estimate = mutual_info_binned if method == "binned" else mutual_info_knn
    ranked = estimate(df, features, target, **options).orderBy(F.desc("mi_score"), "feature")
    return ranked if top_k is None else ranked.limit(top_k)
