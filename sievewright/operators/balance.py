"""Class rebalancing of the training part, class weights and the benign-only set.

Which rows are drawn, copied or mixed is decided by hashes of row keys and draw numbers. New
rows carry a text key ``<class>#<draw>`` in ``row_id`` form so that later steps stay
repeatable; kept rows have their old key as text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.hashing import hash_number, row_hash, unit_interval
from sievewright.functions.ranks import by_literal, hash_ordinals, hash_quota
from sievewright.operators.neighbors import nearest_neighbours, vector_of
from sievewright.operators.split import class_counts
from sievewright.session import small_table, stage

# -- targets ---------------------------------------------------------------------------------


def over_targets(counts: dict, strategy: str | dict | float = "auto") -> dict:
    """Rows to add per class so that the chosen classes reach the majority count."""
    top = max(counts.values())
    largest = min(c for c in counts if counts[c] == top)
    least = min(counts.values())
    smallest = min(c for c in counts if counts[c] == least)
    if isinstance(strategy, dict):
        for c, wanted in strategy.items():
            if wanted < counts.get(c, 0):
                raise ValueError(f"class {c!r} already has more than {wanted} rows")
        return {c: wanted - counts.get(c, 0) for c, wanted in strategy.items() if c in counts}
    if isinstance(strategy, float):
        if len(counts) != 2:
            raise ValueError("a ratio needs exactly two classes")
        return {smallest: max(0, int(top * strategy) - least)}
    chosen = {
        "minority": [smallest],
        "not minority": [c for c in counts if c != smallest],
        "not majority": [c for c in counts if c != largest],
        "all": list(counts),
        "auto": [c for c in counts if c != largest],
    }
    if strategy not in chosen:
        raise ValueError(f"unknown sampling strategy {strategy!r}; use one of {list(chosen)}")
    return {c: top - counts[c] for c in chosen[strategy]}


def under_targets(counts: dict, strategy: str | dict | float = "auto") -> dict:
    """Rows to keep per class so that the chosen classes shrink to the minority count."""
    top, least = max(counts.values()), min(counts.values())
    largest = min(c for c in counts if counts[c] == top)
    smallest = min(c for c in counts if counts[c] == least)
    if isinstance(strategy, dict):
        for c, wanted in strategy.items():
            if wanted > counts.get(c, 0):
                raise ValueError(f"class {c!r} has fewer than {wanted} rows")
        return {**counts, **strategy}
    if isinstance(strategy, float):
        if len(counts) != 2:
            raise ValueError("a ratio needs exactly two classes")
        return {**counts, largest: min(top, int(least / strategy))}
    chosen = {
        "majority": [largest],
        "not minority": [c for c in counts if c != smallest],
        "not majority": [c for c in counts if c != largest],
        "all": list(counts),
        "auto": [c for c in counts if c != smallest],
    }
    if strategy not in chosen:
        raise ValueError(f"unknown sampling strategy {strategy!r}; use one of {list(chosen)}")
    return {**counts, **dict.fromkeys(chosen[strategy], least)}


@dataclass(frozen=True)
class Plan:
    """What an oversampler will do: rows to add per class and the neighbours it may use."""

    add: dict
    neighbours: int
    tiny: tuple = ()


def plan_oversampling(
    counts: dict, strategy: str | dict | float = "auto", min_class_samples: int = 6,
    k_neighbors: int = 5,
) -> Plan:
    """Rows to add per class. Under ``auto``, classes with too few rows to learn from are not grown.

    The neighbour count follows the smallest class of all, such classes included.
    """
    small = {c for c, n in counts.items() if n < min_class_samples}
    spared = small if strategy == "auto" else set()
    wanted = over_targets(counts, strategy)
    # fixed rule: the asked count, at most one less than the smallest class has rows, at least 1
    k = max(1, min(k_neighbors, min(counts.values()) - 1))
    return Plan({c: n for c, n in wanted.items() if n > 0 and c not in spared}, k, tuple(sorted(small)))


# -- drawing ---------------------------------------------------------------------------------


def _draws(df: DataFrame, target: str, add: dict, seed: int) -> DataFrame:
    """One row per wanted draw: class, number and a digest to draw with.

    A range of all draws is cut into classes by literals, so a class that needs most of the
    draws is spread over all tasks like any other.
    """
    total = sum(add.values())
    label, number, start = F.lit(None), F.lit(None), 0
    for c, n in add.items():
        here = (F.col("id") >= start) & (F.col("id") < start + n)
        label = F.when(here, F.lit(c)).otherwise(label)
        number = F.when(here, F.col("id") - start).otherwise(number)
        start += n
    kind = df.schema[target].dataType
    drawn = df.sparkSession.range(total).select(
        label.cast(kind).alias(target), number.cast("bigint").alias("draw")
    )
    return drawn.withColumn("_h", row_hash(F.col(target), F.col("draw"), seed))


def _remainder(digest: Column, sizes: dict, cls: Column) -> Column:
    return F.pmod(hash_number(digest), by_literal(cls, sizes).cast("bigint"))


def _with_text_key(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, F.col(key).cast("string"))


def _new_key(target: str) -> Column:
    return F.concat_ws("#", F.col(target).cast("string"), F.col("draw").cast("string"))


# -- random sampling ---------------------------------------------------------------------------


def random_over(
    df: DataFrame, target: str, strategy: str | dict | float = "auto", seed: int = 42,
    key: str = "row_id",
) -> DataFrame:
    """Add rows drawn with replacement until each chosen class reaches its aim."""
    counts = class_counts(df, target)
    add = {c: n for c, n in over_targets(counts, strategy).items() if n > 0}
    kept = _with_text_key(df, key)
    if not add:
        return kept
    draws = _draws(df, target, add, seed)
    draws = draws.withColumn("ordinal", _remainder(F.col("_h"), counts, F.col(target)))
    classes = df.filter(F.col(target).isin(list(add)))
    numbered = hash_ordinals(classes, target, key, seed, max(counts[c] for c in add))
    copies = draws.join(numbered, [target, "ordinal"]).withColumn(key, _new_key(target))
    return kept.unionByName(copies.select(df.columns))


def random_under(
    df: DataFrame, target: str, strategy: str | dict | float = "auto", seed: int = 42,
    key: str = "row_id",
) -> DataFrame:
    """Keep a random part, without replacement, of every class above its aim."""
    counts = class_counts(df, target)
    keep = under_targets(counts, strategy)
    return df.filter(hash_quota(df, target, key, seed, keep, counts))


# -- synthetic sampling ------------------------------------------------------------------------


def _rows_with_vectors(df: DataFrame, target: str, features: list[str], key: str) -> DataFrame:
    rows = df.select(F.col(key), F.col(target), vector_of(features).alias("vec"))
    return stage(rows, "balance-rows")


def _mix(
    picks: DataFrame, rows: DataFrame, pairs: DataFrame, df: DataFrame, target: str,
    features: list[str], key: str,
) -> DataFrame:
    """Synthetic rows on the line from a base row to its neighbour.

    ``picks`` holds (target, draw, share, key, rank). Other columns of the frame are NULL.
    """
    ends = rows.select(F.col(key).alias("nn_id"), F.col("vec").alias("_to"))
    starts = rows.select(key, F.col("vec").alias("_from"))
    lines = (
        picks.join(pairs.select(key, "rank", "nn_id"), [key, "rank"])
        .join(ends, "nn_id")
        .join(starts, key)
    )
    place = {c: i for i, c in enumerate(features)}
    columns = []
    for f in df.schema.fields:
        if f.name == key:
            text = f"concat_ws('#', cast(`{target}` as string), cast(draw as string))"
        elif f.name == target:
            text = f"`{target}`"
        elif f.name in place:
            i = place[f.name]
            text = f"_from[{i}] + share * (_to[{i}] - _from[{i}])"
        else:
            text = f"cast(null as {f.dataType.simpleString()})"
        columns.append(f"{text} as `{f.name}`")
    return lines.selectExpr(*columns)


def _require_neighbours(counts: dict, plan: Plan) -> None:
    short = [c for c in plan.add if counts[c] <= plan.neighbours]
    if short:
        raise ValueError(f"classes with no more than {plan.neighbours} rows: {short}")


def _features_as_double(df: DataFrame, features: list[str], key: str) -> DataFrame:
    kinds = {**dict.fromkeys(features, "double"), key: "string"}
    return df.selectExpr(
        *[f"cast(`{c}` as {kinds[c]}) as `{c}`" if c in kinds else f"`{c}`" for c in df.columns]
    )


def smote(
    df: DataFrame, target: str, features: list[str], plan: Plan, seed: int = 42,
    key: str = "row_id",
) -> DataFrame:
    """Interpolate between rows and neighbours of their class (Chawla et al. 2002).

    Every draw picks one of the ``rows * k`` (row, neighbour) pairs of its class and a share of
    the way.
    """
    kept = _features_as_double(df, features, key)
    if not plan.add:
        return kept
    counts = class_counts(df, target)
    _require_neighbours(counts, plan)
    rows = _rows_with_vectors(df.filter(F.col(target).isin(list(plan.add))), target, features, key)
    pairs = nearest_neighbours(rows, rows, plan.neighbours, key, "vec", target)
    pairs = stage(pairs, "smote-pairs")
    slots = {c: counts[c] * plan.neighbours for c in plan.add}
    slot = _remainder(F.col("_h"), slots, F.col(target))
    draws = _draws(df, target, plan.add, seed).select(
        target, "draw",
        unit_interval(F.col("_h"), 16).alias("share"),
        F.floor(slot / plan.neighbours).alias("ordinal"),
        (F.pmod(slot, F.lit(plan.neighbours)) + 1).cast("int").alias("rank"),
    )
    numbered = hash_ordinals(
        rows.select(key, target), target, key, seed, max(counts[c] for c in plan.add)
    )
    picks = draws.join(numbered, [target, "ordinal"])
    return kept.unionByName(_mix(picks, rows, pairs, df, target, features, key))


def adasyn(
    df: DataFrame, target: str, features: list[str], plan: Plan, seed: int = 42,
    key: str = "row_id",
) -> DataFrame:
    """Interpolate more where more of the nearest rows belong to other classes (He et al. 2008).

    A row's share of its class's new rows is its share of foreign neighbours, rounded.
    """
    kept = _features_as_double(df, features, key)
    if not plan.add:
        return kept
    _require_neighbours(class_counts(df, target), plan)
    rows = _rows_with_vectors(df, target, features, key)
    growing = stage(rows.filter(F.col(target).isin(list(plan.add))), "adasyn-growing")
    around = nearest_neighbours(growing, rows, plan.neighbours, key, "vec", carry=target)
    foreign = around.groupBy(key, target).agg(
        F.count_if(F.col(f"nn_{target}") != F.col(target)).alias("foreign")
    )
    foreign = stage(foreign, "adasyn-foreign")
    sums = {r[target]: r["s"] for r in
            foreign.groupBy(target).agg(F.sum("foreign").alias("s")).collect()}
    for c in plan.add:
        if not sums.get(c):
            raise ValueError(f"no neighbour of class {c!r} belongs to another class")
    wanted, total = by_literal(F.col(target), plan.add), by_literal(F.col(target), sums)
    share = F.rint(F.col("foreign").cast("double") / total * wanted).cast("bigint")
    made = foreign.groupBy(target).agg(F.sum(share).alias("m")).collect()
    idle = [r[target] for r in made if not r["m"]]
    if idle:
        raise ValueError(f"every share of the new rows rounds to zero for classes {idle}")
    pairs = stage(
        nearest_neighbours(growing, growing, plan.neighbours, key, "vec", target), "adasyn-pairs"
    )
    # one row can make most of the new rows: it is dealt out in portions first
    portions = foreign.withColumn("_m", share).filter(F.col("_m") > 0).select(
        key, target, "_m", F.explode(F.sequence(F.lit(1), F.col("_m"), F.lit(PORTION))).alias("_first")
    ).repartition(key, "_first")
    last = F.least(F.col("_first") + F.lit(PORTION - 1), F.col("_m"))
    numbered = portions.select(key, target, F.explode(F.sequence("_first", last)).alias("_i"))
    digest = row_hash(F.col(key), F.col("_i"), seed)
    picks = numbered.select(
        key, target, F.concat_ws("#", F.col(key).cast("string"), "_i").alias("draw"),
        unit_interval(digest, 16).alias("share"),
        (F.pmod(hash_number(digest), F.lit(plan.neighbours)) + 1).cast("int").alias("rank"),
    )
    return kept.unionByName(_mix(picks, rows, pairs, df, target, features, key))


# -- cleaning by neighbours ----------------------------------------------------------------------


def tomek_links(df: DataFrame, target: str, features: list[str], key: str = "row_id") -> DataFrame:
    """Pairs ``(key, nn_id)`` of different classes that are each other's nearest row.

    Both directions are listed. Mutuality is a count of two per unordered pair.
    """
    rows = _rows_with_vectors(df, target, features, key)
    found = nearest_neighbours(rows, rows, 1, key, "vec", carry=target)
    found = found.filter(F.col(f"nn_{target}") != F.col(target))
    found = stage(found.select(key, "nn_id"), "tomek-nearest")
    back = found.select(F.col("nn_id").alias(key), F.col(key).alias("nn_id"))
    return found.join(back, [key, "nn_id"], "left_semi")


def remove_tomek(df: DataFrame, target: str, features: list[str], key: str = "row_id") -> DataFrame:
    return df.join(tomek_links(df, target, features, key).select(key), key, "left_anti").select(
        df.columns
    )


def disagreeing_rows(
    df: DataFrame, target: str, features: list[str], k: int = 3, key: str = "row_id"
) -> DataFrame:
    """Keys of rows with any of their k nearest rows in another class."""
    rows = _rows_with_vectors(df, target, features, key)
    found = nearest_neighbours(rows, rows, k, key, "vec", carry=target)
    return found.filter(F.col(f"nn_{target}") != F.col(target)).select(key).distinct()


def remove_disagreeing(
    df: DataFrame, target: str, features: list[str], k: int = 3, key: str = "row_id"
) -> DataFrame:
    return df.join(disagreeing_rows(df, target, features, k, key), key, "left_anti").select(
        df.columns
    )


# -- dispatch --------------------------------------------------------------------------------------

#: New rows of one base row that a task makes at a time.
PORTION = 10_000
METHODS = ("smote", "adasyn", "smote_tomek", "smote_enn", "random_over", "random_under")


def resample(
    df: DataFrame, target: str, features: list[str], method: str = "smote",
    min_class_samples: int = 6, k_neighbors: int = 5,
    sampling_strategy: str | dict | float = "auto", seed: int = 42, key: str = "row_id",
) -> DataFrame:
    """Rebalance the training rows; rows of other splits pass unchanged.

    The random methods follow ``sampling_strategy`` as given, the synthetic ones leave out
    classes below ``min_class_samples``.
    """
    name = method.lower().strip()
    if name not in METHODS:
        raise ValueError(f"unknown method {method!r}; use one of {list(METHODS)}")
    if "split" in df.columns:
        train = df.filter(F.col("split") == "train")
        rest = _with_text_key(df.filter(F.col("split") != "train"), key)
        done = resample(
            train.drop("split"), target, features, name, min_class_samples, k_neighbors,
            sampling_strategy, seed, key,
        )
        return done.withColumn("split", F.lit("train")).unionByName(rest).select(df.columns)
    df = _with_text_key(df, key)  # new rows have text keys: the type does not depend on the data
    if name == "random_over":
        return random_over(df, target, sampling_strategy, seed, key)
    if name == "random_under":
        return random_under(df, target, sampling_strategy, seed, key)
    plan = plan_oversampling(
        class_counts(df, target), sampling_strategy, min_class_samples, k_neighbors
    )
    if sampling_strategy == "auto" and plan.tiny and not plan.add:
        return df
    grow = adasyn if name == "adasyn" else smote
    grown = grow(df, target, features, plan, seed, key)
    if name == "smote_tomek":
        return remove_tomek(stage(grown, "smote"), target, features, key)
    if name == "smote_enn":
        return remove_disagreeing(stage(grown, "smote"), target, features, key=key)
    return grown


# -- weights and subsets ---------------------------------------------------------------------------


def class_weights(
    df: DataFrame, target: str, mode: str | dict = "balanced", classes: list | None = None
) -> DataFrame:
    """``(class, weight)``: ``n / (K * n_c)``, or the given weights with 1 for the others."""
    counts = class_counts(df, target)
    if classes is not None:
        absent = [c for c in classes if c not in counts]
        if absent:
            raise ValueError(f"classes without rows: {absent}")
    if isinstance(mode, dict):
        unknown = [c for c in mode if c not in counts]
        if unknown:
            raise ValueError(f"classes without rows: {unknown}")
        weights = {c: float(mode.get(c, 1.0)) for c in counts}
    elif mode == "balanced":
        n = sum(counts.values())
        weights = {c: n / (len(counts) * k) for c, k in counts.items()}
    else:
        raise ValueError(f"unknown weight mode {mode!r}; use balanced or a dict")
    kind = df.schema[target].dataType.simpleString()
    return small_table(
        df.sparkSession, sorted(weights.items()), f"class {kind}, weight double"
    )


def with_weights(df: DataFrame, target: str, weights: DataFrame, name: str = "weight") -> DataFrame:
    """Attach the class weight to every row; a literal lookup, as there are few classes."""
    table = {r["class"]: r["weight"] for r in weights.collect()}
    return df.withColumn(name, F.coalesce(by_literal(F.col(target), table), F.lit(1.0)))


def benign_rows(df: DataFrame, target: str, benign: int | str = 0) -> DataFrame:
    """Training rows of the benign class."""
    rows = df.filter(F.col("split") == "train") if "split" in df.columns else df
    return rows.filter(F.col(target) == F.lit(benign))
