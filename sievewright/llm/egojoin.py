"""Near-duplicate vectors: epsilon grid order join on leading principal dimensions.

Unit vectors with a cosine of at least c lie within eps = sqrt(2 - 2c) of each other. Vectors of a label are
sorted by their grid cells (width eps) along the leading principal dimensions, lexicographically, and the
sequence is cut into blocks. Only blocks whose boxes come within eps meet; inside such a pair, intervals are
halved recursively and halves that are provably apart are skipped. Leaves compare in double precision.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.components import components
from sievewright.llm.numbering import number_rows
from sievewright.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 6
BLOCK = 1024
LEAF = 128


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as doubles; NULL for what links with nothing."""
    for batch in batches:
        digests, sizes, units = [], [], []
        for vector in batch.column(2):
            values = vector.as_py()
            unit = None
            if values and None not in values:
                v = np.array(values, np.float64)
                if np.isfinite(v).all() and (v != 0).any():
                    v = v / np.abs(v).max()  # no overflow in the squares
                    unit = v / np.sqrt(v @ v)
            raw = None if unit is None else (unit + 0.0).tobytes()
            units.append(raw)
            digests.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
            sizes.append(0 if unit is None else len(unit))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()),
             pa.array(units, pa.binary())],
            names=["id", "label", "dim", "digest", "unit"],
        )


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and dimension: the sums of the vectors and of their products, one row per sum."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for d in np.unique(dims):
            x = np.frombuffer(b"".join(batch.column(1).filter(pa.array(dims == d)).to_pylist())).reshape(-1, d)
            part = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
            sums[d] = sums.get(d, 0) + part
    for d, s in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array(s)], names=["dim", "at", "s"]
        )


def principal_axes(units: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal axes by vector size. The driver gets size² sums, whatever the number of rows."""
    sums = units.select("dim", "unit").mapInArrow(_moments, "dim int, at int, s double").groupBy("dim", "at").agg(
        F.sum("s").alias("s")
    ).toPandas()
    axes = {}
    for d, part in sums.groupby("dim"):
        s = part.sort_values("at")["s"].to_numpy()
        mean = s[1 : d + 1] / s[0]
        spread = s[d + 1 :].reshape(d, d) / s[0] - np.outer(mean, mean)
        axes[int(d)] = np.linalg.eigh(spread)[1][:, ::-1][:, :DIMENSIONS]
    return axes


def _box_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Least distance of two intervals in the leading dimensions."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(np.sqrt(gap @ gap))


class _Forest:
    """A spanning forest over the rows of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _leaf(a: np.ndarray, b: np.ndarray, mask: np.ndarray, forest: _Forest) -> None:
    """Join the rows that a block of links connects: labels spread until they are stable."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    mask = mask[np.ix_(rows, cols)]
    left, right = a[rows].copy(), np.full(len(cols), np.iinfo(np.int64).max)
    while True:
        right = np.minimum(right, np.where(mask, left[:, None], np.iinfo(np.int64).max).min(axis=0))
        new = np.minimum(left, np.where(mask, right[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == left).all():
            break
        left = new
    for node, root in zip([*a[rows], *b[cols]], [*left, *right], strict=True):
        if node != root:
            forest.link(int(node), int(root))


def _join(a, b, places, units, weights, cosine, eps, links, forest) -> None:
    """Links between two intervals of the sequence (index arrays), or within one."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        same = a is b
        if not same and _box_distance(places[a], places[b]) > eps:
            continue
        if len(a) <= LEAF and len(b) <= LEAF:
            mask = units[a] @ units[b].T >= cosine
            if same:
                np.fill_diagonal(mask, False)
            if mask.any():
                links[a] += mask @ weights[b]
                if not same:
                    links[b] += weights[a] @ mask
                _leaf(a, b, mask, forest)
        elif same:
            low, high = a[: len(a) // 2], a[len(a) // 2 :]
            stack += [(low, low), (low, high), (high, high)]
        elif len(a) >= len(b):
            stack += [(a[: len(a) // 2], b), (a[len(a) // 2 :], b)]
        else:
            stack += [(a, b[: len(b) // 2]), (a, b[len(b) // 2 :])]


def _pair_joiner(cosine: float, eps: float):
    def join_pair(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row").reset_index(drop=True)
        units = np.frombuffer(b"".join(group["unit"])).reshape(len(group), -1)
        places = np.stack(group["place"].to_numpy())
        weights = group["copies"].to_numpy(np.int64)
        links, forest = np.zeros(len(group), np.int64), _Forest(len(group))
        blocks = group["block"].to_numpy()
        first = np.flatnonzero(blocks == key[1])
        second = first if key[1] == key[2] else np.flatnonzero(blocks == key[2])
        _join(first, second, places, units, weights, cosine, eps, links, forest)
        ids = group["id"].to_numpy()
        linked = np.flatnonzero(links)
        roots = [forest.root(int(i)) for i in linked]
        return pd.DataFrame({"id": ids[linked], "links": links[linked], "root": ids[roots]})

    return join_pair


def similar_vectors(
    df: DataFrame, cosine: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Rows are compared if labels are equal and not NULL and vectors have one length. A vector that is NULL, empty, zero or
    holds NULL or non-finite numbers links with nothing, and so does a row without a key (its component is NULL,
    it is kept). Equal vectors are one class: they count as links of each other without being
    compared. Rows of one key with different vectors are one node: links and component are those of all its
    vectors. ``kept`` marks the smallest key.
    """
    spark = df.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    plain = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    rows = stage(plain.mapInArrow(_units, "id long, label string, dim int, digest binary, unit binary"), "units")
    able = F.col("unit").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    classes = rows.filter(able).groupBy("label", "digest").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("unit").alias("unit")
    )
    axes = principal_axes(rows.filter(able))

    @F.pandas_udf("array<double>")
    def project(units: pd.Series, dims: pd.Series) -> pd.Series:
        out = [np.zeros(DIMENSIONS)] * len(units)
        for i, (u, d) in enumerate(zip(units, dims, strict=True)):
            p = np.frombuffer(u) @ axes[d]
            out[i] = np.pad(p, (0, DIMENSIONS - len(p)))
        return pd.Series(out)

    placed = classes.withColumn("place", project("unit", "dim"))
    cells = [F.floor(F.col("place")[i] / eps) for i in range(DIMENSIONS)]
    order = [F.col("label"), F.col("dim"), *cells, F.col("id")]
    numbered = number_rows(placed, order, "row").withColumn("block", F.expr(f"row div {BLOCK}"))
    lows = [F.min(F.col("place")[i]).alias(f"lo{i}") for i in range(DIMENSIONS)]
    highs = [F.max(F.col("place")[i]).alias(f"hi{i}") for i in range(DIMENSIONS)]
    boxes = stage(numbered.groupBy("label", "dim", "block").agg(*lows, *highs), "boxes")

    # blocks near each other along the first dimension share a cell of width eps
    names = ["block", *[f"{s}{i}" for s in ("lo", "hi") for i in range(DIMENSIONS)]]
    low, high = F.floor(F.col("lo0") / eps), F.floor(F.col("hi0") / eps)
    one = boxes.select("label", "dim", F.explode(F.sequence(low, high)).alias("cell"), *[F.col(c).alias(f"a_{c}") for c in names])
    two = boxes.select(
        "label", "dim", F.explode(F.sequence(low - 1, high + 1)).alias("cell"), *[F.col(c).alias(f"b_{c}") for c in names]
    )
    gaps = [
        F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"))
        for i in range(DIMENSIONS)
    ]
    near = one.join(two, ["label", "dim", "cell"]).filter("a_block <= b_block").filter(
        F.sqrt(sum(g * g for g in gaps)) <= eps
    )
    pairs = near.select("label", "dim", F.col("a_block").alias("i"), F.col("b_block").alias("j")).distinct()
    sent = pairs.select(
        "*", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("block")
    )
    group = numbered.join(sent, ["label", "dim", "block"]).withColumn("kind", F.concat_ws("|", "dim", "label"))
    links = stage(
        group.select("kind", "i", "j", "block", "row", "id", "copies", "unit", "place")
        .groupBy("kind", "i", "j").applyInPandas(_pair_joiner(cosine, eps), "id long, links long, root long"),
        "links",
    )
    found = components(links.select("id", "root"))
    counts = links.groupBy("id").agg(F.sum("links").alias("others"))
    known = classes.select("label", "digest", F.col("id").alias("owner"), "copies")
    ends = (
        rows.join(known, ["label", "digest"], "left")
        .join(counts.withColumnRenamed("id", "owner"), "owner", "left")
        .join(found.withColumnRenamed("node", "owner"), "owner", "left")
    )
    linked = F.when(F.col("id").isNotNull() & F.col("owner").isNotNull(), F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "owner", "id"))
    return ends.select(
        F.col("id").alias(key), F.coalesce(linked, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
