"""Exact k nearest neighbours by two-level pivots and a bound for every row.

Base rows go to cells around √n pivots, in two levels of about n^(1/4). Cells lie in blocks of a few thousand rows: small cells
share one, a crowded cell takes several. A query meets the block of its own cell first; the k-th distance found there is
its bound. Triangle inequalities then leave only the cells whose ring around their pivot, and around the pivot of the upper
level, comes within the bound (Lu et al. 2012), and the query is sent to the blocks of those. Only queries are copied; base
rows are shuffled into their blocks, and once more to stand before the queries sent there. A task holds one block and streams its
queries past it, however many they are. Every meeting is one small matrix product that returns at most k candidates per query; a
per-row top-k merges them.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.hashing import row_hash, unit_interval
from sievewright.functions.ranks import by_literal
from sievewright.session import stage

# ship the task functions below with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 4096
#: Queries routed, queries that meet a block, and pairs whose distance is taken, at a time.
ROUTED_ROWS, MEETING_ROWS, PAIRS = 512, 256, 65536
#: Groups are looked up by literals; more of them are an error.
MOST_GROUPS = 5000
#: Rounding of distances, relative.
SLACK = 1e-9


def vector_of(features: list[str]):
    """Feature columns as one array column; one parsed text, however many features."""
    return F.expr(f"array({', '.join(f'cast(`{c}` as double)' for c in features)})")


@dataclass
class Pivots:
    """Pivots of one group: ``upper`` of the first level and, for each, the numbers of its ``cells`` and their pivots.

    ``rings``: least and largest distance of a cell's base rows to its pivot; ``upper_rings`` the same to the upper pivot, over all
    rows below it. ``blocks``: first block and number of blocks of every cell.
    """

    upper: np.ndarray
    cells: list[list[int]]
    lower: list[np.ndarray]
    rings: dict[int, tuple[float, float]] | None = None
    upper_rings: list[tuple[float, float]] | None = None
    blocks: dict[int, tuple[int, int]] | None = None


def _by_group(batch: pa.RecordBatch, pivots: dict[str, Pivots]):
    """(pivots, rows, vectors) for every group of a batch."""
    for g, at in _places(batch["grp"]):
        vectors = batch["vec"].take(pa.array(at))
        yield pivots[g], at, vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def _places(values: pa.Array):
    """Every distinct value with its rows."""
    coded = pc.dictionary_encode(values)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return [(g, np.flatnonzero(codes == i)) for i, g in enumerate(coded.dictionary.to_pylist())]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows by pivots, by differences: the product form loses digits near 0."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


@dataclass
class Index:
    """Base rows in their blocks, cached in that partitioning, and the pivots of every group."""

    rows: DataFrame
    pivots: dict[str, Pivots]

    def close(self) -> None:
        self.rows.unpersist()


def _shown(df: DataFrame, key: str, vector: str, group: str | None, carry: str | None) -> DataFrame:
    g = F.col(group).cast("string") if group else F.lit("")
    tag = F.col(carry) if carry else F.lit(None).cast("int")
    return df.select(F.col(key).alias("id"), tag.alias("tag"), g.alias("grp"), F.col(vector).cast("array<double>").alias("vec"))


def nearest_neighbours(
    queries: DataFrame, base: DataFrame, k: int, key: str = "row_id", vector: str = "features",
    group: str | None = None, carry: str | None = None, pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k rows of ``base`` nearest to every query: ``(key, rank, nn_id, distance)``.

    Euclidean distance, ties by key, never the row itself. With ``group`` only rows of the
    same group are neighbours. Fewer rows come back where a group has fewer. ``carry`` names a
    column to bring along from both rows, as ``<carry>`` and ``nn_<carry>``: joining it on
    afterwards would meet a hot key wherever many copies share their nearest row. ``pivots`` per group
    default to the square root of its rows.
    """
    s = _shown(base, key, vector, group, carry)
    q = s if queries is base else _shown(queries, key, vector, group, carry)
    index = build_index(s, pivots, block_rows)
    if index is None:
        empty = q.select("id", "tag", F.col("id").alias("nn_id"), F.col("tag").alias("nn_tag"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
        return _named(empty.limit(0), key, carry)
    own = stage(own_block(index, None if q is s else q, k), "neighbour-own")
    rest = _meet(index, routed(index, q, own, k), k)
    candidates = stage(own.select(*CANDIDATE).unionByName(rest.select(*CANDIDATE)), "neighbours")
    index.close()
    order = Window.partitionBy("id").orderBy("distance", "nn_id")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return _named(ranked, key, carry)


CANDIDATE = ["id", "tag", "nn_id", "nn_tag", "distance"]


def _named(found: DataFrame, key: str, carry: str | None) -> DataFrame:
    tags = [F.col("tag").alias(carry), F.col("nn_tag").alias(f"nn_{carry}")] if carry else []
    return found.select(F.col("id").alias(key), *tags, "rank", "nn_id", "distance")


def build_index(s: DataFrame, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> Index | None:
    """Cells and blocks of base rows (`_shown`); None without rows. The driver holds √n pivots and their rings."""
    sizes = {r["grp"]: r["count"] for r in s.groupBy("grp").count().limit(MOST_GROUPS + 1).collect()}
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    if not sizes:
        return None
    found = _choose_pivots(s, sizes, pivots)
    placed = stage(_assign(s, found), "neighbour-base")
    rows = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far"),
        F.min("upper").alias("upper_near"), F.max("upper").alias("upper_far"),
    ).collect()  # one row per pivot
    of_cell = {r["cell"]: r for r in rows}
    block, room = -1, 0
    for p in found.values():
        p.rings, p.blocks, p.upper_rings = {}, {}, []
        room = 0  # rows of two groups share no block
        for cells in p.cells:
            used = [of_cell[c] for c in cells if c in of_cell]
            p.upper_rings.append((min((r["upper_near"] for r in used), default=math.inf), max((r["upper_far"] for r in used), default=-math.inf)))
            for r in used:
                p.rings[r["cell"]] = (r["near"], r["far"])
                count = math.ceil(r["n"] / block_rows)
                if count > 1:
                    p.blocks[r["cell"]] = (block + 1, count)
                    block, room = block + count, 0
                else:
                    if r["n"] > room:
                        block, room = block + 1, block_rows
                    p.blocks[r["cell"]] = (block, 1)
                    room -= r["n"]
    blocked = placed.mapInArrow(_block_of(found), f"{_fields(placed)}, block int").drop("upper", "radius", "cell")
    # as many partitions as a shuffle has: what is grouped by block later stays where it is
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocked.repartition(parts, "block").persist(StorageLevel.DISK_ONLY)
    rows.count()  # the partitioning of a cached table is known once it is there
    return Index(rows, found)


def _with(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *columns])


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _choose_pivots(s: DataFrame, sizes: dict[str, int], pivots: int | None) -> dict[str, Pivots]:
    """Rows drawn by hash, about the square root of each group's number, or the origin where none was drawn."""
    wish = {g: pivots or math.ceil(math.sqrt(n)) for g, n in sizes.items()}
    share = by_literal(F.col("grp"), {g: w / sizes[g] for g, w in wish.items()})
    digest = row_hash(F.col("id"), "pivot")
    drawn: dict[str, list] = {}
    for r in s.filter(unit_interval(digest, 1) < share).select("grp", "vec", digest.alias("h")).orderBy("h").collect():
        drawn.setdefault(r["grp"], []).append(r["vec"])
    result, cell = {}, 0
    for g in sorted(sizes):
        vectors = np.unique(np.asarray(drawn.get(g, [[0.0]]), dtype=float), axis=0)
        first = math.ceil(math.sqrt(len(vectors)))
        upper = vectors[np.unique(np.linspace(0, len(vectors) - 1, first).astype(int))]
        at = _distances(vectors, upper).argmin(axis=1)
        lower = [vectors[at == i] for i in range(len(upper))]
        cells = []
        for part in lower:
            cells.append(list(range(cell, cell + len(part))))
            cell += len(part)
        result[g] = Pivots(upper, cells, lower)
    return result


def _assign(rows: DataFrame, pivots: dict[str, Pivots]) -> DataFrame:
    """Add the cell of the nearest pivot below the nearest upper one, and the distances to both."""

    def nearest(batches):
        for batch in batches:
            cell, radius, upper = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for p, at, x in _by_group(batch, pivots):
                above = _distances(x, p.upper)
                first = above.argmin(axis=1)
                upper[at] = above.min(axis=1)
                for i in np.unique(first):
                    own = np.flatnonzero(first == i)
                    d = _distances(x[own], p.lower[i])
                    cell[at[own]] = np.asarray(p.cells[i])[d.argmin(axis=1)]
                    radius[at[own]] = d.min(axis=1)
            yield _with(batch, cell=cell, radius=radius, upper=upper)

    known = rows.filter(F.col("grp").isin(list(pivots)))
    return known.mapInArrow(nearest, f"{_fields(rows)}, cell int, radius double, upper double")


def _block_of(pivots: dict[str, Pivots]):
    """Add the block of each row's cell; rows of a crowded cell are dealt over its blocks by their key."""

    def blocks(batches):
        of_cell = {c: b for p in pivots.values() for c, b in p.blocks.items()}
        for batch in batches:
            first, count = np.array([of_cell.get(c, (-1, 1)) for c in batch["cell"].to_pylist()], np.int32).reshape(-1, 2).T
            dealt = pd.util.hash_array(batch["id"].to_numpy(zero_copy_only=False), categorize=False) % count.astype(np.uint64)
            yield _with(batch, block=first + dealt.astype(np.int32))

    return blocks


def own_block(index: Index, q: DataFrame | None, k: int) -> DataFrame:
    """Candidates of every query from a block of its own cell, none where it holds no base row. None: the base rows are the queries."""
    if q is None:  # each block is complete in its partition
        return index.rows.select("block", "id", "tag", "vec").sortWithinPartitions("block").mapInArrow(_own_candidates(k), _candidate_fields(index))
    placed = _assign(q, index.pivots)
    own = placed.mapInArrow(_block_of(index.pivots), f"{_fields(placed)}, block int").filter("block >= 0")
    return _meet(index, own.select("id", "tag", "vec", F.lit(math.inf).alias("bound"), "block"), k)


def routed(index: Index, q: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """Queries with the blocks that may hold rows within their bound, but for the block they have met."""
    bounds = own.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), F.first("met").alias("met"))
    bound = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(math.inf))
    known = bounds.select(F.col("id").alias("of"), bound.alias("bound"), "met")
    open_ = q.filter(F.col("grp").isin(list(index.pivots))).join(known, F.col("id") == F.col("of"), "left").select(
        "id", "tag", "grp", "vec", F.coalesce("bound", F.lit(math.inf)).alias("bound"), F.coalesce("met", F.lit(-1)).alias("met")
    )
    sent = open_.mapInArrow(_router(index.pivots), f"{_fields(open_)}, blocks array<int>")
    return sent.select("id", "tag", "vec", "bound", F.explode("blocks").alias("block"))


def _router(pivots: dict[str, Pivots]):
    def route(batches):
        # a query may meet every block: the lists are made for a part of the batch at a time
        for batch in (b.slice(i, ROUTED_ROWS) for b in batches for i in range(0, b.num_rows, ROUTED_ROWS)):
            bound, met = batch["bound"].to_numpy(), batch["met"].to_numpy()
            found: list[set] = [set() for _ in range(batch.num_rows)]
            for p, at, x in _by_group(batch, pivots):
                above = _distances(x, p.upper)
                for i, (near, far) in enumerate(p.upper_rings):
                    some = np.flatnonzero(_reaches(above[:, i], bound[at], near, far))
                    if not len(some):
                        continue
                    below = _distances(x[some], p.lower[i])
                    for j, c in enumerate(p.cells[i]):
                        if c in p.rings:
                            first, count = p.blocks[c]
                            for r in some[_reaches(below[:, j], bound[at[some]], *p.rings[c])]:
                                found[at[r]].update(range(first, first + count))
            blocks = [sorted(b - {m}) for b, m in zip(found, met.tolist(), strict=True)]
            yield _with(batch, blocks=pa.array(blocks, pa.list_(pa.int32())))

    return route


def _reaches(distance: np.ndarray, bound: np.ndarray, near: float, far: float) -> np.ndarray:
    """Whether a ring around a pivot comes within the bound of a query at this distance of the pivot."""
    margin = bound * (1 + SLACK) + SLACK * (1 + distance)
    return (distance - margin <= far) & (distance + margin >= near)


def _candidate_fields(index: Index) -> str:
    id_type, tag_type = (index.rows.schema[c].dataType.simpleString() for c in ("id", "tag"))
    return f"id {id_type}, tag {tag_type}, nn_id {id_type}, nn_tag {tag_type}, distance double, met int"


def _meet(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """Queries (id, tag, vec, bound, block) against the base rows of their block, up to their bound.

    Of a block, the base rows come first, then its queries, which are never held together.
    """
    base = index.rows.select("block", F.lit(False).alias("asks"), "id", "tag", "vec", F.lit(math.inf).alias("bound"))
    asked = queries.select("block", F.lit(True).alias("asks"), "id", "tag", "vec", "bound")
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = base.unionByName(asked).repartition(parts, "block").sortWithinPartitions("block", "asks")
    return together.mapInArrow(_block_candidates(k), _candidate_fields(index))


def _sortable(ids: pa.Array) -> np.ndarray:
    values = ids.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pair_distances(x: np.ndarray, y: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distances of pairs (row of x, row of y); among copies every pair of a meeting is one."""
    found = np.empty(len(rows))
    for i in range(0, len(rows), PAIRS):
        part = slice(i, i + PAIRS)
        found[part] = np.sqrt(((y[at[part]] - x[rows[part]]) ** 2).sum(axis=1))
    return found


def _runs(batches, *columns: str):
    """Slices of the batches with equal values in the leading columns, and these values."""
    for batch in batches:
        values = [batch[c].to_numpy(zero_copy_only=False) for c in columns]
        changes = np.any([v[1:] != v[:-1] for v in values], axis=0) if batch.num_rows else np.empty(0, bool)
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if stop > start:
                yield *(v[start] for v in values), batch.slice(start, stop - start)


class Block:
    """Base rows of one block, from slices of batches."""

    def __init__(self, number: int, slices: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(slices).select(["id", "tag", "vec"]).combine_chunks().to_batches()[0]
        self.number, self.ids, self.tags, self.others = number, rows["id"], rows["tag"], _sortable(rows["id"])
        self.y = _vectors(rows["vec"])
        self.yy = (self.y * self.y).sum(axis=1)

    def nearest(self, queries: pa.RecordBatch, bounds: np.ndarray, k: int):
        """The k nearest rows of the block within its bound for every query, a part of the queries at a time."""
        others, y, yy = self.others, self.y, self.yy
        keep = min(k + 1, len(others))  # one more, in case the row itself is among them
        for start in range(0, queries.num_rows, MEETING_ROWS):
            q, bound = queries.slice(start, MEETING_ROWS), bounds[start : start + MEETING_ROWS]
            part, ids = _vectors(q["vec"]), _sortable(q["id"])
            xx = (part * part).sum(axis=1)
            rough = xx[:, None] + yy[None, :] - 2.0 * (part @ y.T)
            # the product form may be off by rounding: keep what it cannot rule out, and
            # decide by the difference form
            error = 1e-12 * part.shape[1] * (xx[:, None] + yy.max() + 1e-300)
            limit = np.partition(rough, keep - 1, axis=1)[:, keep - 1 : keep] + 2 * error
            rows, at = np.nonzero(rough <= limit)
            distance = _pair_distances(part, y, rows, at)
            rest = (others[at] != ids[rows]) & (distance <= bound[rows])
            rows, at, distance = rows[rest], at[rest], distance[rest]
            order = np.lexsort((others[at], distance, rows))
            rows, at, distance = rows[order], at[order], distance[order]
            # the place of a candidate among those of its row
            best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            if not best.any():
                continue
            mine, theirs = pa.array(rows[best]), pa.array(at[best])
            columns = [q["id"].take(mine), q["tag"].take(mine), self.ids.take(theirs), self.tags.take(theirs),
                       pa.array(distance[best]), pa.array(np.full(best.sum(), self.number, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "tag", "nn_id", "nn_tag", "distance", "met"])


def _block_candidates(k: int):
    """Queries against the base rows before them in the same block; none where it has no base row."""

    def candidates(batches):
        number, slices, block = None, [], None
        for at, asks, rows in _runs(batches, "block", "asks"):
            if at != number:
                number, slices, block = at, [], None
            if not asks:
                slices.append(rows)
            elif slices or block:
                if block is None:
                    block, slices = Block(number, slices), []
                yield from block.nearest(rows, rows["bound"].to_numpy(), k)

    return candidates


def _own_candidates(k: int):
    """The rows of every block against each other."""

    def met(number, slices):
        block = Block(number, slices)
        for rows in slices:
            yield from block.nearest(rows, np.full(rows.num_rows, math.inf), k)

    def candidates(batches):
        number, slices = None, []
        for at, rows in _runs(batches, "block"):
            if at != number and slices:
                yield from met(number, slices)
                slices = []
            number = at
            slices.append(rows)
        if slices:
            yield from met(number, slices)

    return candidates
