"""Hard negatives by an inverted multi-index.

The dimensions are cut into two halves, each with a codebook of `WORDS` words; the cell of a row is the pair of its
nearest words. Rows are stored in the order of their cells, in blocks. For an anchor, the score with any row of a cell is at
most the sum of two half bounds: inner product with the word plus the anchor's length times the word's radius. A
multi-sequence heap visits the cells of a block by that sum, and stops once no cell left can change a window: the best
rows of the anchor's own label at first, then the score windows that the positives open. All results are exact.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.numbering import number_rows
from sievewright.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 32
#: About this many rows, chosen by the hash of their id, fit the codebooks (at most twice as many).
SAMPLE = 8192
ROUNDS = 10
BLOCK = 8192
ANCHORS = 1024
#: Rows of several cells are scored together up to this number.
BATCH = 256
SCALE = 256

Books = dict[int, tuple[np.ndarray, np.ndarray]]


def _matrix(values: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int32).reshape(len(values), size)


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(axis=1) - 2 * (x @ words.T)).argmin(axis=1)


def codebook(x: np.ndarray) -> np.ndarray:
    """Words of one half by Lloyd's rounds from evenly taken distinct rows; an empty sample gives the origin."""
    starts = np.unique(x, axis=0)
    if not len(starts):
        return np.zeros((1, x.shape[1]))
    words = starts[np.unique(np.linspace(0, len(starts) - 1, WORDS).astype(int))]
    for _ in range(ROUNDS):
        at = _nearest(x, words)
        n = np.bincount(at, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, at, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as whole numbers."""
    for batch in batches:
        lists = batch.column(2)
        flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
        if len(flat) and np.abs(flat).max() >= 2**31:
            raise ValueError(f"a component is beyond {2**31 // SCALE}")
        raw, sizes = flat.astype("<i4").tobytes(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.concatenate([[0], 4 * sizes.astype(np.int64)]))
        vectors = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(vectors, pa.binary()), batch.column(3)],
            names=["id", "label", "size", "vector", "a"],
        )


def _books(rows: DataFrame) -> Books:
    """Codebooks by vector size, of a bounded sample."""
    total = rows.count()
    part = F.xxhash64("id").bitwiseAND(F.lit((1 << 30) - 1)) < int(SAMPLE / max(total, 1) * (1 << 30)) + 1
    sample = rows.filter(part).select("size", "vector").limit(2 * SAMPLE).toPandas()
    books = {}
    for size, group in sample.groupby("size"):
        x = _matrix([bytes(v) for v in group["vector"]], size).astype(float)
        books[int(size)] = (codebook(x[:, : size // 2]), codebook(x[:, size // 2 :]))
    return books


def _words_of(books: Books, size: int) -> tuple[np.ndarray, np.ndarray]:
    return books.get(size) or (np.zeros((1, size // 2)), np.zeros((1, size - size // 2)))


def _placer(books: Books):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            cells = np.zeros((2, batch.num_rows), np.int32)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = _matrix(batch.column(3).take(pa.array(at)).to_pylist(), size).astype(float)
                one, two = _words_of(books, int(size))
                cells[0, at], cells[1, at] = _nearest(x[:, : size // 2], one), _nearest(x[:, size // 2 :], two)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cells)], names=[*batch.schema.names, "i", "j"])

    return place


class Cells:
    """The rows of one block and vector size, in the order of their cells."""

    def __init__(self, rows: pa.Table, size: int, labels: np.ndarray, words: tuple[np.ndarray, np.ndarray]):
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        order = np.lexsort((j, i))
        self.x = _matrix(rows["vector"].to_pylist(), size).astype(np.int64)[order]
        self.ids, self.labels, i, j = rows["id"].to_numpy()[order], labels[order], i[order], j[order]
        firsts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        lasts = np.r_[firsts[1:], len(i)]
        self.words, self.radii, halves = [], [], (self.x[:, : size // 2], self.x[:, size // 2 :])
        codes: list[np.ndarray] = []
        for code, book, half in zip((i, j), words, halves, strict=True):
            used, code = np.unique(code, return_inverse=True)
            radius = np.zeros(len(used))
            np.maximum.at(radius, code, np.sqrt(((half - book[used][code]) ** 2).sum(axis=1)))
            self.words.append(book[used])
            self.radii.append(radius)
            codes.append(code)
        self.span = {
            (int(codes[0][a]), int(codes[1][a])): (int(a), int(b)) for a, b in zip(firsts, lasts, strict=True)
        }
        self.most = int(np.abs(self.x).max(initial=0))
        self.float = self.x.astype(float)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        bound = len(q) * self.most * int(np.abs(q).max(initial=0))
        if bound >= 2**63:
            raise ValueError("scores are beyond 64 bits")
        if bound >= 2**53:
            return self.x[rows] @ q
        return (self.float[rows] @ q.astype(float)).astype(np.int64)

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, float, tuple[int, int]]]:
        """(upper bound, lower bound, row span) of the cells, by falling upper bound."""
        middles, spreads, orders = [], [], []
        half = len(q) // 2
        for part, words, radius in zip((q[:half], q[half:]), self.words, self.radii, strict=True):
            part = part.astype(float)
            middle, length = words @ part, np.sqrt(part @ part)
            # a little more than the radius, for rounding
            spread = length * radius + 1e-9 * (1 + np.abs(middle) + length * radius)
            middles.append(middle)
            spreads.append(spread)
            orders.append(np.argsort(-(middle + spread)))
        ups = [(m + s)[o].tolist() for m, s, o in zip(middles, spreads, orders, strict=True)]
        lows = [(m - s)[o].tolist() for m, s, o in zip(middles, spreads, orders, strict=True)]
        a, b = (o.tolist() for o in orders)
        heap, done = [(-(ups[0][0] + ups[1][0]), 0, 0)], set()
        while heap:
            up, s, t = heapq.heappop(heap)
            done.add((s, t))
            span = self.span.get((a[s], b[t]))
            if span:
                yield -up, lows[0][s] + lows[1][t], span
            if s + 1 < len(a) and (t == 0 or (s + 1, t - 1) in done):
                heapq.heappush(heap, (-(ups[0][s + 1] + ups[1][t]), s + 1, t))
            if t + 1 < len(b) and (s == 0 or (s - 1, t + 1) in done):
                heapq.heappush(heap, (-(ups[0][s] + ups[1][t + 1]), s, t + 1))


class Best:
    """The k best (score, id) with scores of a window."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.low is not None:
            inside = (scores >= self.low) & (scores <= self.high)
            scores, ids = scores[inside], ids[inside]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]

    @property
    def need(self) -> float:
        """No score below this can still come in."""
        if len(self.scores) == self.k:
            return self.scores[-1]
        if self.low is None:
            return -np.inf
        return self.low if self.low <= self.high else np.inf


def fill(cells: Cells, q: np.ndarray, anchor: int, label: int, best: list[Best], same: bool) -> int:
    """Visit cells until all windows are certified; the number of rows scored.

    ``same``: rows of the anchor's label other than the anchor; else rows of other labels.
    """
    ceiling = max((b.high for b in best if b.low is not None), default=None)
    waiting, n, seen = [], 0, 0

    def score() -> None:
        rows = np.concatenate([np.arange(a, b) for a, b in waiting])
        fit = (cells.labels[rows] == label) == same
        if same:
            fit &= cells.ids[rows] != anchor
        rows = rows[fit]
        s = cells.scores(rows, q)
        for b in best:
            b.add(s, cells.ids[rows])

    for up, low, span in cells.visit(q):
        if up < min(b.need for b in best):
            break
        if ceiling is not None and low > ceiling:
            continue  # every row lies above all windows
        waiting.append(span)
        n += span[1] - span[0]
        if n >= BATCH:
            score()
            seen, n, waiting = seen + n, 0, []
    if waiting:
        score()
    return seen + n


def _searcher(books: Books, k: int, low: int, high: int, positives: bool):
    """For an anchor block and a row block: at most k rows for each anchor, or for each of its positives."""
    names = ["anchor", "positive", "positive_score", "other", "score"]

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        labels = pa.chunked_array(left["label"].chunks + right["label"].chunks, pa.string()).combine_chunks()
        codes = pc.dictionary_encode(labels).indices.to_numpy(zero_copy_only=False)
        own, theirs = codes[: left.num_rows], codes[left.num_rows :]
        sizes, theirs_sizes = left["size"].to_numpy(), right["size"].to_numpy()
        for size in np.intersect1d(sizes, theirs_sizes):
            at = np.flatnonzero(theirs_sizes == size)
            cells = Cells(right.take(pa.array(at)), int(size), theirs[at], _words_of(books, int(size)))
            mine = np.flatnonzero(sizes == size)
            for row, label in zip(left.take(pa.array(mine)).to_pylist(), own[mine], strict=True):
                q = np.frombuffer(row["vector"], np.int32).astype(np.int64)
                if positives:
                    best = [Best(k)]
                    targets = [(None, None)]
                else:
                    targets = [(p["id"], p["score"]) for p in row["positives"]]
                    # low * p <= 100 * s <= high * p
                    best = [Best(k, -(-low * p // 100), high * p // 100) for _, p in targets]
                fill(cells, q, row["id"], label, best, positives)
                for (p, s), b in zip(targets, best, strict=True):
                    out += [(row["id"], p, s, i, x) for i, x in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return search


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")


FOUND = "anchor long, positive long, positive_score long, other long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    df: DataFrame, anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says which rows are anchors. Components become whole numbers, floor(256 x); scores are exact inner products.
    Positives of an anchor are its best other rows of the same label; for each, the best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Ties go to the smaller id.
    Rows without an id or label, and those whose vector is NULL or holds NULL or non-finite numbers take no
    part. Rows of one id count once, the smallest by (label, vector). Vectors of different lengths are not compared.
    Components beyond 2^31 / 256 are an error. An empty table gives no rows; other columns are left aside, whatever their names.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    plain = df.select(
        F.col(key).cast("long").alias("id"), label.cast("string").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("a"),
    ).filter("id is not null and label is not null and v is not null").filter(finite)
    once = plain.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"), F.max("a").alias("a"))
    whole = once.select("id", "r.label", "r.v", "a")
    rows = stage(whole.mapInArrow(_whole, "id long, label string, size int, vector binary, a boolean"), "vectors")
    books = _books(rows)
    placed = rows.drop("a").mapInArrow(_placer(books), "id long, label string, size int, vector binary, i int, j int")
    numbered = number_rows(placed, [F.col("size"), F.col("i"), F.col("j"), F.col("id")], "row")
    blocks = -(-numbered.count() // BLOCK)
    asked = number_rows(rows.filter("a").drop("a"), [F.col("id")], "n").withColumn("group", F.expr(f"n div {ANCHORS}")).drop("n")
    groups = -(-asked.count() // ANCHORS)
    if not blocks or not groups:
        return df.sparkSession.createDataFrame([], RESULT)

    # the stated anchors against all rows, in blocks
    index = numbered.select(
        F.expr(f"row div {BLOCK}").alias("block"), F.explode(_numbers(groups)).alias("group"),
        "id", "label", "size", "vector", "i", "j",
    ).groupBy("group", "block")

    def against_all(queries: DataFrame):
        return queries.withColumn("block", F.explode(_numbers(blocks))).groupBy("group", "block")

    found = against_all(asked).cogroup(index).applyInArrow(_searcher(books, positives, low, high, True), FOUND)
    by_anchor = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")
    best = found.withColumn("rank", F.row_number().over(by_anchor)).filter(F.col("rank") <= positives)
    with_positives = best.groupBy("anchor").agg(F.collect_list(F.struct(F.col("other").alias("id"), "score")).alias("positives"))
    asked = stage(asked.join(with_positives, asked["id"] == with_positives["anchor"]).drop("anchor"), "anchors")
    hard = against_all(asked).cogroup(index).applyInArrow(_searcher(books, negatives, low, high, False), FOUND)
    by_positive = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "other")
    return hard.withColumn("rank", F.row_number().over(by_positive)).filter(F.col("rank") <= negatives).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
