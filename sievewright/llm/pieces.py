"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut where no piece of the vocabulary can cross, and distinct segments are encoded once. A batch of
segments is indexed as a suffix array (ordered to the depth of the longest piece); every piece is found by binary
search, its occurrences become edges, and the edges are sorted by position. Relaxing follows the model's rule: of
all edges that join two neighbouring symbols of a segment the one of the best-scored piece, leftmost on ties, is
taken, until none is left. Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANK = "▁"
NONE = np.int32(2**31 - 1)
#: Code points of segments that are indexed together.
BATCH = 1 << 19
#: Code points and rows of texts that are encoded together.
TEXTS, ROWS = 1 << 21, 2048
#: Longer segments are relaxed one by one with a heap.
LONG = 32
CACHE = 2_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their order of preference, and the ids of byte pieces and of the unknown piece."""

    pieces: tuple[str, ...]
    ranks: np.ndarray
    plain: np.ndarray  # ids of ordinary pieces
    bytes_: tuple[int, ...]
    unknown: int


def load(path: str) -> Vocabulary:
    """Read the BPE model at ``path`` (on the driver; tasks get the tables)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = tuple(model.id_to_piece(i) for i in ids)
    plain = np.array([i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))])
    scores = np.array([model.get_score(i) for i in ids])
    ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
    octets = {int(pieces[i][1:-1], 16): i for i in ids if model.is_byte(i)}
    if len(octets) not in (0, 256):
        raise ValueError("byte pieces are not complete")
    if any(BLANK in p.lstrip(BLANK) for p in (pieces[i] for i in plain)):
        raise ValueError("pieces across blanks are not supported")
    return Vocabulary(pieces, ranks, plain, tuple(octets[b] for b in range(256)) if octets else (), model.unk_id())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Encoder:
    """Encodes segments; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        many = [i for i in v.plain if len(v.pieces[i]) > 1]
        self.many = np.array(many)
        self.widths = np.array([len(v.pieces[i]) for i in many], np.int64)
        self.longest = int(self.widths.max(initial=1))
        single = sorted((ord(v.pieces[i]), int(i)) for i in v.plain if len(v.pieces[i]) == 1) or [(-1, -1)]
        self.single_codes, self.single_by_code = np.array(single).T.copy()
        self.found = np.full((len(many), self.longest), -1, np.int64)
        for row, i in enumerate(many):
            self.found[row, : self.widths[row]] = _codes(v.pieces[i])
        joins = "".join(sorted(set("".join(v.pieces[i] for i in many)) - {BLANK}))
        group = f"[{re.escape(joins)}]" if joins else "(?!)"
        other = f"[^{re.escape(joins + BLANK)}]"
        self.cut = re.compile(f"{BLANK}*{group}+|{BLANK}+|{other}", re.DOTALL)
        self.known: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.known.clear()
        self.flat = [np.empty(0, np.int32)]
        self.sizes = np.empty(0, np.int64)

    # -- suffix array and edges ---------------------------------------------------------------------

    def _suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Positions of the text in the order of the next ``longest`` code points."""
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
        depth = 1
        while depth < self.longest:
            later = np.zeros_like(rank)
            later[:-depth] = rank[depth:]
            rank = np.unique(rank * (len(rank) + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
            depth *= 2
        return np.argsort(rank, kind="stable")

    def _ranges(self, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one place of every piece in the suffix order, by binary search."""
        padded = np.concatenate([codes, np.full(self.longest, -2, np.int64)])

        def bound(after: bool) -> np.ndarray:
            low, high = np.zeros(len(self.many), np.int64), np.full(len(self.many), len(order))
            for _ in range(int(len(order)).bit_length()):
                open_ = low < high
                middle = (low + high) // 2
                starts = order[np.minimum(middle, len(order) - 1)]
                below = np.full(len(self.many), after)  # equal so far
                undecided = np.ones(len(self.many), bool)
                for k in range(self.longest):
                    rows = np.flatnonzero(undecided & (self.widths > k) & open_)
                    if not len(rows):
                        break
                    here, wanted = padded[starts[rows] + k], self.found[rows, k]
                    differ = here != wanted
                    below[rows[differ]] = here[differ] < wanted[differ]
                    undecided[rows[differ]] = False
                low = np.where(open_ & below, middle + 1, low)
                high = np.where(open_ & ~below, middle, high)
            return low

        return bound(False), bound(True)

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Rank of the piece that starts at a position and has a length: positions by lengths."""
        order = self._suffixes(codes)
        low, high = self._ranges(codes, order)
        n = high - low
        total = int(n.sum())
        at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        table = np.full((len(codes), self.longest + 1), NONE, np.int32)
        # sorting by position: every edge goes to the row of its start
        table[order[at], np.repeat(self.widths, n)] = np.repeat(self.vocabulary.ranks[self.many], n)
        return table

    # -- relaxing ---------------------------------------------------------------------------------

    def _rank(self, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        width = end - start
        fits = width <= self.longest
        return np.where(fits, table[start, np.where(fits, width, 0)], NONE)

    def _relax_all(self, table: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
        """Symbol starts of segments of one width, all at once: one merge each per round."""
        left = starts[:, None] + np.arange(width + 1)  # symbol k is left[k] … left[k + 1]
        if width == 1:
            return list(left[:, :1])
        ranks = self._rank(table, left[:, :-2], left[:, 2:])
        size = np.full(len(starts), width)
        active = np.arange(len(starts))
        done: list[np.ndarray] = [None] * len(starts)  # type: ignore[list-item]
        while True:
            best = ranks.argmin(axis=1)
            go = ranks[np.arange(len(ranks)), best] != NONE
            for i in np.flatnonzero(~go):
                done[active[i]] = left[i, : size[i]]
            if not go.any():
                return done
            left, ranks, best, active = left[go], ranks[go], best[go], active[go]
            size = size[go] - 1
            rows = np.arange(len(left))
            columns = np.arange(left.shape[1] - 1)
            # symbol best + 1 is taken out of the row
            left = left[rows[:, None], columns + (columns > best[:, None])]
            columns = columns[:-1]
            if len(columns) == 1:
                ranks = np.full((len(left), 1), NONE, np.int32)
                continue
            columns = columns[:-1]
            ranks = ranks[rows[:, None], columns + (columns > best[:, None])]
            for k in (best - 1, best):
                fits = (k >= 0) & (k + 2 <= size)
                r, c = rows[fits], k[fits]
                ranks[r, c] = self._rank(table, left[r, c], left[r, c + 2])
                over = (k >= 0) & ~fits & (k < ranks.shape[1])
                ranks[rows[over], k[over]] = NONE

    def _relax_one(self, table: np.ndarray, start: int, width: int) -> np.ndarray:
        """The same for one long segment, with a heap of edges."""
        after, before = list(range(1, width + 1)), list(range(-1, width - 1))
        alive = [True] * width
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < width and after[j] - i <= self.longest:
                rank = table[start + i, after[j] - i]
                if rank != NONE:
                    heapq.heappush(queue, (int(rank), i, j, after[j]))

        for i in range(width - 1):
            offer(i)
        while queue:
            _, i, j, end = heapq.heappop(queue)
            if not (alive[i] and j < width and alive[j] and after[i] == j and after[j] == end):
                continue
            alive[j] = False
            after[i] = end
            if end < width:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return start + np.flatnonzero(alive)

    def learn(self, segments: list[str]) -> None:
        """Encode segments that are not known yet."""
        at = 0
        while at < len(segments):
            batch, size = [], 0
            while at < len(segments) and (not batch or size + len(segments[at]) < BATCH):
                batch.append(segments[at])
                size += len(segments[at]) + 1
                at += 1
            self._learn(batch)

    def _learn(self, batch: list[str]) -> None:
        v = self.vocabulary
        text = "\0".join(batch)
        codes = _codes(text)
        table = self.edges(codes)
        widths = np.array([len(s) for s in batch])
        starts = np.cumsum(widths + 1) - widths - 1
        symbols: list[np.ndarray] = [None] * len(batch)  # type: ignore[list-item]
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            if width <= LONG:
                found = self._relax_all(table, starts[rows], int(width))
            else:
                found = [self._relax_one(table, int(starts[i]), int(width)) for i in rows]
            for i, s in zip(rows, found, strict=True):
                symbols[i] = s
        counts = np.array([len(s) for s in symbols])
        left = np.concatenate(symbols)
        right = np.empty_like(left)
        right[:-1] = left[1:]
        right[np.cumsum(counts) - 1] = starts + widths
        length = right - left
        joined = length > 1
        ids = self.single_ids(codes[left])
        ids[joined] = self.by_rank[table[left[joined], length[joined]]]
        # pieces of equal rank are told apart by their text (runs of blanks)
        for i in np.flatnonzero(joined & (ids < 0)):
            ids[i] = self.tied[text[left[i] : right[i]]]
        # characters without a piece become bytes
        octets = {
            int(i): [v.bytes_[b] for b in text[left[i]].encode("utf-8", "surrogatepass")] if v.bytes_ else [v.unknown]
            for i in np.flatnonzero(ids < 0)
        }
        sizes = np.ones(len(ids), np.int64)
        for i, found in octets.items():
            sizes[i] = len(found)
        out = np.repeat(ids, sizes).astype(np.int32)
        places = np.cumsum(sizes) - sizes
        for i, found in octets.items():
            out[places[i] : places[i] + len(found)] = found
        self.known.update(zip(batch, range(len(self.sizes), len(self.sizes) + len(batch)), strict=True))
        self.sizes = np.concatenate([self.sizes, np.add.reduceat(sizes, np.cumsum(counts) - counts)])
        self.flat.append(out)

    def single_ids(self, codes: np.ndarray) -> np.ndarray:
        """Ids of one-character pieces; -1 for characters without one."""
        at = np.minimum(np.searchsorted(self.single_codes, codes), len(self.single_codes) - 1)
        return np.where(self.single_codes[at] == codes, self.single_by_code[at], -1)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        if len(self.known) > CACHE or sum(map(len, self.flat)) > 4 * CACHE:
            self.reset()
        cuts = [self.cut.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = set().union(*cuts).difference(self.known)
        if new:
            self.learn(list(new))
        self.flat = [np.concatenate(self.flat)]
        sizes = self.sizes
        offsets = np.cumsum(sizes) - sizes
        get = self.known.__getitem__
        out, counts = [], np.zeros(len(texts), np.int64)
        for row, cut in enumerate(cuts):
            if cut:
                which = np.fromiter(map(get, cut), np.int64, len(cut))
                n = sizes[which]
                ends = np.cumsum(n)
                counts[row] = ends[-1]
                out.append(self.flat[0][np.repeat(offsets[which] - ends + n, n) + np.arange(ends[-1])])
        return np.concatenate(out) if out else np.empty(0, np.int32), counts

    @property
    def by_rank(self) -> np.ndarray:
        """Id of the piece with a rank; -1 for ranks that several pieces share."""
        if not hasattr(self, "_by_rank"):
            ranks = self.vocabulary.ranks[self.many]
            n = np.bincount(ranks, minlength=len(self.vocabulary.pieces) + 1)
            table = np.full(len(n), -1, np.int64)
            table[ranks] = self.many
            table[n > 1] = -1
            self._by_rank = table
            self.tied = {self.vocabulary.pieces[i]: int(i) for i, r in zip(self.many, ranks, strict=True) if n[r] > 1}
        return self._by_rank


class Decoder:
    """Turns ids back into text."""

    def __init__(self, vocabulary: Vocabulary):
        raw = [p.replace(BLANK, " ").encode("utf-8", "surrogatepass") for p in vocabulary.pieces]
        plain = set(vocabulary.plain.tolist())
        raw = [r if i in plain else b"" for i, r in enumerate(raw)]
        for b, i in enumerate(vocabulary.bytes_):
            raw[i] = bytes([b])
        raw[vocabulary.unknown] = " ⁇ ".encode()
        self.raw = pa.array(raw, pa.large_binary())

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the blank put before a text at encoding goes; broken bytes become U+FFFD."""
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_lists(self, lists: pa.ListArray) -> list[str]:
        """The text of each list: the bytes of all ids are gathered at once and cut at the ends of the lists (NULL: empty)."""
        taken = self.raw.take(lists.flatten())
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64, len(taken) + 1, 8 * taken.offset)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        cuts = at[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        whole = memoryview(data) if data is not None else memoryview(b"")
        texts = [str(whole[a:b], "utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose last column, of texts, is neither long nor has many rows."""
    start, size = 0, 0
    sizes = pc.fill_null(pc.utf8_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
    for row, n in enumerate(sizes):
        if row > start and (size + n > TEXTS or row - start >= ROWS):
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def _with_column(batch: pa.RecordBatch, column: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*batch.schema.names[:-1], name])


def _schema(df: DataFrame, kept: list[str], extra: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), extra])


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with the array of ids of a text column.

    NULL and empty texts give an empty array. Literal U+2581 counts as a blank. Texts of any length are encoded whole;
    equal texts give equal ids; a column named as ``into`` is replaced.
    """
    kept = [c for c in (keep or df.columns) if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in _portions(batch):
                ids, counts = encoder.encode(part.column(part.num_columns - 1).to_pylist())
                ends = pa.array(np.cumsum([0, *counts]).astype(np.int32))
                yield _with_column(part, pa.ListArray.from_arrays(ends, pa.array(ids)), into)

    return df.select(*kept, F.col(text).alias("__text")).mapInArrow(run, _schema(df, kept, f"`{into}` array<int>"))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with the text of an array of ids (NULL and empty: empty text)."""
    kept = [c for c in (keep or df.columns) if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = decoder.decode_lists(part.column(part.num_columns - 1))
                yield _with_column(part, pa.array(texts, pa.string()), into)

    return df.select(*kept, F.col(ids).alias("__ids")).mapInArrow(run, _schema(df, kept, f"`{into}` string"))
