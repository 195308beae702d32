"""Near-duplicate documents: minima of universal hashes, bands, verification, components.

A document is the set of its distinct shingles (five words; a shorter text is one shingle).
Documents with equal sets form a class, and only one of a class goes on. `BANDS` bands of `ROWS` minima
give candidates: at the required similarity of 0.75 a pair misses all bands with probability
(1 - 0.75^4)^32 = 5e-6. Within a band all members are first compared with the smallest of them, which is
linear and settles groups of copies; what is still in different components after that is compared in blocks, by
signatures first and then on full sets, inside tasks: pairs are never written out. Every link is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.components import components
from sievewright.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
PERCENT = 75
BANDS = 32
ROWS = 4
#: Signatures agree in at least this share before full sets are compared: at a similarity of 0.75
#: fewer than 74 of 128 equal minima have probability 7e-6.
LIKELY = 74 / (BANDS * ROWS)
#: Rows of a group that one task compares with as many others.
BLOCK = 1024
SEED = 11

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CACHE_WORDS = 500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 2**63, WORDS + 1, dtype=np.uint64) | np.uint64(1)
    width = min(WORDS, len(words))
    # a short text is told apart from a full shingle by its own last factor
    total = np.full(len(ids) - width + 1, int(factors[WORDS]) * width % 2**64, np.uint64)
    for k in range(width):
        total += _mixed(ids[k : len(ids) - width + 1 + k] + factors[k]) * factors[k]
    return np.unique(_mixed(total))


def signature(found: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The minimum of every universal hash over the set, in bounded slices."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 2048):
        part = np.multiply.outer(factors, found[start : start + 2048])
        part += shifts[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _universal() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + 1)
    n = BANDS * ROWS
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, universal = _WordHashes(), _universal()
    for batch in batches:
        sizes, digests, signs = [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py(), hashes)
            sizes.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            signs.append(signature(found, *universal).tobytes() if len(found) else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())],
            names=["id", "n", "digest", "sign"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):  # sets are larger than texts: small batches
            part = batch.slice(start, 256)
            found = [shingles(t.as_py(), hashes).view(np.int64) for t in part.column(1)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["id", "parts"]
            )


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            found = [shingles(t.as_py(), hashes).tobytes() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["id", "parts"])


def _groups(frames, keys: list[str]):
    """Whole groups of frames that come sorted by the keys; a group may go on in the next frame."""
    import pandas as pd

    carry = None
    for frame in frames:
        if carry is not None:
            frame = pd.concat([carry, frame], ignore_index=True)
        last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1)
        carry = frame[last]
        yield from frame[~last].groupby(keys, sort=False)
    if carry is not None:
        yield from carry.groupby(keys, sort=False)


def _likely(group, i: int, j: int, place: int = 0):
    """For the rows of block i of a group: the rows of block j (later ones, if i is j) in other components whose
    signature agrees enough, and that meet in no band before ``place``."""
    signs = np.frombuffer(b"".join(group["sign"]), "<u4").reshape(len(group), BANDS, ROWS)
    blocks, comps = group["block"].to_numpy(), group["comp"].to_numpy()
    first, second = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    for row in first:
        others = second[second > row] if i == j else second
        others = others[comps[others] != comps[row]]
        if len(others):
            same = signs[others] == signs[row]
            met = same[:, :place].all(axis=2).any(axis=1)
            others = others[(same.mean(axis=(1, 2)) >= LIKELY) & ~met]
            if len(others):
                yield row, others


class _Joined:
    """Which rows of a group its links connect; only links that connect more are kept."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.root, self.links = ids, np.arange(len(ids)), []

    def apart(self, row: int, others: np.ndarray) -> np.ndarray:
        return others[self.root[others] != self.root[row]]

    def link(self, row: int, others: np.ndarray) -> None:
        for k in others:
            if self.root[k] != self.root[row]:
                self.root[self.root == self.root[k]] = self.root[row]
                self.links.append((self.ids[row], self.ids[k]))


def _likely_links(frames):
    """Edges (a, b) that connect the likely pairs of a group: fewer than it has rows."""
    import pandas as pd

    for (place, _, i, j), group in _groups(frames, ["place", "band", "i", "j"]):
        joined = _Joined(group["id"].to_numpy())
        for row, others in _likely(group, i, j, place):
            joined.link(row, joined.apart(row, others))
        if joined.links:
            yield pd.DataFrame(joined.links, columns=["a", "b"])


def _confirmed_links(frames):
    """Links (a, b) confirmed on full sets; none between rows that the links of a group connect already."""
    import pandas as pd

    for (_, i, j), group in _groups(frames, ["cluster", "i", "j"]):
        sets = [np.frombuffer(x, np.uint64) for x in group["parts"]]
        sizes = np.array([len(x) for x in sets])
        joined = _Joined(group["id"].to_numpy())
        for row, others in _likely(group, i, j):
            others = joined.apart(row, others)
            if not len(others):
                continue
            parts = np.concatenate([sets[k] for k in others])
            at = np.minimum(np.searchsorted(sets[row], parts), sizes[row] - 1)
            common = np.add.reduceat(sets[row][at] == parts, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
            joined.link(row, others[100 * common >= PERCENT * (sizes[others] + sizes[row] - common)])
        if joined.links:
            yield pd.DataFrame(joined.links, columns=["a", "b"])


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    texts = docs.join(wanted, "id", "left_semi")
    sets = texts.mapInArrow(_sets, "id long, parts array<long>")
    left = sets.select(F.col("id").alias("a"), F.col("parts").alias("pa"))
    right = sets.select(F.col("id").alias("b"), F.col("parts").alias("pb"))
    common = F.size(F.array_intersect("pa", "pb"))
    union = F.size("pa") + F.size("pb") - common
    return pairs.join(left, "a").join(right, "b").filter(100 * common >= PERCENT * union).select("a", "b").distinct()


def _in_blocks(rows: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """Rows of a group dealt to pairs (i, j) of its blocks; ``sizes`` has the number of blocks of the groups to keep."""
    placed = rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    return placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *rows.columns, "block", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j")
    )


def _sorted_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row.

    Rows linked directly or through others share the smallest key as ``component_id``; ``kept`` marks the row
    that has it. NULL, empty and word-less texts have no shingles and are linked with nothing. Rows
    of one key are one document. A row without a key is never linked: its component is NULL and it is kept.
    Equal texts are one class and are not expanded into pairs. Columns besides key and text are not read.
    """
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = stage(docs.mapInArrow(_signatures, "id long, n long, digest binary, sign binary"), "signatures")
    classes = stage(
        rows.filter("n > 0 and id is not null").groupBy("digest").agg(
            F.min("id").alias("id"), F.first("sign").alias("sign")
        ),
        "classes",
    )
    width = 4 * ROWS
    banded = classes.select("id", F.posexplode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), k -> xxhash64(k, substring(sign, k * {width} + 1, {width})))"
    )).alias("place", "band"))
    shared = banded.groupBy("place", "band").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(banded.join(shared.drop("n"), ["place", "band"]), "members")
    stars = stage(members.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = stage(_confirmed(stars, docs), "links")
    found = components(links)

    # members of a band that are still apart
    apart = members.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "place", "band", "id", F.coalesce("component", "id").alias("comp")
    )
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    mixed = apart.groupBy("place", "band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), blocks)
    mixed = mixed.filter("low <> high").select("place", "band", "blocks")
    dealt = _in_blocks(apart, ["place", "band"], mixed).join(classes.select("id", "sign"), "id")
    likely = components(_sorted_by(dealt, "place", "band", "i", "j").mapInPandas(_likely_links, "a long, b long"))
    # documents that likely pairs connect are compared on full sets, which are sent once for each block of the others
    clustered = stage(
        likely.toDF("id", "cluster").join(found.toDF("id", "comp"), "id", "left").select(
            "id", "cluster", F.coalesce("comp", "id").alias("comp")
        ),
        "clustered",
    )
    texts = docs.join(clustered.select("id"), "id", "left_semi")
    full = _in_blocks(clustered, ["cluster"], clustered.groupBy("cluster").agg(blocks)).join(
        classes.select("id", "sign"), "id"
    ).join(texts.mapInArrow(_packed_sets, "id long, parts binary"), "id")
    late = stage(_sorted_by(full, "cluster", "i", "j").mapInPandas(_confirmed_links, "a long, b long"), "links")
    final = components(links.union(late))

    owners = classes.select("digest", F.col("id").alias("owner"))
    ends = rows.join(owners, "digest", "left").join(final.withColumnRenamed("node", "owner"), "owner", "left")
    known = F.when(F.col("n") > 0, F.coalesce("component", "owner")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), known)
    return ends.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
