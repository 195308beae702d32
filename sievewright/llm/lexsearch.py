"""Ranked lexical search over a length-stratified index.

The score of a term depends on a document only by the term's occurrences tf and the document's normaliser m. Documents of equal m
are one stratum: within it, a term's postings are stored by falling tf, and the impact of (tf, m) is worked out once for
every tf. A stratum's largest tf of each term bounds what any of its documents can score; the strata of a shelf are
visited by falling bound, until the bound is below the score of an item's last place.

A shelf is a run of at most `SHELF` documents in the order (m, doc_id), so that a stratum of any size spreads over shelves.
"""

from __future__ import annotations

import string
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm import splitting
from sievewright.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: All ASCII characters but digits and letters.
SEPARATORS = bytes(b for b in range(128) if chr(b) not in string.ascii_letters + string.digits)
TABLE = splitting.byte_table(SEPARATORS)
SHELF = 2048
#: Items that meet a shelf at a time.
ITEMS = 512
#: Bits of the filter that leaves out terms no item holds: of fixed size; the fuller it is, the less it leaves out.
FILTER_BITS = 1 << 21

FORWARD = "doc_id long, n long, terms array<string>, tfs array<int>"
STRATUM = "shelf long, m long, docs array<long>, terms array<string>, starts array<int>, tfs array<int>, places array<int>"


@dataclass(frozen=True)
class Index:
    """``strata``: one row per stratum of a shelf. Of a term, postings run from its start to the next one's, by falling tf.

    ``documents`` (N) and ``length`` (L) count all documents with a term and all their terms. ``filtered`` says that only terms of
    given items were indexed.
    """

    strata: DataFrame
    documents: int
    length: int
    filtered: bool


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(40)).astype(np.int64) % FILTER_BITS


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in splitting.portions(batch.column(0)):
            words = splitting.split(texts, TABLE)[2]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(splitting.hashes(words))))], names=["slot"])


def term_filter(items: DataFrame, text: str = "text") -> bytes:
    """A bit for every term of the items, by hash: `FILTER_BITS` bits, however many items there are."""
    found = items.select(text).mapInArrow(_slots, "slot long").distinct().toPandas()  # at most FILTER_BITS numbers
    bits = np.zeros(FILTER_BITS, bool)
    bits[found["slot"].to_numpy(np.int64)] = True
    return np.packbits(bits).tobytes()


def _counter(bits: bytes | None):
    """Terms of every document and how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in batches:
            done = 0
            for texts in splitting.portions(batch.column(1)):
                docs, codes, words = splitting.split(texts, TABLE)
                n = np.bincount(docs, minlength=len(texts))
                if wanted is not None and len(words):
                    fit = wanted[_slot(splitting.hashes(words))][codes]
                    docs, codes = docs[fit], codes[fit]
                pairs, tfs = np.unique(docs * max(len(words), 1) + codes, return_counts=True)
                docs, codes = np.divmod(pairs, max(len(words), 1))
                sizes = np.bincount(docs, minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(texts)), pa.array(n, pa.int64()),
                     _lists(words.take(pa.array(codes)), sizes), _lists(pa.array(tfs, pa.int32()), sizes)],
                    names=["doc_id", "n", "terms", "tfs"],
                )
                done += len(texts)

    return count


def _strata(shelf: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """The documents of a shelf, sorted by m, as one row per stratum."""
    m = shelf["m"].to_numpy()
    firsts = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    stratum = np.cumsum(np.r_[True, m[1:] != m[:-1]]) - 1
    sizes = pc.list_value_length(shelf["terms"]).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(m)), sizes)
    coded = pc.dictionary_encode(shelf["terms"].flatten())
    code, tf = coded.indices.to_numpy(zero_copy_only=False), shelf["tfs"].flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((doc, -tf, code, stratum[doc]))
    doc, code, tf = doc[order], code[order], tf[order]
    at = stratum[doc]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (code[1:] != code[:-1])][: len(doc)])
    ends = np.append(firsts[1:], len(m))
    n_terms, n_posts = (np.bincount(x, minlength=len(firsts)) for x in (at[new], at))
    begin = np.cumsum(np.concatenate([[0], n_posts]))[:-1]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(firsts), number)), pa.array(m[firsts]), _lists(shelf["doc_id"], ends - firsts),
         _lists(coded.dictionary.take(pa.array(code[new])), n_terms), _lists(pa.array((new - begin[at[new]]).astype(np.int32)), n_terms),
         _lists(pa.array(tf.astype(np.int32)), n_posts), _lists(pa.array((doc - firsts[at]).astype(np.int32)), n_posts)],
        names=["shelf", "m", "docs", "terms", "starts", "tfs", "places"],
    )


def _shelves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for start in range(0, batch.num_rows, SHELF):
            yield _strata(batch.slice(start, SHELF), number)
            number += 1


def build_index(df: DataFrame, for_items: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows with a term. With ``for_items``, only terms of their texts are indexed.

    Every row is a document, also where ids repeat. NULL has no terms. One shuffle, of the terms by (m, id).
    """
    bits = None if for_items is None else term_filter(for_items, text)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    forward = stage(docs.mapInArrow(_counter(bits), FORWARD).filter("n > 0"), "terms")
    documents, length = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    with_m = forward.select(F.expr(f"25L + (75L * n * {documents}L) div {max(length, 1)}L").alias("m"), "doc_id", "terms", "tfs")
    sorted_ = with_m.filter("size(terms) > 0").repartitionByRange("m", "doc_id").sortWithinPartitions("m", "doc_id")
    strata = stage(sorted_.mapInArrow(_shelves, STRATUM), "strata")
    return Index(strata, documents, length, for_items is not None)


def _impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


class _Stratum:
    def __init__(self, row: dict, wanted: pa.Array):
        self.m, docs = row["m"].as_py(), row["docs"].values
        self.docs, self.known = pc.fill_null(docs, 0).to_numpy(), docs.is_valid().to_numpy(zero_copy_only=False)
        starts = row["starts"].values.to_numpy()
        tfs, self.places = row["tfs"].values.to_numpy(), row["places"].values.to_numpy()
        ends = np.append(starts[1:], len(tfs))
        # the impact of every tf, once
        levels, code = np.unique(tfs, return_inverse=True)
        self.impacts = _impacts(levels, self.m)[code]
        term = pc.index_in(row["terms"].values, value_set=wanted)
        held = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        at = pc.fill_null(term, 0).to_numpy(zero_copy_only=False)[held]
        self.start, self.end, self.most = (np.zeros(len(wanted), np.int64) for _ in range(3))
        self.start[at], self.end[at] = starts[held], ends[held]
        self.most[at] = self.impacts[starts[held]]  # the largest tf stands first

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.docs), np.int64)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            a, b = self.start[t], self.end[t]
            if a < b:
                total[self.places[a:b]] += w * self.impacts[a:b]  # a document stands once in a term's postings
        return total


def _best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int):
    first = np.lexsort((ids, ~known, -scores))[:k]
    return scores[first], ids[first], known[first]


def _searcher(k: int):
    names = ["item_id", "doc_id", "score", "visited"]

    def search(key, items: pa.Table, shelf: pa.Table) -> pa.Table:
        """At most k documents of the shelf for every item."""
        out = []
        if items.num_rows and shelf.num_rows:
            coded = pc.dictionary_encode(items["terms"].combine_chunks().flatten())
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            strata = [_Stratum({c: shelf[c][i] for c in STRATUM_COLUMNS}, coded.dictionary) for i in range(shelf.num_rows)]
            most = np.stack([s.most for s in strata])
            codes = coded.indices.to_numpy(zero_copy_only=False)
            weights = items["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(items["terms"]).to_numpy(zero_copy_only=False))
            for item, start, end in zip(items["item_id"].to_pylist(), np.concatenate([[0], ends]), ends):
                terms, w = codes[start:end], weights[start:end]
                bounds = (most[:, terms] * w).sum(axis=1)
                kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
                visited = 0
                for i in np.argsort(-bounds, kind="stable"):
                    if bounds[i] <= 0 or len(kept[0]) == k and bounds[i] < kept[0][-1]:
                        break
                    visited += 1
                    scores = strata[i].scores(terms, w)
                    floor = kept[0][-1] if len(kept[0]) == k else 1
                    good = np.flatnonzero(scores >= floor)
                    if len(good):
                        ids, known = strata[i].docs[good], strata[i].known[good]
                        kept = _best(*map(np.concatenate, zip(kept, (scores[good], ids, known), strict=True)), k)
                out += [(item, d if known else None, s, visited) for s, d, known in zip(*(x.tolist() for x in kept), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return search


STRATUM_COLUMNS = ["m", "docs", "terms", "starts", "tfs", "places"]


def search(index: Index, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0.

    Equal scores go by ascending doc_id, NULL last. Of several texts of one item the smallest counts. Items without terms, and items
    whose terms no document holds, have no rows. Items go in blocks of about `ITEMS` against all shelves.
    """
    one = items.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(text).alias("text"))
    counted = stage(one.mapInArrow(_counter(None), FORWARD).select(
        F.col("doc_id").alias("item_id"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")
    ).select("item_id", "t.terms", F.col("t.tfs").alias("n")).withColumnRenamed("terms", "term"), "items")
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("tfs")))
    lengths = F.arrays_zip("terms", F.zip_with(ends, "starts", lambda b, a: b - a).alias("df"))
    df = index.strata.select(F.explode(lengths).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2) / (2 * F.col("df") + 1)))
    weighed = counted.join(df, "term").withColumn("w", weight * F.col("n")).filter("w > 0")
    asked = weighed.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("t")).select(
        "item_id", F.col("t.term").alias("terms"), F.col("t.w").alias("weights")
    )
    asked = stage(asked, "asked")
    shelves, n = index.strata.select("shelf").distinct().count(), asked.count()
    result = "item_id long, doc_id long, score long, visited long"
    if not shelves or not n:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = -(-n // ITEMS)
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    buckets = F.sequence(F.lit(0), F.lit(shelves - 1))
    # each block of items against all shelves
    left = asked.select(
        "*", F.expr(f"cast(pmod(xxhash64(item_id), {blocks}) as int)").alias("block"), F.explode(buckets).alias("bucket")
    )
    right = index.strata.select(
        *STRATUM_COLUMNS, F.explode(numbers).alias("block"), F.expr(f"cast(pmod(xxhash64(shelf), {shelves}) as int)").alias("bucket")
    )
    found = left.groupBy("block", "bucket").cogroup(right.groupBy("block", "bucket")).applyInArrow(_searcher(k), result)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
