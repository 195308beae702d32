"""Katz backoff over words and word pairs.

The probability of a token after another is its discounted share of what followed there in training; for a pair never seen,
it is the token's own probability times the context's backoff weight, and a token never seen has the mass that discounting
left over. Counts up to `TOP` are discounted by Good-Turing ratios (`discounts`). A backoff weight is the context's free mass
over the mass of all tokens not seen after it, so that the probabilities of each context add up to one exactly.

The model lies in partitioned tables: tokens with counts, pairs by context, and the mass of rare followers by context.
Texts are split into pairs in tasks, which send each partition its pairs with the documents that hold them; a partition
looks up its pairs and returns one sum per document. Tokens are 64-bit hashes; the `KNOWN` most frequent go by number and
their counts travel with the tasks (a list of fixed size).

A context that holds a large share of all pairs is spread over partitions by the following token, and a pair that does so is
scored where the text is read; the numbers of both are bounded by the number of partitions.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm import splitting
from sievewright.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLE = splitting.byte_table(b"\x09\x0a\x0b\x0c\x0d")
#: Counts up to this may be discounted.
TOP = 5
KNOWN = 1 << 18
#: Pairs in a partition, about.
ENTRIES = 2_000_000
#: Contexts seen more often than this always keep one count for what was not seen.
MANY = 1 << 16
START, END = splitting.hashes(pa.array([" start", " end"]))  # no word holds a blank

PACKED = "part int, kind int, blob binary"
#: Packed sums of a portion's documents, or one new pair (document, token, count) that has to be looked up.
REPLY = "portion long, blob binary, doc int, w long, n long"
SUMS = "portion long, doc int, doc_id long, digest long, score double, base double, tokens long, known long, copies long"
PAIRS, MASS, ENTRY, PASSED = range(4)


def discounts(n: list[int]) -> list[float]:
    """Katz's ratios for counts 1, 2, …; ``n[r - 1]`` tokens or pairs have count r, up to `TOP` + 1.

    The largest k up to `TOP` counts for which all ratios lie between 0 and 1; none if there is none.
    """
    for k in range(TOP, 1, -1):
        if all(n[: k + 1]):
            last = (k + 1) * n[k] / n[0]
            if last < 1:
                ratios = [((r + 1) * n[r] / (r * n[r - 1]) - last) / (1 - last) for r in range(1, k + 1)]
                if all(0 < d < 1 for d in ratios):
                    return ratios
    return []


def _pack(**columns: np.ndarray) -> bytes:
    arrays = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns.values()]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(arrays, names=list(columns))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    return {n: batch[n].flatten().to_numpy(zero_copy_only=False) for n in batch.schema.names}


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers (0 or more) in the narrowest type."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread evenly."""
    u = x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return u ^ (u >> np.uint64(29))


@dataclass
class Words:
    """The most frequent tokens by hash, with counts; the heavy contexts (numbers)."""

    hashes: np.ndarray
    counts: np.ndarray
    heavy: np.ndarray
    parts: int

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """A known token's number; another token's hash, which is never that small."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        other = np.where((hashes >= 0) & (hashes < KNOWN), ~hashes, hashes)
        return np.where(self.hashes[at] == hashes, at, other) if len(self.hashes) else other

    def is_known(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers >= 0) & (numbers < len(self.hashes))

    def part(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        key = _mixed(v)
        if len(self.heavy):
            heavy = np.isin(v, self.heavy)
            key[heavy] = _mixed((key[heavy] ^ w[heavy].view(np.uint64)).view(np.int64))
        return ((key >> np.uint64(8)) % np.uint64(self.parts)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Tokens (w, c) and packed pairs and masses by partition are tables; all else is of bounded size.

    ``seldom``: chances of the tokens outside ``words``; ``unseen``: the chance of any token that training did not have.
    ``contexts``: count, divisor and backoff weight of the heavy contexts. ``pairs``: scores of the heavy pairs.
    """

    tokens: DataFrame
    packed: DataFrame
    words: Words
    seldom: DataFrame
    unseen: float
    total: int
    distinct: int
    ends: int
    one: list[float]
    two: list[float]
    contexts: dict[int, tuple[int, int, float]]
    pairs: dict[tuple[int, int], float]

    @property
    def whole(self) -> int:
        return _whole(self.total, self.one)


def _whole(total: int, one: list[float]) -> int:
    """What token counts are divided by: one more where discounting leaves nothing."""
    return total + (not one)


def _documents(batches: Iterator[pa.RecordBatch], at: int):
    """(rows of the portion, row and hash of every token) for portions of the column ``at``."""
    for batch in batches:
        done = 0
        for texts in splitting.portions(batch.column(at)):
            docs, codes, words = splitting.split(texts, TABLE)
            yield batch.slice(done, len(texts)), docs, codes, splitting.hashes(words)
            done += len(texts)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _, codes, ids in _documents(batches, 0):
        counts = np.bincount(codes, minlength=len(ids))
        ids, counts = np.append(ids[counts > 0], END), np.append(counts[counts > 0], rows.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts, pa.int64())], names=["w", "c"])


def _pairs(docs: np.ndarray, codes: np.ndarray, ids: np.ndarray, n: int):
    """(document, previous, token) of every token with its end, as places in the list of hashes that is returned."""
    sizes = np.bincount(docs, minlength=n)
    ends = np.cumsum(sizes) + np.arange(n)
    token = np.empty(len(codes) + n, np.int64)
    token[np.arange(len(codes)) + docs] = codes
    token[ends] = len(ids) + 1
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - sizes] = len(ids)
    return np.repeat(np.arange(n), sizes + 1), before, token, np.concatenate([ids, [START, END]])


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def _by_part(part: np.ndarray):
    """(partition, its rows) for every partition that has rows."""
    order = np.argsort(part, kind="stable")
    starts = _runs(part[order])
    for rows in np.split(order, starts[1:]) if len(order) else []:
        yield int(part[rows[0]]), rows


def _packer(words: Words):
    """Distinct pairs of a portion with counts, one packed row per partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, docs, codes, ids in _documents(batches, 0):
            _, before, token, ids = _pairs(docs, codes, ids, rows.num_rows)
            pairs, counts = np.unique(before * len(ids) + token, return_counts=True)
            names = words.numbers(ids)
            v, w = names[pairs // len(ids)], names[pairs % len(ids)]
            yield from _sent(words.part(v, w), PAIRS, lambda at: _by_context(v[at], w[at], n=counts[at]))

    return pack


def _sent(part: np.ndarray, kind: int, columns) -> Iterator[pa.RecordBatch]:
    for p, at in _by_part(part):
        yield _row(p, kind, _pack(**columns(at)))


def _row(part: int, kind: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], names=["part", "kind", "blob"]
    )


def _by_context(v: np.ndarray, w: np.ndarray, **more: np.ndarray) -> dict[str, np.ndarray]:
    """Pairs in the order of their contexts, each context once; frequent followers (small numbers) apart from hashes."""
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    starts = _runs(v)
    short = (w >= 0) & (w < KNOWN)
    return {
        "v": v[starts], "run": _small(np.diff(np.append(starts, len(v)))), "short": short, "w": _small(w[short]), "hash": w[~short],
        **{k: _small(x[order]) for k, x in more.items()},
    }


def _pairs_of(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    v = np.repeat(columns["v"], columns["run"])
    w = np.empty(len(v), np.int64)
    w[columns["short"]], w[~columns["short"]] = columns["w"], columns["hash"]
    return v, w


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, w, count) once for every pair, sorted."""
    v, w, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((w, v))
    v, w, n = v[order], w[order], n[order]
    new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])][: len(v)])
    return v[new], w[new], np.add.reduceat(n, new) if len(n) else n


def _merge(table: pa.Table) -> pa.Table:
    """The pairs of a partition with their counts, and how many pairs have count 1, 2, …"""
    parts = [(*_pairs_of(c), c["n"].astype(np.int64)) for c in map(_unpack, table["blob"].to_pylist())]
    v, w, n = _added(parts)
    of_count = np.bincount(np.minimum(n, TOP + 2), minlength=TOP + 3)[1 : TOP + 2]
    blob = _pack(**_by_context(v, w, n=n))
    return pa.Table.from_arrays(
        [table["part"].slice(0, 1), pa.array([PAIRS], pa.int32()), pa.array([blob], pa.binary()), pa.array([of_count.tolist()], pa.list_(pa.int64()))],
        names=["part", "kind", "blob", "of_count"],
    )


def _rare_pairs(words: Words):
    """Pairs whose token is not among the known ones."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                v, w = _pairs_of(_unpack(blob.as_py()))
                some = ~words.is_known(w)
                yield pa.RecordBatch.from_arrays([pa.array(v[some]), pa.array(w[some])], names=["v", "w"])

    return rare


def _mass_packer(words: Words):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, mass = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            light = ~np.isin(v, words.heavy)
            v, mass = v[light], mass[light]
            yield from _sent(words.part(v, v), MASS, lambda at: {"v": v[at], "mass": mass[at]})

    return pack


def _token_chance(count: np.ndarray, one: list[float], whole: int) -> np.ndarray:
    ratio = np.ones(len(count))
    for r, d in enumerate(one, 1):
        ratio[count == r] = d
    return ratio * count / whole


def _heavy_parts(words: Words, chances: np.ndarray, least: int):
    """Of heavy contexts, what each partition holds: pairs by count, mass of known followers; and the heavy pairs."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                c = _unpack(blob.as_py())
                v, w = _pairs_of(c)
                n = c["n"].astype(np.int64)
                some = np.isin(v, words.heavy)
                v, w, n = v[some], w[some], n[some]
                known = words.is_known(w)
                for x in np.unique(v):
                    at = v == x
                    of_count = np.bincount(np.minimum(n[at], TOP + 1), minlength=TOP + 2)[1 : TOP + 1]
                    yield pa.RecordBatch.from_pylist(
                        [{"v": int(x), "w": None, "c": 0, "mass": float(chances[w[at & known]].sum()), "of_count": of_count.tolist()}], HEAVY_SCHEMA
                    )
                big = n >= least
                if big.any():
                    yield pa.RecordBatch.from_pylist(
                        [{"v": a, "w": b, "c": m, "mass": 0.0, "of_count": [0] * TOP}
                         for a, b, m in zip(v[big].tolist(), w[big].tolist(), n[big].tolist(), strict=True)], HEAVY_SCHEMA,
                    )

    return gather


HEAVY = "v long, w long, c long, mass double, of_count array<long>"
HEAVY_SCHEMA = pa.schema([("v", pa.int64()), ("w", pa.int64()), ("c", pa.int64()), ("mass", pa.float64()), ("of_count", pa.list_(pa.int64()))])


def _total(count, light):
    """What a context's counts are divided by; ``light``: some of its followers are discounted."""
    return count + np.where(light & (count <= MANY), 0, 1)


def train(df: DataFrame, text: str = "text") -> Model:
    """Count tokens and pairs of all rows; NULL is an empty text, which is its end only."""
    texts = df.select(F.col(text).alias("text"))
    tokens = stage(texts.mapInArrow(_count_tokens, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "tokens")
    counts = [F.coalesce(F.sum(F.when(F.col("c") == r, 1)), F.lit(0)).alias(f"n{r}") for r in range(1, TOP + 2)]
    # how many tokens have at least 1, 2, 4, … occurrences
    least = [F.coalesce(F.sum(F.when(F.col("c") >= 2**i, 1)), F.lit(0)).alias(f"l{i}") for i in range(62)]
    s = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct"), *counts, *least).first()
    total, one = s["total"], discounts([s[f"n{r}"] for r in range(1, TOP + 2)])
    bound = next(2**i for i in range(62) if s[f"l{i}"] <= KNOWN)
    frequent = tokens.filter(F.col("c") >= bound).toPandas().sort_values("w")  # at most KNOWN rows
    hashes, counts = frequent["w"].to_numpy(np.int64), frequent["c"].to_numpy(np.int64)
    parts = max(1, -(-total // ENTRIES))
    heavy_from = max(MANY + 1, total // (4 * parts))
    ends = tokens.filter(F.col("w") == int(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words = Words(hashes, counts, np.empty(0, np.int64), parts)
    is_end = hashes == END
    heavy = {int(i): int(counts[i]) for i in np.flatnonzero((counts >= heavy_from) & ~is_end)}  # at most 4 a partition
    if ends >= heavy_from:
        heavy[int(words.numbers(np.array([START]))[0])] = int(ends)
    words.heavy = np.array(sorted(heavy), np.int64)

    merged = texts.mapInArrow(_packer(words), PACKED).groupBy("part").applyInArrow(_merge, PACKED + ", of_count array<long>")
    pairs = stage(merged, "pairs")
    row = pairs.agg(*[F.coalesce(F.sum(F.col("of_count")[r]), F.lit(0)) for r in range(TOP + 1)]).first()
    two = discounts(list(row))

    whole = _whole(total, one)
    chances = _token_chance(counts, one, whole)
    ratio = F.when(F.col("c") <= len(one), F.get(F.lit(one or [1.0]), (F.col("c") - 1).cast("int"))).otherwise(1.0)
    rare = pairs.select("blob").mapInArrow(_rare_pairs(words), "v long, w long")
    numbers = F.when((F.col("w") >= 0) & (F.col("w") < KNOWN), F.bitwise_not("w")).otherwise(F.col("w"))
    seldom = tokens.filter(F.col("c") < bound).select(numbers.alias("w"), (ratio * F.col("c") / whole).alias("p"))
    unseen = (sum((1 - d) * r * s[f"n{r}"] for r, d in enumerate(one, 1)) + whole - total) / whole
    mass = stage(rare.join(seldom, "w").groupBy("v").agg(F.sum("p").alias("mass")), "mass")

    contexts, scores = {}, {}
    if heavy:
        found = pairs.select("blob").mapInArrow(_heavy_parts(words, chances, heavy_from), HEAVY)
        sums = [F.sum(F.col("of_count")[r]).alias(f"n{r}") for r in range(TOP)]
        known = found.groupBy("v", "w").agg(F.max("c").alias("c"), F.sum("mass").alias("mass"), *sums).collect()  # at most 8 a partition
        numbers = tokens.sparkSession.createDataFrame([(v,) for v in heavy], "v long")
        others = {r["v"]: r["mass"] for r in mass.join(numbers, "v").collect()}
        for r in known:
            if r["w"] is None:
                count, left = heavy[r["v"]], sum((1 - d) * i * r[f"n{i - 1}"] for i, d in enumerate(two, 1))
                free = (left + 1) / (count + 1)
                contexts[r["v"]] = (count, count + 1, free / max(1 - r["mass"] - others.get(r["v"], 0.0), unseen))
        for r in known:
            if r["w"] is not None:
                ratio = two[r["c"] - 1] if r["c"] <= len(two) else 1.0
                scores[r["v"], r["w"]] = math.log10(ratio * r["c"] / contexts[r["v"]][1])
    masses = mass.mapInArrow(_mass_packer(words), PACKED)
    packed = pairs.select("part", "kind", "blob").unionByName(masses)
    return Model(tokens, packed, words, seldom, unseen, total, s["distinct"], ends, one, two, contexts, scores)


def _entry_packer(model: dict):
    """Pairs of every document, one packed row per partition; heavy pairs are scored here, for they are in many documents."""
    words: Words = model["words"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.array(sorted(model["pairs"]), np.int64).reshape(-1, 2)
        heavy_scores = np.array([model["pairs"][tuple(p)] for p in heavy.tolist()])
        heavy_counts = np.array([model["contexts"][p[0]][0] for p in heavy.tolist()], np.int64)
        firsts, seconds = np.unique(heavy[:, 0]), np.unique(heavy[:, 1])
        heavy_keys = _lookup(firsts, heavy[:, 0]) * max(len(seconds), 1) + _lookup(seconds, heavy[:, 1])
        for rows, docs, codes, ids in _documents(batches, 2):
            docs, before, token, ids = _pairs(docs, codes, ids, rows.num_rows)
            names = words.numbers(ids)
            some = rows.column(0).is_valid().to_numpy(zero_copy_only=False)
            who = {"key": rows.column(0).fill_null(0).to_numpy(), "some": some, "digest": rows.column(1).to_numpy()}
            # portions of equal rows are one: their sums are added, and divided by the number of copies in the end
            name = hashlib.blake2b(b"".join(x.tobytes() for x in who.values()), digest_size=8).digest()
            portion = np.frombuffer(name, np.int64)
            home = int(_mixed(portion)[0] % np.uint64(words.parts))
            yield _row(home, PASSED, _pack(portion=portion, **who))
            pairs = before * len(ids) + token
            order = np.lexsort((docs, pairs))
            pairs, docs = pairs[order], docs[order]
            new = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (docs[1:] != docs[:-1])][: len(docs)])
            n = np.diff(np.append(new, len(docs)))
            pairs, docs = pairs[new], docs[new]
            starts = _runs(pairs)
            held = np.diff(np.append(starts, len(pairs)))  # documents with each pair
            v, w = names[pairs[starts] // len(ids)], names[pairs[starts] % len(ids)]
            first, second = _lookup(firsts, v), _lookup(seconds, w)
            here = np.where((first >= 0) & (second >= 0), _lookup(heavy_keys, first * max(len(seconds), 1) + second), -1)

            def entries(at: np.ndarray):
                which = np.repeat(starts[at], held[at]) + _places(held[at])
                return docs[which], n[which]

            if (here >= 0).any():
                at = np.flatnonzero(here >= 0)
                doc, count = entries(at)
                pair = np.repeat(here[at], held[at])
                end, start = np.repeat(w[at] == model["end"], held[at]), np.repeat(v[at] == model["start"], held[at])
                sums = _per_document(doc, count, heavy_scores[pair], heavy_counts[pair], start, end)
                yield _row(home, PASSED, _pack(portion=portion, **sums))
            rest = np.flatnonzero(here < 0)
            for p, at in _by_part(words.part(v[rest], w[rest])):
                at = rest[at]
                at = at[np.lexsort((w[at], v[at]))]
                doc, count = entries(at)
                yield _row(p, ENTRY, _pack(
                    portion=portion, **_by_context(v[at], w[at]), held=_small(held[at]), doc=_small(doc), n=_small(count)
                ))

    return pack


def _per_document(doc, n, score, count, start, end) -> dict[str, np.ndarray]:
    """Sums over a document's pairs; ``count`` is the context's. Documents are given by their distances."""
    used, doc = np.unique(doc, return_inverse=True)
    size = len(used)
    whole = {"tokens": n, "known": n * ((count > 0) & ~start), "copies": n * end}
    return {
        "gap": _small(np.diff(used, prepend=0)), "score": np.bincount(doc, score * n, size),
        "base": np.bincount(doc, np.where(start, 0.0, np.log10(count + 1)) * n, size),
        **{k: _small(np.bincount(doc, x, size)) for k, x in whole.items()},
    }


def _places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … within each of the runs of these sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class _Part:
    """Pairs, totals and backoff weights of one partition's contexts."""

    def __init__(self, model: dict, table: list[dict], masses: list[dict]):
        words, two = model["words"], model["two"]
        empty = (np.empty(0, np.int64),) * 3
        v, self.w, n = _added([empty, *((*_pairs_of(c), c["n"].astype(np.int64)) for c in table)])
        starts = _runs(v)
        self.v, which = v[starts], np.cumsum(np.r_[False, v[1:] != v[:-1]][: len(v)])
        size = len(starts)
        self.count = np.bincount(which, n, size).astype(np.int64)
        ratio = np.ones(len(n))
        for r, d in enumerate(two, 1):
            ratio[n == r] = d
        light = np.bincount(which, n <= len(two), size) > 0
        total = _total(self.count, light)
        left = np.bincount(which, (1 - ratio) * n, size) + (total - self.count)
        known = words.is_known(self.w)
        seen = np.bincount(which[known], model["chances"][self.w[known]], size).astype(float)
        for c in masses:
            at = np.searchsorted(self.v, c["v"])
            seen[at] += c["mass"]
        self.weight = left / total / np.maximum(1 - seen, model["unseen"])
        for i in np.flatnonzero(np.isin(self.v, words.heavy)):  # only some of the followers are here
            self.count[i], total[i], self.weight[i] = model["contexts"][int(self.v[i])]
        self.score = np.log10(ratio * n / total[which])
        self.tokens = np.unique(self.w)
        self.keys = which * max(len(self.tokens), 1) + np.searchsorted(self.tokens, self.w)

    def find(self, v: np.ndarray, w: np.ndarray):
        """Context and pair of every (v, w) by place, -1 for none."""
        context, token = _lookup(self.v, v), _lookup(self.tokens, w)
        pair = _lookup(self.keys, context * max(len(self.tokens), 1) + token)
        return context, np.where((context >= 0) & (token >= 0), pair, -1)


def _lookup(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def _reply(portion: int, blob: bytes | None = None, doc=(), w=(), n=()) -> pa.Table:
    """One row with a blob, or one for every pair to be looked up."""
    size = len(doc) if blob is None else 1
    columns = [doc, w, n] if blob is None else [[None]] * 3
    types = [pa.int32(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays(
        [pa.array([portion] * size, pa.int64()), pa.array([blob] * size, pa.binary()),
         *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["portion", "blob", "doc", "w", "n"],
    )


def _add(table: pa.Table) -> pa.Table:
    """A portion's documents with their sums over all partitions."""
    parts = [_unpack(b) for b in table["blob"].to_pylist()]
    who = next(p for p in parts if "key" in p)
    size = len(who["key"])
    sums = {c: np.zeros(size, np.int64 if c in ("tokens", "known", "copies") else float) for c in ("score", "base", "tokens", "known", "copies")}
    for p in parts:
        if "gap" in p:
            at = np.cumsum(p["gap"].astype(np.int64))
            for c, total in sums.items():
                total[at] += p[c].astype(total.dtype)
    first = pa.chunked_array([pa.array([table["portion"][0].as_py()] * size, pa.int64())])
    return pa.table({
        "portion": first, "doc": pa.array(np.arange(size), pa.int32()), "doc_id": pa.array(who["key"], pa.int64(), mask=~who["some"]),
        "digest": who["digest"], **sums,
    })


def _scorer(model: dict):
    """Sums of every portion's documents over a partition; new pairs whose token is not among the known are to be looked up."""
    words: Words = model["words"]

    def score(table: pa.Table) -> pa.Table:
        by_kind: dict[int, list[bytes]] = {}
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
            by_kind.setdefault(kind, []).append(blob)
        part = _Part(model, [_unpack(b) for b in by_kind.get(PAIRS, [])], [_unpack(b) for b in by_kind.get(MASS, [])])
        heavy = np.array(sorted(model["contexts"]), np.int64)
        heavy_counts = np.array([model["contexts"][x][0] for x in heavy.tolist()], np.int64)
        heavy_weights = np.array([model["contexts"][x][2] for x in heavy.tolist()])
        out = [_reply(0)]
        out += [_reply(int(_unpack(blob)["portion"][0]), blob) for blob in by_kind.get(PASSED, [])]
        for blob in by_kind.get(ENTRY, []):
            c = _unpack(blob)
            v, w = _pairs_of(c)
            context, pair = part.find(v, w)
            at = _lookup(heavy, v)
            count = _either(at, heavy_counts, _either(context, part.count, np.zeros(len(v), np.int64)))
            weight = _either(at, heavy_weights, _either(context, part.weight, np.ones(len(v))))
            seen, known = pair >= 0, words.is_known(w)
            scores = np.log10(weight)
            scores[known] += np.log10(model["chances"][w[known]])
            scores[seen] = part.score[pair[seen]]
            row = np.repeat(np.arange(len(v)), c["held"])
            doc, n, portion = c["doc"], c["n"].astype(np.int64), int(c["portion"][0])
            sums = _per_document(doc, n, scores[row], count[row], (v == model["start"])[row], (w == model["end"])[row])
            out.append(_reply(portion, _pack(**sums)))
            rest = np.flatnonzero((~seen & ~known)[row])
            out.append(_reply(portion, None, doc[rest], w[row[rest]], n[rest]))
        return pa.concat_tables(out)

    return score


def _either(at: np.ndarray, values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """``values`` at the places that are not -1."""
    return np.where(at >= 0, values[np.maximum(at, 0)], others) if len(values) else others


def log_probabilities(df: DataFrame, model: Model, keep: list[Column], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score and score of every row, by the row's ``text``.

    score: the model's log10 probability of the text and its end. base_score: the sum of log10((c + 1) / (N + V + 1)). NULL is
    an empty text: its end alone. Rows of one key and text have equal scores; a NULL key is a key. Columns other than
    key and text are read by ``keep`` only. Without training texts every token has the probability one.
    """
    small = {
        "words": model.words, "two": model.two, "contexts": model.contexts, "pairs": model.pairs,
        "chances": _token_chance(model.words.counts, model.one, model.whole), "unseen": model.unseen,
        "start": int(model.words.numbers(np.array([START]))[0]), "end": int(model.words.numbers(np.array([END]))[0]),
    }
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    docs = df.select(F.col(key).cast("long").alias("doc_id"), digest.alias("digest"), F.col(text).alias("text"))
    rows = model.packed.unionByName(docs.mapInArrow(_entry_packer(small), PACKED))
    replies = stage(rows.groupBy("part").applyInArrow(_scorer(small), REPLY), "replies")
    sums = replies.filter("blob is not null").select("portion", "blob").groupBy("portion").applyInArrow(_add, SUMS)
    # what a partition could not look up: new pairs with a token that is rare or was never seen
    chance = F.coalesce("p", F.lit(model.unseen))
    open_ = replies.filter("w is not null").select("portion", "doc", "w", "n").join(model.seldom, "w", "left").groupBy("portion", "doc").agg(
        F.sum(F.col("n") * F.log10(chance)).alias("open")
    )
    parts = sums.join(open_, ["portion", "doc"], "left").withColumn("score", F.col("score") + F.coalesce("open", F.lit(0.0)))
    # rows of one key and text were read as often as their end
    totals = parts.groupBy("doc_id", "digest").agg(*[
        (F.sum(c) / F.sum("copies")).alias(c) for c in ("score", "base", "tokens", "known")
    ])
    ends = F.lit(int(model.ends > 0))
    base = F.col("base") + math.log10(model.ends + 1) - F.col("tokens") * math.log10(model.total + model.distinct + 1)
    found = totals.select(
        F.col("doc_id").alias("__key"), F.col("digest").alias("__digest"), F.col("tokens").cast("long").alias("n_tokens"),
        (F.col("known") + ends).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score",
    )
    asked = df.select(*keep, F.col(key).cast("long").alias("__doc"), digest.alias("__text"))
    joined = asked.join(found, F.col("__doc").eqNullSafe(F.col("__key")) & (F.col("__text") == F.col("__digest")))
    return joined.drop("__doc", "__text", "__key", "__digest")
