"""Language identification by the mixture of languages in a document.

Training counts hashed character trigrams per language over all labelled texts. For a document, expectation-
maximisation estimates the proportions in which the languages' trigram distributions explain its
text. The set of languages grows one at a time as long as the likelihood gains more than a
penalty per language (Bayesian information criterion); the largest proportion names the document.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOTS = 1 << 16
#: The model is SLOTS numbers per language; more languages than this are an error.
MOST_LANGUAGES = 256
SMOOTHING = 0.5
ROUNDS = 12
UNKNOWN = "und"
#: Code points of a text that are worked on at a time.
SLICE = 1 << 20
#: Letters, and a few numbers that are no digits.
_LETTER = re.compile(r"[^\W\d_]")


def _has_letter(text: str) -> bool:
    return any(found[0].isalpha() for found in _LETTER.finditer(text))


def _in_word(code: int) -> bool:
    """Letters and the marks on them, by Unicode category."""
    return unicodedata.category(chr(code))[0] in "LM"


@cache
def _word_table() -> np.ndarray:
    return np.array([_in_word(c) for c in range(1 << 16)])


def _word_codes(codes: np.ndarray) -> np.ndarray:
    """Which code points belong to words."""
    found = _word_table()[codes & 0xFFFF]
    far = codes > 0xFFFF
    if far.any():
        rare, at = np.unique(codes[far], return_inverse=True)
        found[far] = np.array([_in_word(int(c)) for c in rare])[at]
    return found


@dataclass(frozen=True)
class Model:
    """Languages and, for each, the probability of every trigram slot (slots by languages)."""

    languages: tuple[str, ...]
    chances: np.ndarray


def _slots(text: str) -> np.ndarray:
    """Trigram slots of a text: lower case, everything but letters and their marks is one blank."""
    out = []
    for start in range(0, len(text), SLICE):
        # two more code points, so that no trigram is lost at a slice end
        part = " " * (start == 0) + text[start : start + SLICE + 2].lower() + " " * (start + SLICE + 2 >= len(text))
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_word_codes(codes), codes, np.uint32(32))
        mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
        spaced = (codes[1:-1] == 32) & ((codes[:-2] == 32) | (codes[2:] == 32))  # blanks only say nothing
        out.append(((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16))[~spaced])
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            name = lang.as_py()
            if name not in counts:
                if len(counts) >= MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
                counts[name] = np.zeros(SLOTS, np.int64)
            found, n = np.unique(_slots(text.as_py()), return_counts=True)
            counts[name][found] += n
    for name, row in counts.items():
        used = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(row[used])], names=["lang", "slot", "n"]
        )


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on every row with a text and a language; tasks count first, so little is shuffled."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    counts = rows.mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most SLOTS rows per language
    names = tuple(sorted(found["lang"].unique()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((SLOTS, len(names)), SMOOTHING)
    table[found["slot"].to_numpy(int), [names.index(x) for x in found["lang"]]] += found["n"].to_numpy()
    return Model(names, (table / table.sum(axis=0)).astype(np.float32))


def _mixtures(chances: np.ndarray, counts: np.ndarray, starts: np.ndarray, allowed: np.ndarray):
    """Proportions and log-likelihood per document; rows of a document follow each other.

    chances: rows by languages; counts: of the rows; starts: first row of each document; allowed: documents
    by languages.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    which = np.repeat(np.arange(len(starts)), np.diff([*starts, len(counts)]))
    totals = np.add.reduceat(counts, starts)
    for _ in range(ROUNDS):
        parts = chances * share[which]
        parts *= (counts / parts.sum(axis=1))[:, None]
        share = np.add.reduceat(parts, starts, axis=0) / totals[:, None]
    likely = np.add.reduceat(counts * np.log(np.maximum((chances * share[which]).sum(axis=1), 1e-30)), starts)
    return share, likely


def choose(chances: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Language proportions of every document over its chosen set of languages (0 outside it)."""
    docs, langs = len(starts), chances.shape[1]
    single = np.add.reduceat(counts[:, None] * np.log(chances), starts, axis=0)
    best = single.argmax(axis=1)
    allowed = np.zeros((docs, langs), bool)
    allowed[np.arange(docs), best] = True
    share, likely = allowed.astype(np.float64), single.max(axis=1)
    totals = np.add.reduceat(counts, starts)
    penalty = 0.5 * np.log(np.maximum(totals, 2)) + 1.0
    open_ = np.ones(docs, bool)
    ends = np.append(starts[1:], len(counts))
    while open_.any() and allowed.sum(axis=1).min() < langs:
        # the mixture over all languages says which one is worth adding next
        at = np.flatnonzero(open_)
        rows = np.concatenate([np.arange(starts[i], ends[i]) for i in at])
        firsts = np.cumsum([0, *(ends[at] - starts[at])[:-1]])
        full, _ = _mixtures(chances[rows], counts[rows], firsts, np.ones((len(at), langs)))
        full[allowed[at]] = -1
        wider = allowed[at].copy()
        wider[np.arange(len(at)), full.argmax(axis=1)] = True
        new, more = _mixtures(chances[rows], counts[rows], firsts, wider.astype(float))
        better = (more - likely[at] > penalty[at]) & (wider.sum(axis=1) > allowed[at].sum(axis=1))
        took = at[better]
        allowed[took], share[took], likely[took] = wider[better], new[better], more[better]
        open_[at[~better]] = False
        open_ &= allowed.sum(axis=1) < langs
    return share


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(batch.num_columns - 1)]
            names, scores, mixtures = [UNKNOWN] * len(texts), np.zeros(len(texts)), [""] * len(texts)
            pending: list[int] = []
            found: list[np.ndarray] = []
            numbers: list[np.ndarray] = []

            def settle():
                if not pending:
                    return
                starts = np.cumsum([0, *map(len, found)][:-1])
                share = choose(model.chances[np.concatenate(found)].astype(np.float64), np.concatenate(numbers), starts)
                for doc, row in zip(pending, share, strict=True):
                    names[doc], scores[doc] = model.languages[row.argmax()], min(1.0, float(row.max()))
                    order = [k for k in np.argsort(-row) if row[k] > 0]
                    mixtures[doc] = ",".join(f"{model.languages[k]}:{row[k]:.4f}" for k in order)
                for kept in (pending, found, numbers):
                    kept.clear()

            for i, text in enumerate(texts):
                if not model.languages or not _has_letter(text):
                    continue
                slots, n = np.unique(_slots(text), return_counts=True)
                if not len(slots):
                    continue
                pending.append(i)
                found.append(slots)
                numbers.append(n.astype(np.float64))
                if sum(map(len, found)) > 1 << 17:
                    settle()
            settle()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names), pa.array(scores), pa.array(mixtures)],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "mixture"],
            )

    return predict


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but those replaced) with lang_pred, score (share of that language)
    and mixture (`lang:share` of the chosen set, largest first).

    `und` with score 0 for a NULL text, one without letters, or a model without languages. Only the text is
    an input of the prediction. Repeated rows get equal results; empty tables stay empty.
    """
    kept = [c for c in (keep or df.columns) if c not in ("lang_pred", "score", "mixture")]
    rows = df.select(*kept, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predictor(model), f"{schema}, lang_pred string, score double, mixture string")


def held_out(key: Column) -> Column:
    """A fixed third of the keys, which training leaves out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
