"""I-Match fingerprints: hashes of the sorted, distinct mid-frequency terms of a document, taken
over several randomised subsets of the lexicon.

DataFrame expressions and joins only. A term is a lower-cased run of letters and digits; its identity is
its 64-bit hash. Document frequencies are counted term by term. The lexicon keeps the terms whose inverse document
frequency, divided by that of a term seen once, lies in a band; it is a staged table that may grow with the vocabulary. While it has at most `LOCAL_TERMS`
terms, tasks look the terms of a text up in a hash table that every stage gets once, without a shuffle. A larger lexicon is
joined with the terms of the texts; both ways give the same fingerprints. Terms above the band by frequency stay in the
table, marked: they are few (a text's number of terms times n to the power 0.2, for n documents), and are taken out before
the join because all texts hold them.

A fingerprint has four hex digits per subset. Subsets come in levels: level 0 is the whole
lexicon, every later level cuts it at random into four times as many parts and uses up to twelve of
them. Long texts agree on small parts of the lexicon where a short edit spoils the large ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.session import stage

BAND = (0.2, 0.8)
#: With fewer terms in the band a document uses all its terms.
LEAST_TERMS = 5
LEVELS = 6
PARTS = 12
#: A level counts as if it had this many non-empty subsets at least.
LEAST_PARTS = 3
DIGITS = 4
NONE = "-" * DIGITS
#: Terms of the band that tasks may hold: about 15 bytes each.
LOCAL_TERMS = 1 << 20
#: Terms in a slot of their hash table, on average.
SLOT_TERMS = 4
#: Frequent terms that may be broadcast.
FREQUENT_TERMS = 1 << 20


def _subsets(level: int) -> int:
    return min(4**level, PARTS)


def _place(level: int) -> int:
    """Lowest bit of a term's hash that tells its part on a level."""
    return 63 - 8 * level


def _bits(level: int, skip: int = 0) -> str:
    """The bits of hash ``h`` that tell a term's part on a level, but the lowest ``skip``, in their place."""
    return f"(h & {((4**level - 1) >> skip << skip) << _place(level)}L)"


def _terms(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def _hashed(text: Column) -> Column:
    return F.transform(_terms(text), lambda t: F.xxhash64(t))


def document_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """(term, df) over all texts, a term by its hash; counted on the map side first."""
    return df.select(F.explode(_hashed(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lexicon(df: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(term, frequent), staged: the terms in the band, and as ``frequent`` those in too many documents for it.

    An empty table gives an empty lexicon, one with a single document has no term in the band.
    """
    n = df.count()
    ratio = F.log(F.lit(float(max(n, 1))) / F.col("df")) / F.log(F.lit(float(max(n, 2))))
    kept = document_frequencies(df, text).filter(ratio <= band[1])
    return stage(kept.select("term", (ratio < band[0]).alias("frequent")), "lexicon")


def _table(words: DataFrame, slots: int) -> DataFrame:
    """One row with the terms of the band by ``slots`` slots of their hash, for a lexicon of at most `LOCAL_TERMS`."""
    slot = F.col("term").bitwiseAND(F.lit(slots - 1))
    filled = words.filter("not frequent").groupBy(slot.alias("id")).agg(F.collect_list("term").alias("terms"))
    every = words.sparkSession.range(0, slots, 1, 4).join(filled, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))))
    return every.agg(F.transform(ordered, lambda s: s["terms"]))


def _with_band(df: DataFrame, words: DataFrame, whole: Column, kept: list[str], local_terms: int) -> DataFrame:
    """``kept`` columns, all distinct terms as ``__all`` and those in the band as ``__band``."""
    sizes = words.agg(F.count_if(F.col("frequent")).alias("f"), F.count_if(~F.col("frequent")).alias("n")).first()
    if sizes["n"] <= local_terms:
        slots = 1 << (sizes["n"] // SLOT_TERMS).bit_length()
        held = df.select(*kept, _hashed(whole).alias("__all"), _table(words, slots).scalar().alias("__table"))
        # terms and table are named once each, so both selects become one and no row carries the table
        both = F.transform(F.array("__all"), lambda every: F.struct(every.alias("all"), F.filter(every, lambda t: F.array_contains(
            F.get(F.col("__table"), t.bitwiseAND(F.lit(slots - 1)).cast("int")), t)).alias("band")))[0]
        return held.select(*kept, both.alias("__both")).select(*kept, F.col("__both.all").alias("__all"), F.col("__both.band").alias("__band"))
    # equal texts have equal terms, so 128 bits of the text stand for the row
    keys = [F.xxhash64(whole).alias("__k1"), F.xxhash64(F.lit("second"), whole).alias("__k2")]
    terms = df.select(*keys, F.explode(_hashed(whole)).alias("term"))
    frequent = words.filter("frequent").select("term")
    if sizes["f"] <= FREQUENT_TERMS:
        frequent = F.broadcast(frequent)
    banded = terms.join(frequent, "term", "left_anti").join(words.filter("not frequent"), "term")
    banded = banded.groupBy("__k1", "__k2").agg(F.collect_set("term").alias("__band"))
    found = df.select(*kept, _hashed(whole).alias("__all"), *keys).join(banded, ["__k1", "__k2"], "left")
    return found.withColumn("__band", F.coalesce("__band", F.array().cast("array<bigint>")))


def with_fingerprint(
    df: DataFrame, words: DataFrame, text: str, into: str, local_terms: int = LOCAL_TERMS
) -> DataFrame:
    """``df`` with the fingerprint of a text column, by the lexicon ``words``.

    NULL counts as an empty text; a text without terms has a fingerprint of dashes only. Equal
    texts have equal fingerprints. Other columns pass through; ``into`` is replaced. A lexicon with
    more than ``local_terms`` terms in the band is joined.
    """
    kept = [c for c in df.columns if c != into]
    found = _with_band(df, words, F.coalesce(F.col(text), F.lit("")), kept, local_terms)
    found = found.select(
        *kept, F.sort_array(F.when(F.size("__band") < LEAST_TERMS, F.col("__all")).otherwise(F.col("__band"))).alias("__l0"),
    )
    # lists of the terms in the used parts of a level, where parts are many cut into runs of four parts, then into parts
    lists = {f"__l{i}": f"filter(__l0, h -> {_bits(i)} < {_subsets(i) << _place(i)}L)" for i in range(3, LEVELS)}
    found = found.select(*kept, "__l0", *[F.expr(e).alias(name) for name, e in lists.items()])
    runs = {f"__l{i}_{k}": f"filter({f'__l{i}' if i > 2 else '__l0'}, h -> {_bits(i, 2)} = {k << _place(i) + 2}L)"
            for i in range(2, LEVELS) for k in range(_subsets(i) // 4)}
    found = found.select(*kept, "__l0", *[F.expr(e).alias(name) for name, e in runs.items()])
    subsets = ["__l0", *[f"filter({f'__l{i}_{k // 4}' if i > 1 else '__l0'}, h -> {_bits(i)} = {k << _place(i)}L)"
                         for i in range(1, LEVELS) for k in range(_subsets(i))]]
    one = f"if(size(terms) = 0, '{NONE}', lpad(right(hex(xxhash64(terms)), {DIGITS}), {DIGITS}, '0'))"
    return found.select(*kept, F.expr(f"array_join(transform(array({', '.join(subsets)}), terms -> {one}), '')").alias(into))


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprint columns, 0 to 1.

    Equal fingerprints have 1. Otherwise the largest share, over the levels, of subsets with equal
    hashes among those that are not empty in both.
    """
    shares, start = [], 0
    for i in range(LEVELS):
        at = f"sequence({start}, {start + _subsets(i) - 1})"
        x = f"substring(`{a}`, k * {DIGITS} + 1, {DIGITS})"
        y = f"substring(`{b}`, k * {DIGITS} + 1, {DIGITS})"
        same = f"size(filter({at}, k -> {x} = {y} and {x} <> '{NONE}'))"
        used = f"size(filter({at}, k -> {x} <> '{NONE}' or {y} <> '{NONE}'))"
        shares.append(f"{same} / greatest({used}, {LEAST_PARTS if i else 1})")
        start += _subsets(i)
    most = f"greatest({', '.join(shares)})"
    return F.expr(f"case when `{a}` = `{b}` then 1D else cast({most} as double) end")
