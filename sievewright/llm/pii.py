"""Personal data: proposed by patterns, confirmed by validators, scored by nearby words.

DataFrame expressions only. A pattern proposes leftmost, non-overlapping spans; validators (Luhn, mod 97, ranges,
digit counts) drop failing proposals without a retry. Splitting the text at the same pattern gives the gaps between the
matches, and running sums of lengths, made in parts, give code-point positions where a match is valid. An IBAN
proposal is first cut to the length that its country has registered. Words in the `WINDOW` code points before or after a
span raise its score.

Quantifiers are possessive and starts inside a run are excluded, which leaves the matches as they
are but keeps the search linear in the length of a text. Nothing is looked up by position in a whole text, and no array
grows match by match over a whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 48
KEEP = 0.6

# fixed values: patterns of the base kinds, in the order in which they are listed
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# fixed values: countries by the length of their account numbers, registered or in use without being registered
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _grouped(n: int) -> str:
    """Pattern of the ``n`` characters after country and check digits, in groups of four or without spaces."""
    rest = f"(?:\\x20?[A-Z0-9]{{{n % 4}}})" if n % 4 else ""
    return f"(?:\\x20?[A-Z0-9]{{4}}){{{n // 4}}}{rest}"


# each country takes exactly its length and leaves what follows to the text; a country that is not listed takes all groups.
# The lookahead spares other places the list.
_LISTED = "|".join(names.replace(" ", "|") for names in IBAN_LENGTHS.values())
_IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(
    f"(?:{names.replace(' ', '|')})[0-9]{{2}}{_grouped(n - 4)}" for n, names in IBAN_LENGTHS.items()
) + rf"|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+(?:\x20?[A-Z0-9]{{1,3}})?+)(?![A-Za-z0-9])"

# kinds that the method adds
ADDED = {
    "iban": _IBAN,
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+().-])\(?0[0-9]{2,4}\)?[\x20/-][0-9]{3,4}(?:[\x20-]?[0-9]{2,4}){1,2}+(?![0-9])",
}
KINDS = [*BASE, *ADDED]
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel|write to)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security|taxpayer)\b",
    "tel": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono|rufnummer)\b",
}
#: Score of a proposal whose validator agrees; nearby words add `BONUS`.
PRIOR = {"email": 0.8, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "tel": 0.3}
BONUS = 0.2
BONUS_WEAK = 0.4  # for kinds without a checksum

_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
# letters become 10 … 35, the first four characters go last; the remainder is taken in steps
_MOD97 = """aggregate(split(concat(substring(regexp_replace(x.v, ' ', ''), 5), substring(x.v, 1, 4)), ''), 0, (r, c) ->
    case when c = '' then r when c between '0' and '9' then (r * 10 + cast(c as int)) % 97
         else (r * 100 + ascii(c) - 55) % 97 end) = 1"""
VALID = {
    "email": "true",
    "ip": r"forall(split(x.v, '\\.'), p -> coalesce(try_cast(p as bigint) <= 255, false))",
    "card": f"length({_DIGITS}) between 14 and 19 and luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 10 and 15",
    "iban": _MOD97,
    "ssn": "substring(x.v, 1, 3) not in ('000', '666') and substring(x.v, 1, 1) <> '9'"
           " and substring(x.v, 5, 2) <> '00' and substring(x.v, 8, 4) <> '0000'",
    "tel": f"length({_DIGITS}) between 9 and 12",
}


#: Code points of a chunk of text, and numbers of a part of running values: a text is reached by chunk, never from its start.
CHUNK = 1024
PART = 64
_CHUNKS = f"regexp_extract_all(__t, r'(?s).{{1,{CHUNK}}}', 0)"


def _sum(a: str, x: str) -> str:
    return f"{a} + {x}"


def _highest(a: str, x: str) -> str:
    return f"greatest({a}, {x})"


def _running(numbers: str, step: Callable[[str, str], str], levels: int = 2) -> str:
    """Running values of an array of numbers, from 0 by ``step`` (`_sum` or `_highest`).

    An accumulated array is copied at every step, so only parts of `PART` numbers are accumulated; what parts start with
    comes from the running values of the parts' own results, in the same way.
    """

    def steps(array: str, start: str) -> str:
        return f"""aggregate({array}, named_struct('at', {start}, 'out', cast(array() as array<int>)),
            (s, x) -> named_struct('at', {step("s.at", "x")}, 'out', concat(s.out, array({step("s.at", "x")}))), s -> s.out)"""

    if levels == 0:
        return steps(numbers, "0")
    n, p, e = f"n{levels}", f"p{levels}", f"e{levels}"
    results = f"transform({p}, y -> aggregate(y, 0, (a, x) -> {step('a', 'x')}))"
    return f"""transform(array({numbers}), {n} -> transform(
        array(transform(sequence(0, int((size({n}) - 1) div {PART})), i -> slice({n}, i * {PART} + 1, {PART}))), {p} ->
        transform(array({_running(results, step, levels - 1)}), {e} ->
            flatten(transform({p}, (y, i) -> {steps("y", f"coalesce(get({e}, i - 1), 0)")})))[0])[0])[0]"""


def _between(start: str, end: str) -> str:
    """The text between two positions (``start`` not after ``end``), from the chunks `__c` that hold it."""
    first = f"int({start} div {CHUNK})"
    return (f"substring(array_join(slice(__c, {first} + 1, int({end} div {CHUNK}) - {first} + 1), ''),"
            f" {start} - {first} * {CHUNK} + 1, {end} - {start})")


def _placed(kind: str) -> Column:
    """Spans of a kind from its matches, the gaps between them and the numbers (i) and values (v) of the valid ones."""
    rank = KINDS.index(kind)
    score = f"{PRIOR[kind]}D"
    bonus = BONUS_WEAK if kind in ("ssn", "tel") else BONUS
    windows = (_between(f"greatest(0, x.s - {WINDOW})", "x.s"), _between("x.e", f"(x.e + {WINDOW})"))
    near = " or ".join(f"{side} rlike r\"{CONTEXT[kind]}\"" for side in windows)
    lengths = f"zip_with(__m_{kind}, __g_{kind}, (m, g) -> coalesce(length(m), 0) + coalesce(length(g), 0))"
    return F.expr(f"""transform(flatten(transform(array({_running(lengths, _sum)}), ends ->
        transform(__v_{kind}, x -> named_struct('s', get(ends, x.i) - length(x.v), 'e', get(ends, x.i))))),
      x -> named_struct('start', x.s, 'rank', {rank}, 'kind', '{kind}', 'end', x.e,
                        'score', round({score} + if({near}, {bonus}D, 0D), 2)))""")


def find_spans(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``df`` with an array column ``into`` of (start, rank, kind, end, score), by start then kind.

    Positions count code points, ends are exclusive. A NULL text counts as empty; text without
    personal data gives an empty array. Base kinds are kept whenever their validator agrees; added
    kinds when their score reaches `KEEP`. Repeated rows give repeated results, other columns pass
    through (a column named as ``into`` is replaced).
    """
    kept = [c for c in df.columns if c != into]
    patterns = BASE | ADDED
    source = F.coalesce(F.col(text), F.lit(""))
    found = df.select(*kept, source.alias("__t")).select(
        *kept, "__t",
        *[F.regexp_extract_all("__t", F.lit(p), F.lit(0)).alias(f"__m_{k}") for k, p in patterns.items()],
    )
    valid = found.select(
        "*",
        *[
            F.expr(f"filter(transform(__m_{k}, (v, i) -> named_struct('i', i, 'v', v)), x -> {VALID[k].strip()})").alias(f"__v_{k}")
            for k in KINDS
        ],
    )
    some = F.expr(" or ".join(f"size(__v_{k}) > 0" for k in KINDS))
    gaps = valid.select(
        "*",
        F.when(some, F.expr(_CHUNKS)).alias("__c"),
        *[F.when(F.size(f"__v_{k}") > 0, F.split("__t", F.lit(p), -1)).alias(f"__g_{k}") for k, p in patterns.items()],
    )
    placed = gaps.select(
        *kept,
        *[
            F.when(F.size(f"__v_{k}") > 0, _placed(k)).otherwise(
                F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>")
            ).alias(f"__s_{k}")
            for k in KINDS
        ],
    )
    added = [F.filter(f"__s_{k}", lambda x: x["score"] >= KEEP) for k in ADDED]
    spans = F.array_sort(F.concat(*[F.col(f"__s_{k}") for k in BASE], *added))
    return placed.select(*kept, spans.alias(into))


def joined(spans: Column | str) -> Column:
    """`kind:start:end` of the spans, separated by commas."""
    one = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return F.array_join(one, ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` whose ``text`` has `[KIND]` in place of every span; overlapping spans become one.

    Texts without spans, NULL and empty ones stay as they are.
    """
    found = find_spans(df, text, "__spans").withColumn("__t", F.col(text))
    found = found.withColumn("__c", F.when(F.size("__spans") > 0, F.expr(_CHUNKS)))
    reach = found.withColumn("__r", F.when(
        F.size("__spans") > 0, F.expr(_running("transform(__spans, x -> x.end)", _highest))))
    pieces = f"""flatten(transform(__spans, (x, i) -> if(x.start < coalesce(get(__r, i - 1), 0), cast(array() as array<string>),
        array({_between("coalesce(get(__r, i - 1), 0)", "x.start")}, concat('[', upper(x.kind), ']')))))"""
    rest = _between("element_at(__r, -1)", "length(__t)")
    clean = F.expr(f"concat(array_join({pieces}, ''), {rest})")
    return reach.withColumn(text, F.when(F.size("__spans") > 0, clean).otherwise(F.col(text))).select(*df.columns)
