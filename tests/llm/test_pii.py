import hashlib
import re
import time

import pytest

from sievewright.llm import pii

ODD = [
    None, "", " ", "a@b.c@d.e a@b.c_x@y.zz", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "01.002.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-5678", "+1", "+1 2", "é😀 a@b.cc 😀 +33 1 23 45 67 89",
    "9" * 40, "1 " * 30, "a" * 50_000, "a." * 20_000 + "@", "7" * 30_000, "mail a@b.c, 10.0.0.1; a@b.c",
    "account DE89 3704 0044 0532 0130 00 end", "DE89370400440532013001", "ssn 123-45-6789", "123-45-6789",
    "call 030 1234 5678", "030 1234 5678", "+1 234 567 8901 a@1.2.3.4",
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    text = text or ""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        if kind == "email" and "@" not in text or kind == "ip" and "." not in text:
            continue  # the plain pattern takes long on long runs
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def test_base_spans_equal_the_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(ODD) if t is None or len(t) < 45_000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["pii"] for r in pii.find_spans(df).collect()}
    for i, t in rows:
        base = [(x["start"], x["rank"], x["kind"], x["end"]) for x in got[i] if x["rank"] < 4]
        assert base == ([] if t and t.startswith("a.a.") else brute(t)), t


def test_added_kinds_need_checksum_or_context(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {ODD[r["doc_id"]]: [x["kind"] for x in r["pii"] if x["rank"] >= 4] for r in pii.find_spans(df).collect()}
    assert got["account DE89 3704 0044 0532 0130 00 end"] == ["iban"]
    assert got["DE89370400440532013001"] == []
    assert got["ssn 123-45-6789"] == ["ssn"] and got["123-45-6789"] == []
    assert got["call 030 1234 5678"] == ["tel"] and got["030 1234 5678"] == []


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "é a@b.cc, 10.0.0.1!", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, pii int")
    got = sorted(map(tuple, pii.redact(df).collect()))
    assert got == [(1, "é [EMAIL], [IP]!", 5), (2, None, 6), (3, "", 7)]


@pytest.mark.parametrize("rows", [[], [(1, "a@b.c", 2), (1, "a@b.c", 2)]])
def test_empty_tables_and_repeated_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    assert len(pii.find_spans(df).collect()) == len(rows)


def test_query_against_plain_patterns(spark):
    from sievewright.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.QUERIES["op7_pii"](spark, sf_dir).collect():
        base = brute(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[2] == k for x in base) for k in pii.BASE]


def added(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {texts[r["doc_id"]]: [texts[r["doc_id"]][x["start"] : x["end"]] for x in r["pii"] if x["rank"] >= 4] for r in pii.find_spans(df).collect()}


def test_account_numbers_end_where_their_country_says(spark):
    want = {
        "IBAN BE68 5390 0754 7034 BIC GEBABEBB": ["BE68 5390 0754 7034"],
        "AT61 1904 3002 3457 3201 BIC": ["AT61 1904 3002 3457 3201"],
        "BE68539007547034 BIC": ["BE68539007547034"], "BE68539007547034 2024 and more": ["BE68539007547034"],
        "BE68 5390 0754 7034 AT61 1904 3002 3457 3201": ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201"],
        "DE89 3704 0044 0532 0130 00 EUR": ["DE89 3704 0044 0532 0130 00"], "NO93 8601 1117 947 NOK": ["NO93 8601 1117 947"],
        "MT84 MALT 0110 0001 2345 MTLC AST0 01S": ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"],
        "BE68 5390 0754 7035 BIC": [], "BE685390075470341": [], "ZZ68 5390 0754 7034": [], "BE68 5390 0754": [],
    }
    assert added(spark, list(want)) == want


def test_context_after_a_span_counts(spark):
    want = {
        "123-45-6789 is my SSN": ["123-45-6789"], "030 1234 5678 (phone)": ["030 1234 5678"],
        "123-45-6789" + " x" * 24 + " SSN": [], "123-45-6789 is a part number": [],
    }
    assert added(spark, list(want)) == want


LONG = {"numbers": "12, " * 260_000, "mails": "ab@cd.ef, " * 105_000, "no spaces": "é1.2.3.4;" * 100_000}


@pytest.mark.parametrize("kind", LONG)
def test_thousands_of_matches_in_one_text(spark, kind):
    """A text of a million characters takes seconds, and its spans lie where the plain patterns find them."""
    df = spark.createDataFrame([(1, LONG[kind])], "doc_id long, text string")
    started = time.time()
    (row,) = pii.find_spans(df).collect()
    assert time.time() - started < 15
    got = [(x["start"], x["rank"], x["kind"], x["end"]) for x in row["pii"] if x["rank"] < 4]
    assert got == brute(LONG[kind])


def test_redaction_of_a_long_text(spark):
    rows = [(1, "é ab@cd.ef, " * 30_000 + "end"), (2, "x" * 5000 + " 10.0.0.1 " + "y" * 5000), (3, "card 4111 1111 1111 1111, a@1.2.3.4 end")]
    got = dict(pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[1] == "é [EMAIL], " * 30_000 + "end"
    assert got[2] == "x" * 5000 + " [IP] " + "y" * 5000
    assert got[3] == "card [CARD], [EMAIL] end"  # the address within the mail goes with it


@pytest.mark.parametrize("n", [1, 63, 64, 65, 4096, 4097, 9000])
def test_running_values(spark, n):
    from itertools import accumulate

    from pyspark.sql import functions as F

    numbers = [(i * 7919) % 101 for i in range(n)]
    df = spark.createDataFrame([(numbers,)], "n array<int>")
    sums, highs = df.select(F.expr(pii._running("n", pii._sum)), F.expr(pii._running("n", pii._highest))).first()
    assert sums == list(accumulate(numbers)) and highs == list(accumulate(numbers, max))
