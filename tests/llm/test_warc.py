import gzip
import hashlib
from pathlib import Path

import pytest

from sievewright.llm import warc


@pytest.mark.parametrize("url,key", [
    (None, ""), ("", ""), ("http://Blog.Example.COM:80/a?b=1#c", "com,example,blog)/a?b=1"), ("https://x.org", "org,x)/"),
    ("http://x.org:8080/", "org,x:8080)/"), ("no url", "no%20url"), ("http://[bad/", "http://[bad/"), ("http://u:p@é.fr/\n", "fr,é)/%0A"),
])
def test_keys(url, key):
    assert warc.url_key(url) == key


def expected(rows):
    first = {}
    for page, _, html in rows:
        if html and len(html.encode()) >= 100 and page is not None:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        to = first.get(html)
        to = None if to is None or to == page else to
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_pages_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    long, other = "ü" * 60, "b" * 100
    rows = [(i, f"http://h{i % 5}.example.org/p{i % 4}?q", [long, other, f"page {i}", None, ""][i % 5]) for i in range(40)]
    rows += [(100 + i, "http://hot.example.org/", long) for i in range(30)]
    rows += [(None, "http://n/", long), (None, None, None), (7, "http://again/", "b" * 99), (7, "http://again/", "b" * 99), (8, "x\ty z", other)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    archive = warc.write_archive(df)
    got = archive.fetch(df.select("url")).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    one = archive.fetch(spark.createDataFrame([("https://HOT.example.org/#x",), ("http://absent/",)], "url string"))
    assert one.count() == 30
    files = list(Path(archive.folder.removeprefix("file:")).glob("*.warc.gz"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == len(rows) and text.count(b"WARC-Type: revisit") == sum(r[3] == "revisit" for r in expected(rows))


def test_index_reads_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 2)
    rows = [(i, f"http://e.org/{i:04d}", f"page {i}") for i in range(200)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    files = warc._Files(archive.folder)
    seen = []
    read = files.read
    files.read = lambda name, at, length: seen.append(length) or read(name, at, length)
    found = [warc.IndexFile(files, n) for n, low, high in archive.shelves if low <= b"org,e)/0123" <= high]
    before = len(seen)
    assert [len(list(f.captures(b"org,e)/0123"))) for f in found] == [1]
    assert len(seen) - before <= 2  # at most two blocks are opened


def test_empty_table_and_damage(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    archive = warc.write_archive(df)
    assert archive.fetch(df.select("url")).collect() == []
    raw = warc.record(1, "http://x/", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parse_record(raw)["payload"] == b"abc"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(raw.replace(b"abc", b"abd"))
