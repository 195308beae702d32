"""Web archives with a two-level capture index.

Every page becomes a record of a WARC/1.1 file, one gzip member each. Index lines, keyed by the URL with its host
reversed, are sorted into zlib-compressed blocks; the end of an index file holds the sparse directory: first key,
offset and length of its blocks. A look-up finds the index files whose key range holds a URL, binary-searches
the directory, reads and opens one block (more if captures of one key go on), and then reads the byte range of each record.

Tasks write files of their own name and return what they wrote; only files named in that (staged)
table count, so a repeated or abandoned attempt leaves nothing that is read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import sys
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.session import stage, staging_root

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shorter payloads are stored again rather than referred to.
LEAST_BYTES = 100
LINES = 256
OPEN_FILES = 32
DATE = "2000-01-01T00:00:00Z"  # the tables have no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TAIL = "<QQ"  # place and length of the directory
_CONTROL = re.compile(r"[\x00-\x20\x7f\ud800-\udfff]")


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, then port, path and query; no scheme, user or fragment.

    A NULL URL has the empty key; what is no URL is its own key. Blanks and control characters are
    percent-encoded, so a key is one word.
    """
    if url is None:
        return ""
    plain = _CONTROL.sub(lambda m: quote(m[0], errors="surrogatepass"), url)
    try:
        parts = urlsplit(plain)
        host, port = parts.hostname, parts.port
    except ValueError:
        return plain
    if not host:
        return plain
    shown = "" if port in (None, 80, 443) else f":{port}"
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.strip('.').split('.')))}{shown}){parts.path or '/'}{query}"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; ``refers_to`` (a page id) makes it a revisit, which leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = "" if url is None else _CONTROL.sub(lambda m: quote(m[0], errors="surrogatepass"), url)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if target else []), f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of an unpacked record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = fields["WARC-Record-ID"].removeprefix("<urn:x-page:").removesuffix(">")
    refers = fields.get("WARC-Refers-To", "").removeprefix("<urn:x-page:").removesuffix(">")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record of page {page} is damaged")
    return {
        "page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"),
        "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": length,
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(refers) if refers else None,
    }


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        name, out, at = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            keys, ids, offsets, lengths = [], [], [], []
            for page, url, payload, digest, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = pack.compress(record(page, url, payload, digest, refers)) + pack.flush()
                out.write(member)
                keys.append(url_key(url).encode("utf-8", "surrogatepass"))
                ids.append(page)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array([name] * len(ids), pa.string()),
                 pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["key", "page_id", "file", "at", "length"],
            )
        if out is not None:
            out.close()

    return write


def _index_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted lines of one key range become one index file with its directory at the end."""
        files, root = _open(folder)
        name, out, at = f"index-{uuid.uuid4().hex}.cdx", None, 0
        lines: list[bytes] = []
        directory: list[bytes] = []
        first = last = None

        def close_block():
            nonlocal at
            packed = zlib.compress(b"\n".join(lines), 6)
            out.write(packed)
            directory.append(b"%b\t%d\t%d" % (lines[0].split(b"\t", 1)[0], at, len(packed)))
            at += len(packed)
            lines.clear()

        for batch in batches:
            for key, page, file, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    out, first = files.open_output_stream(f"{root}/{name}", compression=None), key
                last = key
                lines.append(b"%b\t%b\t%b\t%d\t%d" % (key, b"" if page is None else b"%d" % page, file.encode(), offset, length))
                if len(lines) == LINES:
                    close_block()
        if out is None:
            return
        if lines:
            close_block()
        packed = zlib.compress(b"\n".join(directory), 6)
        out.write(packed + struct.pack(_TAIL, at, len(packed)))
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([len(directory)], pa.int64())],
            names=["index", "low", "high", "blocks"],
        )

    return write


class _Files:
    """A bounded set of open files, read by ranges."""

    def __init__(self, folder: str):
        self.files, self.root = _open(folder)
        self.held: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def read(self, name: str, at: int, length: int) -> bytes:
        if name not in self.held:
            if len(self.held) >= OPEN_FILES:
                self.held.popitem(last=False)[1].close()
            self.held[name] = self.files.open_input_file(f"{self.root}/{name}")
        self.held.move_to_end(name)
        return self.held[name].read_at(length, at)

    def size(self, name: str) -> int:
        return self.files.get_file_info(f"{self.root}/{name}").size


class IndexFile:
    """Captures of a key in one index file."""

    def __init__(self, files: _Files, name: str):
        self.files, self.name = files, name
        at, length = struct.unpack(_TAIL, files.read(name, files.size(name) - struct.calcsize(_TAIL), struct.calcsize(_TAIL)))
        entries = [e.split(b"\t") for e in zlib.decompress(files.read(name, at, length)).split(b"\n")]
        self.keys = [e[0] for e in entries]
        self.places = [(int(e[1]), int(e[2])) for e in entries]
        self.opened: tuple[int, list[list[bytes]], list[bytes]] = (-1, [], [])

    def _block(self, i: int) -> tuple[list[list[bytes]], list[bytes]]:
        if self.opened[0] != i:
            lines = [x.split(b"\t") for x in zlib.decompress(self.files.read(self.name, *self.places[i])).split(b"\n")]
            self.opened = (i, lines, [x[0] for x in lines])
        return self.opened[1:]

    def captures(self, key: bytes) -> Iterator[tuple[str, int, int]]:
        # the block before the first one that starts at the key can end with it
        i = max(0, bisect.bisect_left(self.keys, key) - 1)
        while i < len(self.keys) and self.keys[i] <= key:
            lines, keys = self._block(i)
            for j in range(bisect.bisect_left(keys, key), len(keys)):
                if keys[j] != key:
                    return
                yield lines[j][2].decode(), int(lines[j][3]), int(lines[j][4])
            i += 1


class Archive:
    """Pages written as archives, with their index."""

    def __init__(self, spark: SparkSession, folder: str, shelves: list[tuple[str, bytes, bytes]]):
        self.spark, self.folder, self.shelves = spark, folder, shelves

    def fetch(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """Records of all captures of the URLs: page_id, url, payload, payload_bytes, payload_digest, record_type,
        refers_to. A URL that was never captured gives no row; URLs that differ in scheme or fragment are one.
        """
        lows = [low for _, low, _ in self.shelves]
        highs = [high for _, _, high in self.shelves]
        folder, names = self.folder, [name for name, _, _ in self.shelves]

        def route(batches):
            for batch in batches:
                keys, to = [], []
                for value in batch.column(0).to_pylist():
                    key = url_key(value).encode("utf-8", "surrogatepass")
                    # key ranges are sorted and touch at most at their ends
                    for i in range(bisect.bisect_left(highs, key), bisect.bisect_right(lows, key)):
                        keys.append(key)
                        to.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(to, pa.int32())], names=["key", "shelf"])

        def read(batches):
            files, opened = _Files(folder), (None, None)
            for batch in batches:
                rows: list[dict] = []
                held = 0
                for key, shelf in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if opened[0] != shelf:
                        opened = (shelf, IndexFile(files, names[shelf]))
                    for file, at, length in opened[1].captures(key):
                        rows.append(parse_record(zlib.decompress(files.read(file, at, length), 31)))
                        held += rows[-1]["payload_bytes"]
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD)

        wanted = urls.select(F.col(url).cast("string")).mapInArrow(route, "key binary, shelf int").distinct()
        ordered = wanted.repartition("shelf").sortWithinPartitions("shelf", "key")
        return ordered.mapInArrow(
            read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string,"
            " record_type string, refers_to long",
        )


RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def write_archive(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    """Write every row as a record, and the index.

    Of records with equal payloads of at least `LEAST_BYTES` bytes, that with the smallest key is a response and the others
    revisit it; smaller ones are all responses. A NULL payload is empty. Rows with the smallest key itself are
    all responses; a NULL key revisits if any row of its group has a key. An empty table gives an archive without
    files. Other columns are not stored.
    """
    spark = df.sparkSession
    folder = f"{staging_root(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    pages = df.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    groups = pages.filter(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    owners = stage(groups.filter("n > 1 and first is not null").select("digest", "first"), "owners")
    told = pages.join(owners, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )
    lines = stage(told.mapInArrow(_writer(folder), "key binary, page_id long, file string, at long, length long"), "captures")
    order = ["key", "page_id", "file", "at"]
    shelves = stage(
        lines.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_index_writer(folder), "index string, low binary, high binary, blocks long"),
        "shelves",
    )
    # one row per index file
    found = sorted(((bytes(r["low"]), bytes(r["high"]), r["index"]) for r in shelves.collect()))
    return Archive(spark, folder, [(name, low, high) for low, high, name in found])
