"""Folder of delimited files to one table of strings.

Files are scanned once, split at any line, as raw bytes, and staged as lines. A quoted field may hold line breaks, so whether a
line begins a record depends on all lines before it: each line is a function of the quote state (within quotes or not)
at its block's start, and is staged with its answer for both states. Composing the blocks' functions in file order gives the
state at the start of each block (one row per block), which picks the answer. The same scan decides what a whole
file decides: its encoding and the position of its rows.
"""

from __future__ import annotations

import csv as csv_rows
import io
import posixpath
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions.names import mangle_header, tidy_names
from sievewright.functions.text import na_to_null
from sievewright.session import small_table, stage, stage_counted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CORRUPT = "_corrupt_record"
FILE_BITS = 40  # row_id = file number * 2^40 + line number; both stay positive BIGINTs
BYTES = "ISO-8859-1"  # maps every byte to one character and back
# UTF-8 can fail on a file; the single-byte charsets accept every file.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "latin-1": BYTES, "latin1": BYTES,
            "iso-8859-1": BYTES, "cp1252": "windows-1252"}


@dataclass(frozen=True)
class SourceFile:
    number: int
    part: int
    path: str
    name: str  # as in the file metadata, for a part with its folder's
    source: str
    header: tuple[str, ...]  # tidy or mangled names, one per field


def discover_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """Files of a folder in name order, not recursive; an error if there are none."""
    return [paths[0] for _, paths in _discover(spark, folder, pattern, False)]


def _discover(spark: SparkSession, folder: str, pattern: str, parts: bool) -> list[tuple[str, list[str]]]:
    """Names of the files of a folder, in their order, with their paths: one, or those of a folder's parts."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(f"folder not found: {folder}")

    def named(where, wanted: str, of) -> list:
        found = [s.getPath() for s in fs.listStatus(where) if of(s)]
        return sorted(((p.getName(), p) for p in found if fnmatch(p.getName(), wanted)), key=lambda x: x[0])

    files = [(n, [p.toString()]) for n, p in named(path, pattern, lambda s: s.isFile())]
    for n, p in named(path, pattern, lambda s: parts and s.isDirectory()):
        written = [x.toString() for _, x in named(p, "part-*", lambda s: s.isFile())]
        if not written:
            raise FileNotFoundError(f"no parts in {p.toString()}")
        files.append((n, written))
    if not files:
        raise FileNotFoundError(f"no {pattern} files in {folder}")
    return sorted(files)


def _first_line(spark: SparkSession, path: str) -> bytes:
    """The header bytes of one file; a few kilobytes, read by the driver."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, BYTES))
        line = reader.readLine()
        while line is not None and line.strip() == "":
            line = reader.readLine()
    finally:
        stream.close()
    if line is None:
        raise ValueError(f"no header in {path}")
    return line.encode("latin-1")


def _charset(name: str) -> str:
    if name.lower() not in CHARSETS:
        raise ValueError(f"unknown encoding {name!r}; use one of {sorted(CHARSETS)}")
    return CHARSETS[name.lower()]


def _decode(raw: bytes, encoding: str, fallback: str) -> str:
    try:
        return raw.decode(encoding).removeprefix("﻿")
    except UnicodeDecodeError:
        return raw.decode(fallback)


def _stem(name: str) -> str:
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def _sources(
    spark: SparkSession, found: list[tuple[str, list[str]]], encoding: str, fallback: str, tidy: bool, parts: bool
) -> list[SourceFile]:
    listed = [(number, part, name, path) for number, (name, paths) in enumerate(found) for part, path in enumerate(paths)]
    with ThreadPoolExecutor(16) as pool:
        lines = list(pool.map(lambda p: _first_line(spark, p), [p for *_, p in listed]))
    files = []
    for (number, part, name, path), raw in zip(listed, lines, strict=True):
        fields = next(csv_rows.reader(io.StringIO(_decode(raw, encoding, fallback))))
        names = mangle_header(fields)
        # file metadata columns carry the URI form of the name
        uri = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()
        files.append(
            SourceFile(number, part, path, "/".join(uri.split("/")[-1 - parts :]), _stem(name), tuple(tidy_names(names) if tidy else names))
        )
    return files


def _state_after(line: bytes, inside: int) -> int:
    """Whether a quoted field is open at the end of a line. Only a quote that begins a field opens one."""
    at = 0
    while True:
        if inside:
            close = line.find(b'"', at)
            if close < 0:
                return 1
            if line[close + 1 : close + 2] == b'"':  # a doubled quote is a quote
                at = close + 2
                continue
            at = close + 1
        elif at == 0 and line[:1] == b'"':
            at, inside = 1, 1
            continue
        opening = line.find(b',"', at)
        if opening < 0:
            return 0
        at, inside = opening + 2, 1


LINES = "_file string, _block bigint, _at bigint, _value binary, " + ", ".join(
    f"_kind{h} tinyint, _n{h} bigint, _end{h} tinyint" for h in (0, 1)
)
BLANK, FIRST, MORE = 0, 1, 2  # a line without content between records, a record's first line, a later one


def _quote_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind, number of records begun and state after each line, if its block begins outside or within quotes."""
    place, done, states, begun = None, 0, [0, 1], [0, 0]
    for batch in batches:
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        codes = pc.dictionary_encode(batch.column(1)).indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])][: batch.num_rows])
        for start, stop in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
            if place != (files[start], blocks[start]):
                place, done, states, begun = (files[start], blocks[start]), 0, [0, 1], [0, 0]
            part = batch.slice(start, stop - start)
            text = part.column(0).view(pa.string())  # byte-wise functions only
            n = len(text)
            blank = pc.equal(pc.ascii_trim_whitespace(text), "").to_numpy(zero_copy_only=False)
            quoted = np.flatnonzero(pc.greater_equal(pc.find_substring(text, '"'), 0).to_numpy(zero_copy_only=False))
            lines = part.column(0).take(pa.array(quoted)).to_pylist()
            columns = []
            for h in (0, 1):
                after, state = np.full(n, -1, np.int8), states[h]
                for at, line in zip(quoted.tolist(), lines, strict=True):
                    after[at] = state = _state_after(line, state)
                last = np.maximum.accumulate(np.where(after >= 0, np.arange(n), -1))
                end = np.where(last >= 0, after[last], states[h]).astype(np.int8)
                before = np.concatenate([[states[h]], end[:-1]])
                kind = np.where(before == 1, MORE, np.where(blank, BLANK, FIRST)).astype(np.int8)
                number = begun[h] + np.cumsum(kind == FIRST)
                states[h], begun[h] = int(end[-1]), int(number[-1])
                columns += [pa.array(kind), pa.array(number), pa.array(end)]
            at = pa.array(np.arange(done, done + n))
            done += n
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), at, part.column(0), *columns], names=[c.split()[0] for c in LINES.split(", ")]
            )


def _records(spark: SparkSession, files: list[SourceFile], parts: bool = False) -> DataFrame:
    """``(_file, _record, _text, source_file, _number, _ok)``: records of all files as single-byte text, without headers.

    ``_record`` counts a header for each file, however many parts it has.
    """
    name = F.substring_index("_metadata.file_path", "/", -2) if parts else F.col("_metadata.file_name")
    scanned = spark.read.option("lineSep", "\n").text([f.path for f in files]).select(
        F.col("value").cast("binary"), name.alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    lines = stage(scanned.mapInArrow(_quote_states, LINES), "ingest-lines")
    blocks = lines.groupBy("_file", "_block").agg(
        *[F.max(f"_n{h}").alias(f"_n{h}") for h in (0, 1)], *[F.max_by(f"_end{h}", "_at").alias(f"_end{h}") for h in (0, 1)],
        F.bool_and(F.is_valid_utf8("_value")).alias("_valid"),
    )
    # where each block of each file starts, and in which state; one row per block of input
    upto = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    swaps = (F.col("_end0") > F.col("_end1")).cast("int")
    counted = blocks.withColumn("_swaps", F.sum(swaps).over(upto)).withColumn(
        "_fixed", F.when(F.col("_end0") == F.col("_end1"), F.struct(F.col("_end0").alias("end"), "_swaps"))
    )
    fixed, turned = F.last("_fixed", ignorenulls=True).over(before), F.coalesce(F.sum(swaps).over(before), F.lit(0))
    entered = counted.withColumn("_last", fixed).withColumn(
        "_state", (F.coalesce("_last.end", F.lit(0)) + turned - F.coalesce("_last._swaps", F.lit(0))) % 2
    )

    def chosen(c: str):
        return F.when(F.col("_state") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))

    listed = small_table(
        spark, [(f.name, f.number, f.part, f.source) for f in files], "_file string, _number bigint, _part bigint, source_file string"
    )
    whole, part = Window.partitionBy("_number"), Window.partitionBy("_file")
    earlier = Window.partitionBy("_number").orderBy("_part", "_block").rowsBetween(Window.unboundedPreceding, -1)
    places = stage(
        entered.join(listed, "_file").select(
            "_file", "_block", "_state", "_number", "source_file", F.coalesce(F.sum(chosen("_n")).over(before), F.lit(0)).alias("_before"),
            (F.coalesce(F.sum(chosen("_n")).over(earlier), F.lit(0)) - F.col("_part")).alias("_earlier"),  # a header for each part before
            F.bool_and("_valid").over(whole).alias("_ok"), chosen("_end").alias("_open"), (F.max("_block").over(part) == F.col("_block")).alias("_last"),
        ), "ingest-blocks",
    )
    never = places.filter("_last and _open = 1").limit(1).collect()
    if never:
        raise ValueError(f"{never[0]['_file']}: a quoted field is not closed at the end of the file")
    single_byte = F.decode("_value", BYTES)
    placed = lines.join(places.drop("_open", "_last"), ["_file", "_block"]).filter(
        (chosen("_kind") != BLANK) & (F.col("_before") + chosen("_n") > 1)  # the first record is the header
    ).select(
        "_file", "_block", "_at", single_byte.alias("_line"), (F.col("_earlier") + chosen("_n")).alias("_record"), chosen("_kind").alias("_kind"),
        chosen("_end").alias("_end"), "_number", "source_file", "_ok",
    )
    alone = (F.col("_kind") == FIRST) & (F.col("_end") == 0)
    keys = ["_file", "_record", "source_file", "_number", "_ok"]
    parts = F.sort_array(F.collect_list(F.struct("_block", "_at", "_line")))
    joined = placed.filter(~alone).groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_line"]), "\n").alias("_line"))
    records = placed.filter(alone).select(*keys, "_line").unionByName(joined)
    return records.withColumn("_text", F.regexp_replace("_line", "\r$", "")).drop("_line")


def _parsed(records: DataFrame, files: list[SourceFile]) -> DataFrame:
    """Fields of the records of files with one header, as strings.

    Records with too many fields are dropped, short ones padded with NULL. The parser flags
    both, so a flagged record stays if it has fewer delimiters outside quotes than columns.
    """
    header = files[0].header
    columns = [f"c{i}" for i in range(len(header))]
    schema = ", ".join(f"{c} string" for c in [*columns, CORRUPT])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"'}  # a doubled quote inside quotes is a quote
    fields = records.filter(F.col("_file").isin([f.name for f in files])).withColumn("_f", F.from_csv("_text", schema, options))
    flagged = F.col(f"_f.{CORRUPT}")
    commas = F.regexp_count(F.regexp_replace(flagged, '"[^"]*"', ""), F.lit(","))
    return fields.filter(flagged.isNull() | (commas < len(columns))).select(
        *[F.col(f"_f.{c}").alias(n) for c, n in zip(columns, header, strict=True)], "_record", "_number", "source_file", "_ok",
    )


def read_folder(
    spark: SparkSession, folder: str, encoding: str = "utf-8", fallback_encoding: str = "latin-1",
    pattern: str = "*.csv", tidy: bool = True, parts: bool = False,
) -> DataFrame:
    """The frame of `read_folder_counted`."""
    return read_folder_counted(spark, folder, encoding, fallback_encoding, pattern, tidy, parts)[0]


def read_folder_counted(
    spark: SparkSession, folder: str, encoding: str = "utf-8", fallback_encoding: str = "latin-1",
    pattern: str = "*.csv", tidy: bool = True, parts: bool = False,
) -> tuple[DataFrame, int]:
    """All files of a folder by column name, as strings, with ``source_file`` and ``row_id``, and the number of rows.

    ``row_id`` grows with file name and record; records that are dropped keep their number. A file is decoded with ``encoding`` if all its
    bytes allow that, else with ``fallback_encoding``. NA texts are NULL. Files with different
    headers are united by (tidy) name, missing columns NULL. Quoted fields may hold line breaks; files are read in
    splits all the same. A quote inside an unquoted field is text. A file that ends within quotes is an error.

    With ``parts``, a folder named like a file, as a Spark job writes it, is one file as well: its ``part-`` files in name order, each with its
    header, records numbered through, one encoding for all.
    """
    strict, loose = _charset(encoding), _charset(fallback_encoding)
    files = _sources(spark, _discover(spark, folder, pattern, parts), encoding, fallback_encoding,
                     tidy, parts)
    by_header: dict[tuple, list[SourceFile]] = {}
    for f in files:
        by_header.setdefault(f.header, []).append(f)
    records = _records(spark, files, parts)
    scans = [_parsed(records, group) for group in by_header.values()]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    staged, rows = stage_counted(united, "ingest")
    names = [c for c in dict.fromkeys(n for f in files for n in f.header)]

    def decoded(name: str):
        text = F.col("`" + name.replace("`", "``") + "`")
        raw = F.encode(text, BYTES)
        if strict == "UTF-8":
            wide = F.when(F.col("_ok"), F.decode(raw, "UTF-8")).otherwise(
                text if loose == BYTES else F.decode(raw, loose)
            )
        else:
            wide = text if strict == BYTES else F.decode(raw, strict)
        # plain ASCII, the bulk of all cells, is the same in every charset
        return F.when(F.octet_length(text) == F.length(text), text).otherwise(wide)

    return staged.select(
        (F.shiftleft(F.col("_number"), FILE_BITS) + F.col("_record") - 2).alias("row_id"), "source_file",
        *[na_to_null(decoded(c)).alias(c) for c in names],
    ), rows


def file_sources(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """``(file_number, source_file)`` of a folder, from the list of its files alone."""
    names = [_stem(posixpath.basename(p)) for p in discover_files(spark, folder, pattern)]
    return small_table(spark, list(enumerate(names)), "file_number bigint, source_file string")


def source_names(df: DataFrame) -> DataFrame:
    """``(file_number, source_file)``; the number is also in the high bits of ``row_id``."""
    return df.select(
        F.shiftright("row_id", FILE_BITS).alias("file_number"), "source_file"
    ).distinct()


def ingest_statistics(df: DataFrame) -> DataFrame:
    """``(source_file, rows, columns)`` per file with a TOTAL row."""
    width = len([c for c in df.columns if c != "row_id"])
    return (
        df.rollup("source_file")
        .agg(F.count(F.lit(1)).alias("rows"), F.grouping("source_file").alias("_all"))
        .select(
            F.when(F.col("_all") == 1, F.lit("TOTAL")).otherwise(F.col("source_file")).alias(
                "source_file"
            ),
            "rows",
            F.lit(width).alias("columns"),
        )
    )
