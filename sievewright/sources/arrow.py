"""Folders of Arrow IPC files as a Spark data source.

Each task writes one file, under a name of its own; the driver then lists the files of the tasks that counted in
``_files.json``, with the number of their record batches and the table's schema. Only listed files are read, so what a failed or
repeated task left behind is never seen. A file is read in ranges of batches. Any program that reads Arrow files can
open the parts.

Paths go through Arrow's file systems (local, hdfs, s3, gs), as tasks have no access to those of Spark.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "arrow_ipc"
LISTING = "_files.json"
#: Record batches that a task reads, and rows that a batch holds at most.
BATCHES, BATCH_ROWS = 16, 65_536


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    batches: int


@dataclass
class Part(InputPartition):
    name: str
    first: int
    last: int


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        files, folder = _place(self.options["path"])
        listed = _listing(files, folder)
        if listed and listed["schema"]:
            return StructType.fromJson(listed["schema"])
        names = _names(files, folder, listed)
        if not names:
            raise ValueError(f"no Arrow files in {folder}")
        with files.open_input_file(f"{folder}/{names[0]}") as source:
            return from_arrow_schema(ipc.open_file(source).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], schema.jsonValue(), overwrite)


def _listing(files: fs.FileSystem, folder: str) -> dict | None:
    if files.get_file_info(f"{folder}/{LISTING}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{folder}/{LISTING}") as source:
        return json.loads(source.read())


def _names(files: fs.FileSystem, folder: str, listed: dict | None) -> list[str]:
    if listed:
        return [name for name, _ in listed["files"]]
    found = files.get_file_info(fs.FileSelector(folder))
    return sorted(f.base_name for f in found if f.is_file and f.extension in ("arrow", "feather"))


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        files, folder = _place(self.path)
        listed = _listing(files, folder)
        counts = dict(listed["files"]) if listed else {}
        parts = []
        for name in _names(files, folder, listed):
            if name not in counts:  # a file of another program
                with files.open_input_file(f"{folder}/{name}") as source:
                    counts[name] = ipc.open_file(source).num_record_batches
            parts += [Part(name, i, min(i + BATCHES, counts[name])) for i in range(0, counts[name], BATCHES)]
        return parts or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        files, folder = _place(self.path)
        with files.open_input_file(f"{folder}/{partition.name}") as source:
            reader = ipc.open_file(source)
            for i in range(partition.first, partition.last):
                yield reader.get_batch(i)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: dict, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _place(self.path)
        name, writer, sink, count = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.arrow", None, None, 0
        for batch in iterator:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                if writer is None:
                    files.create_dir(folder, recursive=True)
                    sink = files.open_output_stream(f"{folder}/{name}")
                    writer = ipc.new_file(sink, batch.schema, options=ipc.IpcWriteOptions(compression="lz4"))
                writer.write_batch(batch.slice(start, BATCH_ROWS))
                count += 1
        if writer is None:
            return Written(None, 0)
        writer.close()
        sink.close()
        return Written(name, count)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        files.create_dir(folder, recursive=True)
        before = _listing(files, folder)
        new = [(m.name, m.batches) for m in messages if m and m.name]
        kept = [] if self.overwrite or not before else [tuple(f) for f in before["files"]]
        # the listing is replaced in one step: readers see the old files or the new
        with files.open_output_stream(f"{folder}/{LISTING}.new") as sink:
            sink.write(json.dumps({"schema": self.schema, "files": [*kept, *new]}).encode())
        files.move(f"{folder}/{LISTING}.new", f"{folder}/{LISTING}")
        if self.overwrite:
            listed = {name for name, _ in new}
            for name in _names(files, folder, None):
                if name not in listed:
                    files.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        for m in messages:
            if m and m.name:
                files.delete_file(f"{folder}/{m.name}")


def save_arrow(df: DataFrame, path: str) -> None:
    """Replace the folder's table. NULL, nested and time columns are kept as Arrow has them."""
    df.sparkSession.dataSource.register(ArrowFiles)
    df.write.format(FORMAT).mode("overwrite").option("path", path).save()


def load_arrow(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowFiles)
    return spark.read.format(FORMAT).option("path", path).load()
