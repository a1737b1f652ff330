"""Files of records of one size, read in ranges and written in place, for Spark's data source API.

Reading: a file's header says where its records begin and how many there are, so a scan is planned as ranges of records, a
large file in several tasks and small files together in one. Writing: each row knows its file, its place there and how many
records the file has, so tasks write records where they belong, in any order, and a task that is tried again or twice writes
the same bytes to the same places. Nothing is visible before the commit, which compares the numbers of all tasks with what
should be there; an abort leaves nothing. In stores whose files can't be written in the middle, a task writes runs of
records as parts, which the commit joins.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, InputPartition, WriterCommitMessage

from pointloom.plans.scratch import shuffle_parts

#: Bytes of records that a task reads.
SPLIT_BYTES = 64 << 20
#: Records turned into a batch at a time.
BATCH = 1 << 16
_COPY = 8 << 20


def store(uri: str):
    """The file system of a path, and the path in it; ValueError for kinds that only Spark reads."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def readable(uri: str) -> bool:
    try:
        store(uri)
    except (ValueError, pa.ArrowException, OSError):
        return False
    return True


def listed(spark: SparkSession, path: str, ending: str) -> list[tuple[str, int]]:
    """Paths and lengths of files at or below a path or pattern; what Spark lists, contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return [(r.path, r.length) for r in files.filter(F.lower("path").endswith(ending)).orderBy("path").toLocalIterator()]


def is_folder(path: str) -> bool:
    from pyarrow.fs import FileType

    fs, inner = store(path)
    return fs.get_file_info(inner).type == FileType.Directory


def walked(path: str) -> Iterator[tuple[str, int]]:
    """Paths and lengths of files below a folder, one after the other; those that Spark takes for hidden are left out."""
    from pyarrow import fs as arrow

    fs, inner = store(path)
    inner = inner.rstrip("/")
    start = path.rstrip("/").removesuffix(inner)
    folders = [inner]
    while folders:
        folder = folders.pop()
        if isinstance(fs, arrow.LocalFileSystem):
            with os.scandir(folder) as found:
                for x in found:
                    if not x.name.startswith(("_", ".")):
                        if x.is_dir():
                            folders.append(x.path)
                        else:
                            yield start + x.path, x.stat().st_size
        else:
            for x in fs.get_file_info(arrow.FileSelector(folder)):
                if not x.base_name.startswith(("_", ".")):
                    if x.is_file:
                        yield start + x.path, x.size
                    else:
                        folders.append(x.path)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of files below a folder, listed by one task in a stream and dealt to all: the driver knows none of them."""
    def files(batches):
        for b in batches:
            for at in b.column("path").to_pylist():
                rows = walked(at)
                while own := list(islice(rows, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], ["path", "length"])

    rows = spark.createDataFrame([(folder,)], "path string").repartition(1).mapInArrow(files, "path string, length long")
    return rows.repartition(shuffle_parts(spark))


@dataclass
class Range:
    """Records first to first + count of a file, from a byte on; what else its reader needs."""

    path: str
    first: int
    count: int
    at: int
    kind: tuple


class Ranges(InputPartition):
    def __init__(self, value: list[Range]):
        super().__init__(value)


def planned(files: Iterator[tuple[str, int, int, int, tuple]], split: int) -> list[Ranges]:
    """Partitions of about split bytes from files (path, byte of the first record, number, size of one, kind)."""
    out, own, size = [], [], 0
    for path, at, count, width, kind in files:
        step = max(1, split // width)
        for first in range(0, count, step):
            n = min(step, count - first)
            if own and size + n * width > split:
                out.append(Ranges(own))
                own, size = [], 0
            own.append(Range(path, first, n, at + first * width, kind))
            size += n * width
    return [*out, Ranges(own)] if own else out


def chunks(part: Range, dtype: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """A range's records, a bounded number at a time, with the place of the first."""
    fs, path = store(part.path)
    with fs.open_input_file(path) as f:
        for k in range(0, part.count, BATCH):
            n = min(BATCH, part.count - k)
            body = f.read_at(n * dtype.itemsize, part.at + k * dtype.itemsize)
            if len(body) < n * dtype.itemsize:
                raise ValueError(f"{part.path} ends before its last record")
            yield part.first + k, np.frombuffer(body, dtype)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few batches of many rows instead of one for each small file."""
    own, n = [], 0
    for batch in batches:
        own.append(batch)
        n += len(batch)
        if n >= BATCH:
            yield pa.concat_batches(own)
            own, n = [], 0
    if own:
        yield pa.concat_batches(own)


# ---- writing ---------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    rows: int
    places: int
    parts: list[tuple[str, int, str]]


class RecordWriter(DataSourceArrowWriter):
    """Writes rows (file, place, total, and the layout's own columns). header and pack belong to a layout: the bytes before
    records of a file of so many, and a batch's records as an array.

    Options: path; single: the only file is to be at the path itself, not in a folder there; rows: how many there are."""

    def __init__(self, options: dict, overwrite: bool):
        if not overwrite:
            raise ValueError("records are written with mode overwrite")
        self.path, self.single, self.rows = options["path"].rstrip("/"), options.get("single", "false") == "true", int(options["rows"])
        self.places = int(options["places"])
        self.target = f"{self.path}.{uuid.uuid4().hex}.tmp"
        local = self.path.startswith(("/", "file:"))
        self.in_place = local and options.get("in_place", "true") == "true"

    def header(self, total: int) -> bytes:
        raise NotImplementedError

    def pack(self, batch: pa.RecordBatch) -> np.ndarray:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = _Placed(self) if self.in_place else _Parts(self)
        rows = places = 0
        try:
            for batch in iterator:
                at = batch.column("place").to_numpy()
                names, total = batch.column("file"), batch.column("total").to_numpy()
                records = self.pack(batch)
                rows, places = rows + len(at), places + int(at.sum())
                code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(code) != 0)) + 1
                for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(at)]):
                    if a < b:
                        files.add(names[a].as_py(), int(at[a]), int(total[a]), records[a:b].tobytes(), b - a)
        finally:
            parts = files.close()
        return Written(rows, places, parts)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        found = sum(m.rows for m in done), sum(m.places for m in done)
        if found != (self.rows, self.places):
            self.abort(messages)
            raise ValueError(f"{self.path}: {found[0]} records written of {self.rows}, or not each in its place")
        fs, target = store(self.target)
        path = store(self.path)[1]
        for name, parts in _by_file(done).items():
            with fs.open_output_stream(f"{target}/{name}") as out:
                for _, part in sorted(parts):
                    with fs.open_input_stream(f"{target}/{part}") as f:
                        while body := f.read(_COPY):
                            out.write(body)
                    fs.delete_file(f"{target}/{part}")
        remove(fs, path)
        if not self.rows:
            remove(fs, target)  # no records, no file
        elif self.single:
            only = [x for x in fs.get_file_info(_below(target)) if x.is_file]
            if len(only) != 1:
                raise ValueError(f"{self.path}: {len(only)} files instead of one")
            fs.move(only[0].path, path)
            remove(fs, target)
        else:
            fs.move(target, path)

    def abort(self, messages: list) -> None:
        fs, target = store(self.target)
        remove(fs, target)


def _below(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, recursive=True, allow_not_found=True)


def remove(fs, path: str) -> None:
    from pyarrow.fs import FileType

    kind = fs.get_file_info(path).type
    if kind == FileType.Directory:
        fs.delete_dir(path)
    elif kind == FileType.File:
        fs.delete_file(path)


def _by_file(messages: list[Written]) -> dict[str, list[tuple[int, str]]]:
    out: dict[str, list[tuple[int, str]]] = {}
    for m in messages:
        for name, first, part in m.parts:
            out.setdefault(name, []).append((first, part))
    return out


class _Placed:
    """Runs go to their places in files that all tasks write to."""

    def __init__(self, writer: RecordWriter):
        self.writer, self.folder, self.name, self.file, self.start, self.many = writer, store(writer.target)[1], None, None, 0, False

    def add(self, name: str, first: int, total: int, body: bytes, n: int) -> None:
        if name != self.name:
            if self.file is not None:  # many files: all reach the disk at the end, at once
                os.close(self.file)
                self.name, self.file, self.many = None, None, True
            path = f"{self.folder}/{name}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            self.name, self.file = name, os.open(path, os.O_WRONLY | os.O_CREAT, 0o644)
            self.start = len(self.writer.header(total))
        if not first:
            _whole(self.file, self.writer.header(total), 0)
        _whole(self.file, body, self.start + first * (len(body) // n))

    def close(self) -> list:
        if self.file is not None:
            os.sync() if self.many else os.fsync(self.file)
            os.close(self.file)
            self.name = self.file = None
        return []


def _whole(file: int, body: bytes, at: int) -> None:
    view = memoryview(body)
    while view:
        n = os.pwrite(file, view, at)
        view, at = view[n:], at + n


class _Parts:
    """Each run is a part of its own, named by attempt; the commit joins those that it is told of."""

    def __init__(self, writer: RecordWriter):
        self.writer, (self.fs, self.folder) = writer, store(writer.target)
        self.parts, self.out, self.next = [], None, None

    def add(self, name: str, first: int, total: int, body: bytes, n: int) -> None:
        if self.next != (name, first):
            self._end()
            part = f"{name}.{first:015d}-{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.folder}/{part}".rsplit("/", 1)[0], recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{part}")
            self.parts.append((name, first, part))
            if not first:
                self.out.write(self.writer.header(total))
        self.out.write(body)
        self.next = (name, first + n)

    def _end(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def close(self) -> list:
        self._end()
        return self.parts


def write(rows: DataFrame, source: str, path: str, single: bool = False, **options) -> None:
    """Writes rows (file, place from 0, total, ...) that stand in a table, since they are counted first."""
    rows_, places = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("place"), F.lit(0))).first()
    own = {"rows": rows_, "places": places, "single": single, **options}
    rows.write.format(source).mode("overwrite").options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in own.items()}).save(path)


def json_option(options: dict, name: str) -> list:
    return json.loads(options.get(name, "[]"))


def first_bytes(path: str, n: int) -> bytes:
    fs, inner = store(path)
    with fs.open_input_file(inner) as f:
        return f.read_at(min(n, f.size()), 0)


def opened(path: str) -> BinaryIO:
    fs, inner = store(path)
    return io.BufferedReader(fs.open_input_file(inner), 1 << 20)


def size_of(path: str) -> int:
    fs, inner = store(path)
    return fs.get_file_info(inner).size
