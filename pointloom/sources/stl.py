"""Triangle meshes from STL files, and back."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from pointloom.operators.util import dealt, placed
from pointloom.plans.scratch import discard, shuffle_parts

from . import records
from .files import qualified
from .records import json_option

SOUP = "mesh_id string, fid int, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz")
_FORM = pa.schema([("mesh_id", pa.string()), ("fid", pa.int32()), *((f"{p}{c}", pa.float64()) for p in "abc" for c in "xyz")])
_VERTEX = re.compile(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)")


_START, _TRIANGLE = 84, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("attr", "<u2")])


def triangles(start: bytes, size: int) -> int | None:
    """How many triangles a binary file has; None if it is text, which its length tells."""
    n = struct.unpack("<I", start[80:_START])[0] if len(start) >= _START else -1
    return n if size == _START + _TRIANGLE.itemsize * n else None


def parse_stl(body: bytes) -> np.ndarray:
    """Triangles (n, 3, 3) of a whole file."""
    if triangles(body[:_START], len(body)) is not None:
        return np.frombuffer(body, _TRIANGLE, offset=_START)["v"].astype(float)
    found = np.array(_VERTEX.findall(body), dtype="S32").astype(float)
    if len(found) % 3:
        raise ValueError("a facet is not whole")
    return found.reshape(-1, 3, 3)


class StlReader(DataSourceReader):
    """Ranges of triangles of binary files; a file of text is one task's."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[records.Ranges]:
        split, texts, binary = int(self.options.get("split_bytes", records.SPLIT_BYTES)), [], []
        for path in json_option(self.options, "files") or [self.options["path"]]:
            n = triangles(records.first_bytes(path, _START), records.size_of(path))
            if n is None:
                texts.append(records.Ranges([records.Range(path, 0, 0, 0, ())]))
            else:
                binary.append((path, _START, n, _TRIANGLE.itemsize, (True,)))
        return [*texts, *records.planned(iter(binary), split)]

    def read(self, partition: records.Ranges) -> Iterator[pa.RecordBatch]:
        return records.joined(soup for part in partition.value for soup in _triangles_of(part))


def _triangles_of(part: records.Range) -> Iterator[pa.RecordBatch]:
    if part.kind:
        for first, rows in records.chunks(part, _TRIANGLE):
            yield _soup(part.path, first, rows["v"].astype(float))
    else:
        with records.opened(part.path) as f:
            yield _soup(part.path, 0, parse_stl(f.read()))


class StlWriter(records.RecordWriter):
    """Binary triangles with their normals; one without area has none."""

    def header(self, total: int) -> bytes:
        return _head(total)

    def pack(self, batch: pa.RecordBatch) -> np.ndarray:
        return _packed(batch)


def _head(total: int) -> bytes:
    return b"binary".ljust(80, b" ") + struct.pack("<I", total)


def _packed(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    v = np.stack([batch.column(f"{p}{c}").to_numpy(zero_copy_only=False).astype(float) for p in "abc" for c in "xyz"], axis=1).reshape(-1, 3, 3)
    normal = np.cross(v[:, 1] - v[:, 0], v[:, 2] - v[:, 0])
    length = np.linalg.norm(normal, axis=1, keepdims=True)
    out = np.zeros(len(v), _TRIANGLE)
    out["n"] = np.divide(normal, length, out=np.zeros_like(normal), where=length > 0)
    out["v"] = v
    return out


class StlSource(DataSource):
    """``stl``: reads path or files (JSON list) in ranges of split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "stl"

    def schema(self) -> str:
        return SOUP

    def reader(self, schema) -> StlReader:
        return StlReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> StlWriter:
        return StlWriter(dict(self.options), overwrite)


def _soup(path: str, first: int, t: np.ndarray) -> pa.RecordBatch:
    name = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    t = t.reshape(-1, 9)
    return pa.RecordBatch.from_arrays([pa.array([name] * len(t), pa.string()), pa.array(np.arange(first, first + len(t), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in t.T)], schema=_FORM)


def read_stl(spark: SparkSession, path: str, split_bytes: int = records.SPLIT_BYTES) -> DataFrame:
    """Triangles of STL files by mesh_id, the file's name without ending (S12). A binary file of more than split_bytes is read
    by several tasks. A folder's files are listed by one task, in a stream, and their heads read by all: the driver knows none of
    them. From stores that only Spark reads, a file is one task's."""
    if records.readable(at := qualified(spark, path)) and records.is_folder(at):
        return _read_folder(spark, at, split_bytes)
    files = [p for p, _ in records.listed(spark, path, "")]
    if not files:
        return spark.createDataFrame([], SOUP)
    if all(map(records.readable, files)):
        spark.dataSource.register(StlSource)
        return spark.read.format("stl").options(files=json.dumps(files), split_bytes=split_bytes).load()

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield _soup(r["path"], 0, parse_stl(bytes(r["content"])))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SOUP)


def _read_folder(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    def ranges(batches):
        step = max(1, split_bytes // _TRIANGLE.itemsize)
        for b in batches:
            out = []
            for at, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                n = triangles(records.first_bytes(at, _START), size)
                out += [(at, 0, 0, False)] if n is None else [(at, k, min(step, n - k), True) for k in range(0, n, step)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], ["path", "first", "n", "binary"]) if out else _NO_RANGES

    def run(batches):
        parts = (records.Range(r["path"], r["first"], r["n"], _START + r["first"] * _TRIANGLE.itemsize, (True,) if r["binary"] else ()) for b in batches for r in b.to_pylist())
        return records.joined(soup for part in parts for soup in _triangles_of(part))

    tasks = shuffle_parts(spark)
    return records.found(spark, path).mapInArrow(ranges, "path string, first long, n long, binary boolean").repartition(tasks).mapInArrow(run, SOUP)


_NO_RANGES = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.bool_())], ["path", "first", "n", "binary"])


def indexed(soup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of triangles; vertices at exactly one place are one, numbered by their first use."""
    corner = F.array(*[F.struct(F.lit(n).alias("slot"), *[F.col(f"{p}{c}").alias(c) for c in "xyz"]) for n, p in enumerate("abc")])
    used = soup.select("mesh_id", "fid", F.inline(corner)).withColumn("use", F.col("fid") * 3 + F.col("slot"))
    vertices = used.groupBy("mesh_id", *"xyz").agg(F.min("use").cast("int").alias("vid")).select("mesh_id", "vid", *"xyz")
    faces = used.join(dealt(vertices), ["mesh_id", *"xyz"]).groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("slot") == n, F.col("vid"))).alias(p) for n, p in enumerate("abc")])
    return vertices, faces


def write_stl(corners: DataFrame, path: str) -> None:
    """A folder with one binary STL for each mesh_id (K09, K16), named by it; slashes in it are folders. Replaces what was there.
    A mesh may be written by several tasks."""
    _write(corners, path, F.concat("mesh_id", F.lit(".stl")), single=False)


def write_scene_stl(corners: DataFrame, path: str) -> None:
    """All meshes as one binary STL file (K17, K18), in order of mesh_id and fid. No task holds the scene."""
    _write(corners, path, F.lit("scene.stl"), single=True)


def _write(corners: DataFrame, path: str, file: Column, single: bool) -> None:
    spark = corners.sparkSession
    rows = placed(corners, file, ["mesh_id", "fid"])
    spark.dataSource.register(StlSource)
    records.write(rows.select("file", "place", "total", *[f"{p}{c}" for p in "abc" for c in "xyz"]), "stl", qualified(spark, path), single=single)
    discard(rows)


def stl_bytes(corners: DataFrame) -> bytes:
    """A small mesh as binary STL, on the driver."""
    found = corners.orderBy("fid").toArrow().combine_chunks()
    return _head(len(found)) + _packed(found).tobytes()


def scene_stl_check(spark: SparkSession, path: str) -> DataFrame:
    """One row of what an STL holds: faces, and bounds of its vertices."""
    least = lambda f, g, c: f(g(*[F.col(f"{p}{c}") for p in "abc"]))
    return read_stl(spark, path).agg(F.count(F.lit(1)).alias("faces"), *[least(f, g, c).alias(f"{e}_{c}") for e, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest)) for c in "xyz"])


def template_info(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Of each mesh: sizes and counts."""
    v = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices"), *[(F.max(c) - F.min(c)).alias(f"size_{c}") for c in "xyz"])
    return v.join(faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("faces")), "mesh_id")
