"""Point clouds from PLY and text files, and back."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from pointloom.operators.util import placed
from pointloom.plans.scratch import discard, materialize, shuffle_parts

from . import records
from .files import qualified
from .records import json_option

_PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
_COLOURS = ("red", "green", "blue")
CLOUD = "path string, point_id long, x double, y double, z double, red double, green double, blue double"


@dataclass(frozen=True)
class PlyHeader:
    """What comes before a PLY's vertices: byte order ("<", ">", or "" for text), their number, their properties (name and
    type), and where they begin."""

    order: str
    count: int
    props: tuple[tuple[str, str], ...]
    start: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, self.order + t) for n, t in self.props])

    def values(self, cols: dict[str, np.ndarray], name: str) -> np.ndarray | None:
        """A column as doubles: a colour from 0 to 1, None where the file has no colours."""
        if name in _COLOURS and not all(c in cols for c in _COLOURS):
            return None
        return cols[name].astype(float) / (255 if name in _COLOURS and dict(self.props)["red"][0] in "iu" else 1)


def ply_header(body: bytes) -> PlyHeader:
    end = body.find(b"end_header")
    stop = body.find(b"\n", end)
    if end < 0 or stop < 0:
        raise ValueError("no PLY header")
    form, count, props, element = "", 0, [], ""
    for line in body[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            element = w[1]
            if element != "vertex" and not count:
                raise ValueError("vertices must come first")
            count = int(w[2]) if element == "vertex" else count
        elif w[:1] == ["property"] and element == "vertex":
            props.append((w[2], _PLY_TYPES[w[1]]))
    return PlyHeader({"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[form], count, tuple(props), stop + 1)


def _text_columns(head: PlyHeader, lines: list[bytes]) -> dict[str, np.ndarray]:
    words = [w for line in lines for w in line.split()[: len(head.props)]]
    rows = np.array(words, "S32").astype(float).reshape(len(lines), len(head.props))
    return {n: rows[:, k] for k, (n, _) in enumerate(head.props)}


def _batch(head: PlyHeader, path: str, first: int, cols: dict[str, np.ndarray], wanted: list[str]) -> pa.RecordBatch:
    n = len(cols["x"])
    out = []
    for c in wanted:
        if c == "path":
            out.append(pa.array([path] * n, pa.string()))
        elif c == "point_id":
            out.append(pa.array(np.arange(first, first + n)))
        else:
            v = head.values(cols, c)
            out.append(pa.nulls(n, pa.float64()) if v is None else pa.array(np.ascontiguousarray(v)))
    return pa.RecordBatch.from_arrays(out, wanted)


class PlyReader(DataSourceReader):
    """Ranges of vertices. A file of text is one range, unless the option text_ranges says how many lines begin in each."""

    def __init__(self, options: dict, schema):
        self.options, self.wanted = options, [f.name for f in schema.fields]

    def partitions(self) -> list[records.Ranges]:
        split, ranges = int(self.options.get("split_bytes", records.SPLIT_BYTES)), json_option(self.options, "text_ranges")
        texts, binary = {}, []
        for path, first, start, end in ranges:
            texts.setdefault(path, []).append((first, start, end))
        out = []
        for path in json_option(self.options, "files") or [self.options["path"]]:
            head = ply_header(records.first_bytes(path, _HEADER))
            if head.order:
                binary.append((path, head.start, head.count, head.dtype.itemsize, (head,)))
                continue
            size = records.size_of(path)
            for first, start, end in texts.get(path, [(0, head.start, size)]):
                if first < head.count:
                    out.append(records.Ranges([records.Range(path, first, head.count - first, start, (head, end))]))
        return [*out, *records.planned(iter(binary), split)]

    def read(self, partition: records.Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.value:
            head = part.kind[0]
            if head.order:
                for first, rows in records.chunks(part, head.dtype):
                    yield _batch(head, part.path, first, {n: rows[n] for n in rows.dtype.names}, self.wanted)
            else:
                done = 0
                for lines in _lines(part.path, part.at, part.kind[1], head.start):
                    lines = lines[: part.count - done]
                    if lines:
                        yield _batch(head, part.path, part.first + done, _text_columns(head, lines), self.wanted)
                    done += len(lines)


_HEADER = 1 << 16


def _lines(path: str, start: int, end: int, least: int) -> Iterator[list[bytes]]:
    """Lines that begin in bytes start to end of a file, some at a time; least is where its first line begins."""
    with records.opened(path) as f:
        if start > least:
            f.seek(start - 1)
            start += len(f.readline()) - 1  # the line that the byte before ends or belongs to
        f.seek(start)
        own = []
        while start < end and (line := f.readline()):
            start += len(line)
            own.append(line)
            if len(own) == records.BATCH:
                yield own
                own = []
        yield own


class PlyWriter(records.RecordWriter):
    """Binary vertices: doubles, and bytes for colours if the rows have them."""

    def __init__(self, options: dict, overwrite: bool, colours: bool):
        super().__init__(options, overwrite)
        self.colours = colours
        self.dtype = np.dtype([(c, "<f8") for c in "xyz"] + [(c, "u1") for c in _COLOURS if colours])

    def header(self, total: int) -> bytes:
        own = [*(f"property double {c}" for c in "xyz"), *(f"property uchar {c}" for c in _COLOURS if self.colours)]
        return "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {total}", *own, "end_header", ""]).encode()

    def pack(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(len(batch), self.dtype)
        for c in self.dtype.names:
            v = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            out[c] = np.rint(255 * np.clip(np.nan_to_num(v, nan=0.5), 0, 1)) if c in _COLOURS else v
        return out


class PlySource(DataSource):
    """``ply``: reads path or files (JSON list) in ranges of split_bytes; a schema given to the reader chooses columns."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return CLOUD

    def reader(self, schema) -> PlyReader:
        return PlyReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        return PlyWriter(dict(self.options), overwrite, all(c in schema.fieldNames() for c in _COLOURS))


def parse_ply(body: bytes) -> tuple[PlyHeader, dict[str, np.ndarray]]:
    """Header and vertex columns of a whole file; ASCII or binary, further elements are passed over."""
    head = ply_header(body)
    if head.order:
        rows = np.frombuffer(body, head.dtype, head.count, head.start)
        return head, {n: rows[n] for n in rows.dtype.names}
    return head, _text_columns(head, body[head.start :].splitlines()[: head.count])


def _text_ranges(spark: SparkSession, files: list[tuple[str, int]], split: int) -> list[tuple[str, int, int, int]]:
    """path, number of the first line, first byte and end of each range of text files longer than a split; lines are counted by
    range in tasks, and only these counts reach the driver."""
    cut = []
    for path, size in files:
        head = ply_header(records.first_bytes(path, _HEADER)) if size > split else None
        if head and not head.order:
            cut += [(path, head.start, b, min(b + split, size)) for b in range(head.start, size, split)]
    if not cut:
        return []

    def count(batches):
        for b in batches:
            for path, least, start, end in zip(*(c.to_pylist() for c in b.columns)):
                n = sum(map(len, _lines(path, start, end, least)))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start]), pa.array([end]), pa.array([n])], ["path", "start", "end", "n"])

    rows = spark.createDataFrame(cut, "path string, least long, start long, end long").repartition(len(cut), "path", "start")
    counted = rows.mapInArrow(count, "path string, start long, end long, n long")
    before = F.sum("n").over(W.partitionBy("path").orderBy("start")) - F.col("n")
    return [tuple(r) for r in counted.select("path", before, "start", "end").collect()]  # a row for each split


def read_ply(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = records.SPLIT_BYTES) -> DataFrame:
    """Points of PLY files (S01): path, point_id (the place in the file), x, y, z and colours from 0 to 1 (null where there are
    none), or the columns asked for. A file of more than split_bytes is read by several tasks. A folder's files are listed and
    their heads read by tasks, unless a text among them is longer than that. From stores that only Spark reads, a file is one
    task's."""
    schema = T.StructType([f for f in T._parse_datatype_string(CLOUD).fields if not columns or f.name in columns])
    if records.readable(at := qualified(spark, path)) and records.is_folder(at) and (rows := _read_folder(spark, at, schema, split_bytes)) is not None:
        return rows
    files = records.listed(spark, path, "")
    if not files:
        return spark.createDataFrame([], schema)
    if not all(records.readable(p) for p, _ in files):
        return _whole_files(spark, path, schema)
    spark.dataSource.register(PlySource)
    own = {"files": json.dumps([p for p, _ in files]), "split_bytes": split_bytes, "text_ranges": json.dumps(_text_ranges(spark, files, split_bytes))}
    return spark.read.format("ply").schema(schema).options(**own).load()


def _read_folder(spark: SparkSession, folder: str, schema: T.StructType, split: int) -> DataFrame | None:
    """Points of a folder's files, a row for each range of them dealt to tasks; None if one is a text to be divided."""
    def ranges(batches):
        for b in batches:
            out = []
            for path, size in zip(*(c.to_pylist() for c in b.columns)):
                head = ply_header(records.first_bytes(path, _HEADER))
                step = max(1, split // head.dtype.itemsize) if head.order else max(1, head.count)
                out += [(path, size, k, min(step, head.count - k), not head.order) for k in range(0, head.count, step)]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["path", "length", "first", "n", "text"])

    def points(batches):
        for b in batches:
            for r in b.to_pylist():
                head = ply_header(records.first_bytes(r["path"], _HEADER))
                if head.order:
                    kind, start = (head,), head.start + r["first"] * head.dtype.itemsize
                else:
                    kind, start = (head, r["length"]), head.start
                yield from reader.read(records.Ranges([records.Range(r["path"], r["first"], r["n"], start, kind)]))

    reader = PlyReader({}, schema)
    parts = materialize(records.found(spark, folder).mapInArrow(ranges, "path string, length long, first long, n long, text boolean"), "ply-ranges")
    if not parts.filter(F.col("text") & (F.col("length") > split)).isEmpty():
        return None
    return parts.repartition(shuffle_parts(spark)).mapInArrow(lambda batches: records.joined(points(batches)), schema)


def _whole_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    wanted = schema.fieldNames()

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                head, cols = parse_ply(bytes(r["content"]))
                for k in range(0, head.count, records.BATCH):
                    yield _batch(head, r["path"], k, {n: v[k : k + records.BATCH] for n, v in cols.items()}, wanted)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def write_ply(points: DataFrame, path: str, order: str = "point_id", file: Column | None = None) -> None:
    """One binary PLY at a path (K01, K05, K06), of points (x, y, z and, if it has them, colours from 0 to 1) by order; no points,
    no file. With file, a folder of one PLY for each of its values (K03). Replaces what was there."""
    spark = points.sparkSession
    colours = [c for c in _COLOURS if c in points.columns]
    rows = placed(points.select(*"xyz", *colours, order, (F.lit("cloud.ply") if file is None else file).alias("its_file")), F.col("its_file"), [order])
    spark.dataSource.register(PlySource)
    records.write(rows.select("file", "place", "total", *"xyz", *colours), "ply", qualified(spark, path), single=file is None)
    discard(rows)


def read_txt(spark: SparkSession, path: str, comment: str = "/", by_folder: bool = False) -> DataFrame:
    """Rows of whitespace-separated text files of 3 or 6 and more numbers (S08, S09): fragment (order of paths from 0), fragment_name,
    x ... blue. Files whose colours are all at most 1 are scaled to 255; lines that begin with the comment sign drop out, and so
    do lines that are no numbers, while their file keeps its number. by_folder: all files of a folder are one fragment, as write_fragments
    leaves them."""
    file = F.col("_metadata.file_path")
    lines = spark.read.text(path).select((F.regexp_replace(file, "/[^/]*$", "") if by_folder else file).alias("path"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    files = lines.select("path").distinct().withColumn("fragment", (F.row_number().over(W.orderBy("path")) - 1).cast("long"))
    w = F.split("value", r"\s+")
    number = lambda k: F.try_element_at(w, F.lit(k + 1)).try_cast("double")
    rows = lines.filter((F.col("value") != "") & ~F.col("value").startswith(comment)).select("path", "line", *[number(k).alias(c) for k, c in enumerate(("x", "y", "z", "red", "green", "blue"))])
    rows = rows.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    most = rows.groupBy("path").agg(F.max(F.greatest("red", "green", "blue")).alias("most"))
    scale = F.when(F.col("most") <= 1.0, 255.0).otherwise(1.0)
    out = files.join(rows, "path").join(most, "path").withColumns({c: F.col(c) * scale for c in ("red", "green", "blue")})
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return out.select("fragment", name.alias("fragment_name"), F.col("line").alias("point_id"), *"xyz", "red", "green", "blue")


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """Points of a file by its ending."""
    return read_ply(spark, path) if path.lower().endswith(".ply") else read_txt(spark, path, "//")


def text_rows(points: DataFrame) -> DataFrame:
    """value: a line of six decimals and whole colours for each point; grey where there are none, colours cut to 0 to 255."""
    colour = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.coalesce(c, F.lit(128.0))))).cast("int")
    return points.withColumn("value", F.format_string("%.6f %.6f %.6f %d %d %d", "x", "y", "z", *[colour(F.col(c)) for c in ("red", "green", "blue")]))


def write_fragments(points: DataFrame, path: str, name: str) -> None:
    """Text files in a folder for each value of name, replacing what was there."""
    text_rows(points).select(name, "value").repartition(name).sortWithinPartitions(name).write.mode("overwrite").partitionBy(name).text(path)


def component_colours(labels: DataFrame) -> DataFrame:
    """Colours that tell components apart, by hash."""
    h = F.xxhash64(F.lit(42), "component_id")
    byte = lambda k: (F.shiftrightunsigned(h, 8 * k).bitwiseAND(255) / 255.0)
    return labels.select("point_id", "component_id", byte(0).alias("red"), byte(1).alias("green"), byte(2).alias("blue"))
