"""Masks as runs of pixels, from greyscale PNG files."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import records
from .files import qualified

RUNS = "frame string, mask_id int, score double, v int, u_start int, u_end int"
_FORM = pa.schema([("frame", pa.string()), ("mask_id", pa.int32()), ("score", pa.float64()), ("v", pa.int32()), ("u_start", pa.int32()), ("u_end", pa.int32())])


def decode_png(body: bytes) -> np.ndarray | None:
    """Grey values of a PNG of 8 bits, grey or colour with or without alpha (the first channel then); None for anything else."""
    if body[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, head = 8, b"", None
    try:
        while at + 8 <= len(body):
            n, kind = struct.unpack(">I4s", body[at : at + 8])
            part = body[at + 8 : at + 8 + n]
            head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
            data += part if kind == b"IDAT" else b""
            at += 12 + n
        width, height, depth, colour, _, _, interlace = head
        channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
        if depth != 8 or interlace or channels is None:
            return None
        raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    except (struct.error, zlib.error, ValueError, TypeError):
        return None
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, int)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(int)
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.cumsum(line.reshape(-1, channels), axis=0).ravel() % 256
        elif kind == 2:
            now = (line + above) % 256
        else:
            now = np.zeros(len(line), int)
            for x in range(len(line)):
                left = now[x - channels] if x >= channels else 0
                up, corner = above[x], above[x - channels] if x >= channels else 0
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    near = [(abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner)]
                    guess = min(near)[2]
                now[x] = (line[x] + guess) % 256
        out[y] = above = now
    return out.reshape(height, width, channels)[:, :, 0]


def _chunk(kind: bytes, part: bytes) -> bytes:
    return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))


def encode_png(grey: np.ndarray) -> bytes:
    rows = b"".join(b"\0" + r.tobytes() for r in grey.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")


def runs_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of set pixels."""
    wide = np.zeros((inside.shape[0], inside.shape[1] + 2), np.int8)
    wide[:, 1:-1] = inside
    step = np.diff(wide, axis=1)
    v, start = np.nonzero(step == 1)
    return v, start, np.nonzero(step == -1)[1] - 1


def read_masks(spark: SparkSession, path: str, width: int | None = None, height: int | None = None) -> DataFrame:
    """Runs of all mask_*.png below path, a folder for each frame (S05, S06). Unreadable files are passed over; a mask of another
    size than the camera's is an error, told with its path (rather than a frame lost)."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                grey = decode_png(bytes(r["content"]))
                if grey is None:
                    continue
                if width is not None and grey.shape != (height, width):
                    raise ValueError(f"{r['path']}: {grey.shape[1]} x {grey.shape[0]} pixels instead of {width} x {height}")
                m = re.search(r"([^/]+)/mask_(\d+)(?:_score_([0-9.]+))?\.png$", r["path"])
                if not m:
                    continue
                v, s, e = runs_of(grey > 0)
                n = len(v)
                yield pa.RecordBatch.from_arrays([pa.array([m[1]] * n), pa.array(np.full(n, int(m[2]), np.int32)), pa.array([float(m[3]) if m[3] else None] * n, pa.float64()), *(pa.array(c.astype(np.int32)) for c in (v, s, e))], schema=_FORM)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "mask_*.png").load(path)
    return files.select("path", "content").mapInArrow(run, RUNS)


def frames_of(runs: DataFrame) -> DataFrame:
    """Frames to process, in order of name."""
    return runs.select("frame").distinct().orderBy("frame")


def segment(images: DataFrame, model, schema: str = RUNS) -> DataFrame:
    """The place for a segmentation model (M01): model takes an iterator of Arrow batches of images (path, content) and gives
    batches of mask runs, which write_masks keeps as files. None is part of this library."""
    return images.select("path", F.col("content")).mapInArrow(model, schema)


# ---- writing ---------------------------------------------------------------------------------------------------------


@dataclass
class Drawn(WriterCommitMessage):
    masks: int


class MaskWriter(DataSourceArrowWriter):
    """PNGs of runs in order of frame, mask_id, v and u_start, row by row: no mask is held whole. A mask is one task's; the
    folder appears at the commit."""

    def __init__(self, options: dict, overwrite: bool):
        if not overwrite:
            raise ValueError("masks are written with mode overwrite")
        self.path, self.width, self.height = options["path"].rstrip("/"), int(options["width"]), int(options["height"])
        self.target = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drawn:
        fs, folder = records.store(self.target)
        name = drawing = None
        done = 0
        for b in iterator:
            for frame, mask_id, score, v, a, e in zip(*(b.column(c).to_pylist() for c in ("frame", "mask_id", "score", "v", "u_start", "u_end"))):
                own = f"{frame}/mask_{mask_id:03d}" + ("" if score is None else f"_score_{score:.3f}") + ".png"
                if own != name:
                    if drawing:
                        drawing.close()
                    fs.create_dir(f"{folder}/{frame}", recursive=True)
                    name, drawing, done = own, _Drawing(fs.open_output_stream(f"{folder}/{own}"), self.width, self.height), done + 1
                drawing.run(v, a, e)
        if drawing:
            drawing.close()
        return Drawn(done)

    def commit(self, messages: list[Drawn | None]) -> None:
        fs, target = records.store(self.target)
        path = records.store(self.path)[1]
        records.remove(fs, path)
        fs.create_dir(target, recursive=True)
        fs.move(target, path)

    def abort(self, messages: list) -> None:
        fs, target = records.store(self.target)
        records.remove(fs, target)


class _Drawing:
    """A grey PNG that grows row by row; runs come in order of rows."""

    def __init__(self, out, width: int, height: int):
        self.out, self.width, self.height, self.at = out, width, height, 0
        self.row, self.body, self.parts = np.zeros(width, np.uint8), zlib.compressobj(), 0
        out.write(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)))

    def run(self, v: int, first: int, last: int) -> None:
        if not 0 <= v < self.height or v < self.at:
            raise ValueError(f"row {v} of {self.height} comes after row {self.at}")
        self._down_to(v)
        self.row[max(0, first) : last + 1] = 255

    def _down_to(self, v: int) -> None:
        while self.at < v:
            part = self.body.compress(b"\0" + self.row.tobytes())
            if part:
                self.out.write(_chunk(b"IDAT", part))
            self.row[:] = 0
            self.at += 1

    def close(self) -> None:
        self._down_to(self.height)
        self.out.write(_chunk(b"IDAT", self.body.flush()) + _chunk(b"IEND", b""))
        self.out.close()


class MaskSource(DataSource):
    """``masks``: writes runs of pixels as PNGs, a folder for each frame."""

    @classmethod
    def name(cls) -> str:
        return "masks"

    def writer(self, schema, overwrite: bool) -> MaskWriter:
        return MaskWriter(dict(self.options), overwrite)


def write_masks(runs: DataFrame, path: str, width: int, height: int) -> None:
    """A segmentation's masks (frame, mask_id, score or null, v, u_start, u_end) as mask_NNN_score_S.png below a folder for each
    frame (K14), replacing what was there; read_masks reads them. Runs may overlap, and columns beyond the picture are left
    out; rows beyond it are an error."""
    spark = runs.sparkSession
    spark.dataSource.register(MaskSource)
    rows = runs.select("frame", "mask_id", F.col("score").cast("double").alias("score"), "v", "u_start", "u_end")
    rows = rows.repartition("frame", "mask_id").sortWithinPartitions("frame", "mask_id", "score", "v", "u_start")
    rows.write.format("masks").mode("overwrite").options(width=width, height=height).save(qualified(spark, path))
