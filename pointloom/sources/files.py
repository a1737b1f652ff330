"""Files by way of Spark's file systems, so that any store it can read will do."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Python workers need it."""
    fs, p = _fs(spark, path)
    return str(fs.makeQualified(p))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in code point order; none where there is no folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def has_any(spark: SparkSession, path: str, endings: tuple[str, ...]) -> bool:
    return any(n.lower().endswith(endings) for n in names(spark, path))


def first_existing(spark: SparkSession, paths: list[str], endings: tuple[str, ...] = ()) -> str | None:
    """The first path that is there and, if endings are given, holds such a file: healed before filtered before raw (S11), or the
    furniture to enclose by preference (S16)."""
    for path in paths:
        if has_any(spark, path, endings) if endings else exists(spark, path):
            return path
    return None


def state(spark: SparkSession, path: str) -> tuple:
    """Number of files at or below path, and a hash over their paths, lengths and times; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return tuple(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, such as a configuration, as one text."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written from the driver."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp")


def images(spark: SparkSession, path: str) -> list[str]:
    """Names of images in a folder in order (S07); a folder without any is an error."""
    found = [n for n in names(spark, path) if n.lower().endswith(IMAGES)]
    if not found:
        raise FileNotFoundError(f"no images in {path}")
    return found
