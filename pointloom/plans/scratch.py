"""Intermediate tables in the folder that a cluster's executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where a local master has none set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='pointloom-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def _forget() -> None:
    for path, spark in _SCRATCH.items():
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the folder then stays for its owner to clear
            return


atexit.register(_forget)


def trim(spark: SparkSession) -> None:
    """Has the driver's JVM give native memory that it has freed back to the system: what planning and compiling many queries
    took would else stay with its allocator. Does nothing in JVMs that can't."""
    try:
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        # The server's own class isn't accessible; its interface is.
        method = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        method.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Exception:  # another kind of JVM or of connection to it
        return


#: Spark removes an execution's shuffle files at its end where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared scratch folder and read again: a lost executor costs no recomputation of what
    came before, and later steps read columns they need. What was shuffled to make it is removed at once; the table goes
    with discard() or when the driver's process ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    trim(spark)
    _SCRATCH[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table that materialize() has made and that no later step reads."""
    path = table._scratch_path
    p = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
    _SCRATCH.pop(path, None)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Lets Python workers find this library where the driver has it. On a cluster whose executors have no copy there, submit
    the library with --py-files."""
    root = str(Path(__file__).resolve().parent.parent.parent)
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))
