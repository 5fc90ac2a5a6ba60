"""Storage shared by driver and executors, and unit sizing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where the session names none (tests, one machine) a temporary one."""
    found = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="trellis-shared-")
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read again."""
    spark = df.sparkSession
    paths = {f.rpartition("/")[0] for f in df.inputFiles()}
    for path in (spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return the worker's free memory to the machine at a task's end: workers live on into later stages."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts (nulls count nothing)."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"]


def units(total_bytes: int, unit_bytes: int, least: int = 48) -> int:
    """How many units of about ``unit_bytes`` hold ``total_bytes``; ``least`` keeps small inputs parallel."""
    return max(least, -(-int(total_bytes) // unit_bytes))
