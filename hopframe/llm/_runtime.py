"""Shared folder, cut lineage and batch bounds for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Rows and bytes of one Arrow batch: they bound what a Python worker holds at once, also where texts are long.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, on a local master only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they all share")
        base = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="hopframe-"))
    return base.rstrip("/")


def unused(name: str, columns: Iterable[str]) -> str:
    """A column name like name that none of columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/hopframe/{uuid.uuid4().hex}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete everything that materialize() wrote; call it when no result is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/hopframe")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch sizes where they are above rows and BATCH_BYTES (0 rows mean unbounded)."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def release() -> None:
    """Hand a worker's freed memory back to the system; it lives on for other tasks."""
    gc.collect()
    with suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)
