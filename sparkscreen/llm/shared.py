"""Places that the driver and every executor can see, and small helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, a folder
    given to ``setCheckpointDir`` counts.  With neither, a session in one process gets a
    temporary one, and on a cluster, where no executor would see that, it is an error.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("no shared folder for intermediate tables: set spark.checkpoint.dir")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkscreen-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def staging_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sparkscreen/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: this cuts
    the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = path or staging_path(spark, what)
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table, through Hadoop's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes that a Python worker gets at once, but for a single longer row.
BATCH_BYTES = 4 << 20


@contextmanager
def batches_of(spark: SparkSession, rows: int | None = None, size: int = BATCH_BYTES) -> Iterator[None]:
    """For what is written meanwhile: Arrow batches of so many rows and bytes at most."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    was = {name: spark.conf.get(name) for name in limits}
    for name, most in limits.items():
        if most:
            spark.conf.set(name, most)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


def released(work):
    """For a function over a task's batches: when it ends, the memory that it freed goes back to the system.

    Python workers outlive their tasks and wait beside each other, so what one keeps adds to what the next ones need.
    """

    @wraps(work)
    def run(batches, *args, **kwargs):
        try:
            yield from work(batches, *args, **kwargs)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return run


def small_parts(batches, text: int, rows: int = 256, size: int = 4 << 20):
    """Slices of Arrow batches with so many rows, and so many bytes in column ``text`` but for a single longer one."""
    for batch in batches:
        column = batch.column(text)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


class Scratch:
    """Intermediate tables of one computation, dropped as soon as they aren't needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stage(self, df: DataFrame, what: str, batch: int | None = None) -> DataFrame:
        """``batch``: rows that go to a Python worker at once, where rows are large."""
        self.paths[what] = staging_path(self.spark, what)
        with batches_of(self.spark, batch):
            return staged(df, what, self.paths[what], compression="zstd")

    def forget(self, *names: str) -> None:
        """Delete these tables."""
        for name in names:
            drop_staged(self.spark, self.paths.pop(name))

    def drop(self, *names: str) -> None:
        """Delete these tables, and let Spark's cleaner take the shuffle files of plans that are gone."""
        self.forget(*names)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
