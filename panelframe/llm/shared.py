"""What all executors and the driver share: the folder named in spark.checkpoint.dir."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; without the setting a temporary one for a local session (tests), and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named is None:
        if sc.getCheckpointDir() is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelframe-"))
        return sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Arrow batches by bytes, unless the session has a limit of its own: texts may be long, and rows say little about size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_scratch: ContextVar[list[tuple[str, bool]] | None] = ContextVar("scratch", default=None)


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The same rows read back from a table in the shared folder: computed once, lineage cut. keep: the table outlives the innermost scratch block."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    if (tables := _scratch.get()) is not None:
        tables.append((path, keep))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables saved inside go at its end, but those to keep, which are the outer block's from then on: nothing that leaves the block may read the others."""
    tables, outer = [], _scratch.get()
    token = _scratch.set(tables)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path, keep in tables:
            if not keep:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            elif outer is not None:
                outer.append((path, False))


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job that wrote them ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, for the small tables of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def freed() -> None:
    """Memory that a Python worker no longer uses goes back to the machine: workers are reused, and an idle one would keep its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def freeing(function: Callable) -> Callable:
    """A function of a column or of a group's table that gives its memory back after each call."""

    @functools.wraps(function)
    def run(x):
        out = function(x)
        freed()
        return out

    return run


def freeing_after(of_batches: Callable) -> Callable:
    """A function of the batches of a task, or of a group, that gives its memory back after the last."""

    @functools.wraps(of_batches)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of_batches(batches)
        freed()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df (in any case of letters) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrow(df: DataFrame, **cols: str) -> DataFrame:
    """Only the given columns, under the given names: new name = old name."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in cols.items()])
