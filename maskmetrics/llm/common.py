"""Helpers shared by the training-data operators: shared storage and input tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to Python.  Texts are whole documents, so a
#: batch is kept small to bound a worker's memory.
ARROW_ROWS = 4096
ARROW_BYTES = 2 << 20
_own_dir: dict[str, str] = {}
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table with Spark's own reader (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``ARROW_ROWS`` rows and ``ARROW_BYTES`` bytes if they are larger."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    spark.conf.set(size, str(ARROW_BYTES))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, giving freed memory back to the system at the end: workers live on and share it with the executor."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only a local session may lack
    it; then one temporary folder per application is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="maskmetrics-")
        atexit.register(_drop_local, _own_dir[app])
    return f"file://{_own_dir[app]}"


def _drop_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files outlive any executor, so a lost executor costs no recomputation of
    what came before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_files(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialise`, once it is no longer read."""
    spark = df.sparkSession
    base = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for parent in parents:
        # only ever below the shared folder
        if base.replace("file://", "").rstrip("/") in parent:
            p = jvm.org.apache.hadoop.fs.Path(parent)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete what :func:`materialise` wrote inside the block, but for the tables that the block puts into the list it gets."""
    before, kept = len(_made), []
    yield kept
    keep = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in kept for f in df.inputFiles()}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made[before:]:
        if path.rsplit("/", 1)[-1] not in keep:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(hadoop).delete(p, True)
    del _made[before:]


#: Ids that are broadcast to drop or pick rows; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
