"""Lineage cuts and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints"
BATCH_BYTES = "4194304b"
FILES_A_CORE, NARROW_FILES_A_CORE = 8, 2


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where it is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"{LOCAL_CHECKPOINTS}/{uuid.uuid4().hex}")
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python of at most 4 MB, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_BYTES)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of at most 4 MB, unless the session has a size of its own.

    Whole texts and shingle sets fill Spark's default of 64 MB, which a task holds several times over on both sides.
    """
    bound_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return the memory that a task has used to the system; workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _cores(spark: SparkSession) -> int | None:
    """The cores that the application can get; None where executors come and go without a stated limit."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false").lower() != "true":
        return spark.sparkContext.defaultParallelism
    executors = conf.get("spark.dynamicAllocation.maxExecutors")
    return int(executors) * int(conf.get("spark.executor.cores", "1")) if executors else None


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back.

    The result has no lineage: a lost executor costs a reread of files, never a recomputation.  At most
    ``FILES_A_CORE`` files a core are written, and ``NARROW_FILES_A_CORE`` of a ``narrow`` table (ids, links, counts), so that
    many near-empty partitions do not become as many files; partitions are still computed one by one.
    """
    cores = _cores(df.sparkSession)
    path = new_path(df.sparkSession, label)
    (df if cores is None else df.coalesce(cores * (NARROW_FILES_A_CORE if narrow else FILES_A_CORE))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """Written tables that are dealt out by hash into a fixed number of sorted buckets, so that joins on those columns move no rows of them.

    Used as a context: the tables are dropped and their files deleted at its end.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: dict[str, str] = {}
        self.last: str | None = None

    def step(self, df: DataFrame) -> DataFrame:
        """``df`` written as a narrow table, which takes the place of the step before: that one is deleted."""
        path, cores = new_path(self.spark, "step"), _cores(self.spark)
        (df if cores is None else df.coalesce(cores * NARROW_FILES_A_CORE)).write.parquet(path)
        if self.last:
            remove(self.spark, self.last)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)

    def write(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """``df`` as a table in buckets of ``keys``."""
        name, path = f"t_{uuid.uuid4().hex}", new_path(self.spark, "buckets")
        df.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
        self.names[name] = path
        return self.spark.table(name)

    def __enter__(self) -> Buckets:
        return self

    def __exit__(self, *_exc) -> None:
        for name, path in self.names.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)
        if self.last:
            remove(self.spark, self.last)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting ``df`` (a materialized table of narrow rows) against ``max_rows``."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
