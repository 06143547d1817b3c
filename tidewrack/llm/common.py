"""Work tables and text helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII letters only: other letters keep their case, as bytes.lower() does.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a worker handles at a time.
SLICE_ROWS = 1000
#: Rows of a file of a work table whose number of rows is known.
FILE_ROWS = 200_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none (tests on one machine) is a temporary one set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="tidewrack-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class WorkArea:
    """Tables that cut lineage: written once to the shared folder, then read again.

    A lost executor costs a rerun of the open stage only, since what was written stays readable."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None, per_file: int = FILE_ROWS) -> DataFrame:
        """rows: how many there are at most, if that is known; then they go to no more files than they need.

        Many files of a few rows cost more than the rows: each takes several calls to the store, and processes on some."""
        if rows is not None:
            df = df.coalesce(max(1, math.ceil(rows / per_file)))
        with shuffle_cleanup(self.spark):
            df.write.option("compression", codec).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Shuffle files of the queries run inside go when each query ends, rather than at some later collection."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def in_slices(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over batches of SLICE_ROWS rows at most; a worker gives back the memory that it no longer needs.

    Workers outlive their tasks, and what their allocators keep would add up over the steps of a pipeline."""

    def whole(batches):
        def slices():
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE_ROWS):
                    yield batch.slice(i, SLICE_ROWS)

        try:
            yield from run(slices())
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Frees memory that the allocators of Arrow and of the C library hold for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def utf8(text: str = "text") -> Column:
    """Whole text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))
