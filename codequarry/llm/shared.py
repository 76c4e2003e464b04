"""What the operators share: table access, the shared folder, and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of output after which a Python operator hands a batch back to the JVM.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all of Spark is one process, as in tests, may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codequarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder[len("file://"):], ignore_errors=True)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here, and lost executors cost nothing.

    The files are removed when the Spark session ends, or by `forget`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _file(spark, path)
    files.deleteOnExit(target)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def forget(written: DataFrame) -> None:
    """Remove a materialised table that nothing reads any more."""
    target, files = _file(written.sparkSession, written.written_to)
    files.delete(target, True)
    files.cancelDeleteOnExit(target)


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more: it does so when the driver's garbage is collected."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker gives unused memory back: workers are kept for later tasks, of other operators too.

    Texts are wide, so the session's Arrow batches are held to BATCH_ROWS rows."""
    spark = SparkSession.getActiveSession()
    if spark and int(spark.conf.get(_ROWS)) > BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


def texts(column: pa.Array) -> list[str]:
    """Values of a string column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def rebatch(rows: Iterable[tuple], schema: pa.Schema, size=None, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples. `size(row)` gives a row's bytes, so that wide rows make short batches."""
    kept: list[tuple] = []
    total = 0
    for row in rows:
        kept.append(row)
        total += size(row) if size else 0
        if len(kept) >= most_rows or total >= BATCH_BYTES:
            yield columns(kept, schema)
            kept, total = [], 0
    if kept:
        yield columns(kept, schema)


def columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes, one row at least."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
