"""Cutting lineage in iterative plans: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where all of Spark is one process, as in tests, may it be unset: there a temporary folder serves."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codequarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder[len("file://"):], ignore_errors=True)
    return folder


def cut(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """`df`, written to the shared folder and read back; then the files of earlier tables, which nothing reads any more, go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _file(spark, path)
    files.deleteOnExit(target)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    for old in done:
        if getattr(old, "written_to", None):
            target, files = _file(spark, old.written_to)
            files.delete(target, True)
            files.cancelDeleteOnExit(target)
    return written


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
