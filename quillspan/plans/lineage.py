"""Cutting lineage in a folder that every executor can read.

``checkpoint`` always goes through the reliable checkpoint folder, so a lost
executor costs a re-read and never a recomputation from a missing block.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a session without that setting (a test on one machine) gets a
    temporary folder; a cluster session without it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = "file://" + tempfile.mkdtemp(prefix="quillspan-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_written: list[str] = []


def forget(spark: SparkSession) -> int:
    """Deletes the tables and files that ``stored`` and ``written`` wrote in this process; for when their results have been written or read."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(hadoop).delete(path, True))
    return gone


def written(spark: SparkSession, name: str, content: bytes) -> str:
    """Writes a small file in the shared folder, on whatever storage that is; returns its address."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    _written.append(path.toString())
    return fs.makeQualified(path).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike ``checkpoint`` this keeps column pruning and filter pushdown for the
    later readers, so it is preferred for tables that are read more than once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)
