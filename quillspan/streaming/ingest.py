"""Continuous ingestion: arriving files or rows enter the index as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from quillspan.plans.sync import Catalog, apply_files
from quillspan.profiles import EXTENSIONS


def watch_folder(spark: SparkSession, root: str, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """New files below ``root`` go through the same function as a batch run.

    A file source reports additions only; changes and removals need ``sync_index``.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    catalog = Catalog(spark, folder)
    base = root.rstrip("/")

    def take(batch: DataFrame, _: int) -> None:
        path = F.regexp_replace("path", "^file:/*", "/")
        name = F.element_at(F.split(path, "/"), -1)
        listing = batch.select(
            path.alias("source_path"), F.substr(path, F.lit(len(base) + 2)).alias("relative_path"), name.alias("source_name"),
            F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        ).filter(F.col("extension").isin(*EXTENSIONS) & ~F.col("source_name").startswith("~$"))
        apply_files(catalog, listing)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def once_each(stream: DataFrame, key: str, arrival: str, delay: str = "1 hour") -> DataFrame:
    """A stream in which rows sent twice within the delay come once."""
    return stream.withWatermark(arrival, delay).dropDuplicatesWithinWatermark([key])


class Progress(StreamingQueryListener):
    """Hands the rows of every finished batch to a function."""

    def __init__(self, tell: Callable[[int, int], None]) -> None:
        self._tell = tell

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self._tell(event.progress.batchId, event.progress.numInputRows)

    def onQueryTerminated(self, event) -> None: ...
