"""Conversion of files as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import blocks
from quire.plans import render


def watch(spark: SparkSession, folder: str, glob: str = "*.adoc", files_per_batch: int = 1000) -> DataFrame:
    """A stream of doc_id (the file's path) and text, each new file once."""
    found = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return found.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def convert_tree(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes doc_id, html of each batch as Parquet, and ends when no file is left. A batch that is run again replaces its own folder, so files are written exactly once."""

    def write(batch: DataFrame, epoch: int) -> None:
        render.to_html(blocks.parse(batch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, kind: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events per window and kind, late ones up to ``late``; the same on a stream and on a table."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, length).alias("window"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
