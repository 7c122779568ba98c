"""Incremental sync as a stream: new files and events, in micro-batches.

The batch operators do the work; a stream only decides what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexforge.sources.files import BLOCKS, parse


def stream_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """A stream of files (path, file_type, hash, content) below a folder."""
    from lexforge.sources.files import SUFFIXES

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    kinds = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return files.withColumn("file_type", kinds[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))]).filter("file_type IS NOT NULL").select("path", "file_type", F.sha2("content", 256).alias("hash"), "content")


def sync(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse what is new below ``root`` and append its blocks to ``out``; the
    checkpoint remembers which files were read. Stops when there is no more."""
    blocks = parse(stream_files(spark, root))
    return blocks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_stats(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean values of events (ts, event_type, value) by window; rows
    later than ``late`` behind the newest are left out of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


__all__ = ["BLOCKS", "stream_files", "sync", "windowed_stats"]
