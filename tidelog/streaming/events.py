"""Structured Streaming over recordings and timed rows.

All state is bounded by a watermark: rows later than it are dropped, and windows are given once they are past it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.recording import envelopes

#: The columns of Spark's binary file source.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def recording_stream(spark: SparkSession, folder: str, topics: list[str] | None = None, files_per_batch: int = 64) -> DataFrame:
    """Envelopes of recording files as they arrive in a folder; a file is read when it is seen first."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return envelopes(files.select("path", "content"), topics)


def tumbling(rows: DataFrame, time: str, size: str, late: str, keys: list[str], aggregates: list[Column], slide: str | None = None) -> DataFrame:
    """Aggregates of each window of ``size`` (sliding by ``slide``, if given) and key."""
    timed = rows.withWatermark(time, late)
    out = timed.groupBy(F.window(time, size, slide), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *(c for c in out.columns if c not in ("window", *keys)))


def sessions(rows: DataFrame, time: str, gap: str, late: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates of each key's runs of rows that are less than ``gap`` apart."""
    out = rows.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *(c for c in out.columns if c not in ("session_window", *keys)))


def first_seen(rows: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key; a key is forgotten once it is ``late`` behind."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append", partitions: int | None = None) -> None:
    """Runs a stream over all that is there now, into Parquet files that a restart neither loses nor repeats. ``partitions``: of a new
    checkpoint's state (else the session's number of shuffle partitions); a later run keeps them."""
    conf, key = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(key)
    try:
        conf.set(key, str(partitions or before))
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)  # the query has its own copy
    query.awaitTermination()
