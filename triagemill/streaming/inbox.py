"""Streaming twins: an inbox folder, deduplication by link, retention, and the feedback fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.operators.triage import EFFECTS, REGISTERS, judged
from triagemill.sources.mail import parse_file


def inbox(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """A stream of parsed files, so many of them a batch at most."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files)
    files = source.load(folder)
    files = files.where(F.lower("path").rlike(r"\.(html|htm|eml)$"))
    return files.select("path", "modificationTime", parse_file("path", "content").alias("p")).select("path", "modificationTime", "p.*").where("text IS NOT NULL")


def first_seen(stream: DataFrame, key: str, time: str, kept: str = "90 days") -> DataFrame:
    """The first row of each key, remembered as long as rows are retained."""
    return stream.withWatermark(time, kept).dropDuplicatesWithinWatermark([key])


def fold_state(log: DataFrame, key: str = "job_id") -> DataFrame:
    """The feedback fold as a running aggregate (output mode update or complete): each register is the value of its latest event,
    so that the order of arrival doesn't matter."""
    registers = []
    for i, name in enumerate(REGISTERS):
        value = F.when(F.lit(False), 0)
        for event, effect in EFFECTS.items():
            if effect[i] is not None:
                value = value.when(F.col("event") == event, effect[i])
        registers.append(F.coalesce(F.max_by(value, F.when(value.isNotNull(), F.struct("ts", "event_id"))), F.lit(0)).alias(name))
    return judged(log.groupBy(key).agg(*registers))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and event-time window, late ones within the watermark counted."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
