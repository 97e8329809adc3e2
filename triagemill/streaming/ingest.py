"""The inbox as a stream into the table of jobs: every micro-batch is staged whole, then applied, so that a restart anywhere counts each
posting once.

A batch is computed once: what it changes and what it counted stand under its number before the table is touched. Applying that is the
same however often it is done, so that a batch that was cut short after its staging is applied again and not computed again, with the
files that it was made from there or not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from triagemill.operators import extract, state
from triagemill.scratch import cut, numbered
from triagemill.streaming.inbox import inbox

COUNTS = "file string, found long, inserted_new long, skipped_existing long"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def delete_files(spark: SparkSession, files: DataFrame) -> int:
    """Deletes files by their paths, one after another as they come from the cluster; those that are gone already count as none."""
    deleted = 0
    for row in files.toLocalIterator():
        system, target = _file_system(spark, row[0])
        deleted += system.delete(target, False)
    return deleted


def entries_of(docs: DataFrame) -> DataFrame:
    """Postings of parsed files as upserts take them; the order of arrival is that of files and links."""
    found = extract.job_entries(cut(docs), "path").withColumnsRenamed({"link": "position_link", "path": "file"})
    return numbered(found, [F.col("file"), F.col("position_link")], "ord")


def batch_writer(table: str, staged: str, buckets: int = state.BUCKETS, delete: bool = False, apply: Callable[..., int] = state.apply_changes) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: stage, apply, and with `delete` remove the files that postings were found in."""

    def write(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{staged}/batch={number}"
        # The counts are written last; their mark says that the stage is whole.
        if not exists(spark, f"{folder}/counts/_SUCCESS"):
            entries = entries_of(batch.select("path", "title", "text", "links", "html"))
            jobs = state.read_buckets(spark, table)
            asked = [r.bucket for r in entries.select(state.link_bucket(buckets).alias("bucket")).distinct().collect()]
            changed, outcomes = state.upsert_changes(jobs.drop("bucket"), entries, F.current_timestamp(), jobs.where(F.col("bucket").isin(asked)))
            changed.write.mode("overwrite").parquet(f"{folder}/changed")
            state.counted(entries, outcomes).write.mode("overwrite").parquet(f"{folder}/counts")
        apply(spark, table, spark.read.schema(state.JOBS).parquet(f"{folder}/changed"), buckets)
        if delete:
            delete_files(spark, counts(spark, staged, number).where("found > 0").select("file"))

    return write


def counts(spark: SparkSession, staged: str, number: int | None = None) -> DataFrame:
    """(file, found, inserted_new, skipped_existing) of all batches, or of one."""
    return spark.read.schema(COUNTS).parquet(f"{staged}/batch={'*' if number is None else number}/counts")


def follow(spark: SparkSession, folder: str, table: str, staged: str, checkpoint: str, buckets: int = state.BUCKETS, delete: bool = False, once: bool = True, files: int = 1000, **writer) -> StreamingQuery:
    """Starts the stream from a folder of mails into a table of jobs (see state.write_buckets): what is there now (`once`), or on and on."""
    stream = inbox(spark, folder, files).writeStream.foreachBatch(batch_writer(table, staged, buckets, delete, **writer)).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="10 seconds")).start()


class Progress(StreamingQueryListener):
    """Tells of each micro-batch as it ends, from what the engine has counted anyway."""

    def __init__(self, tell: Callable[[str], None] = print):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.tell(f"batch {event.progress.batchId}: {event.progress.numInputRows} files, {event.progress.processedRowsPerSecond:.1f} a second")

    def onQueryTerminated(self, event) -> None:
        pass
