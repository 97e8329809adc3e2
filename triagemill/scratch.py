"""Cut lineage in the shared folder that the cluster names, and places of rows in an order without one task for all of them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a local folder where it is unset, in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="triagemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """The rows written and read again, so that no later step makes them anew and a lost executor costs no recomputation."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def cut_counted(rows: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """The rows cut, and aggregates of them that were observed as they were written, without another pass."""
    seen = Observation()
    out = cut(rows.observe(seen, *[m.alias(n) for n, m in metrics.items()]))
    return out, seen.get


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with `name`, their place from 1 in an order that tells them apart: ranges of the order are numbered alone and offset by the
    rows of the ranges before, of which there is one a partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_inside", inside).join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn(name, (F.col("_inside") + F.col("_offset")).cast("long")).drop("_part", "_p", "_inside", "_offset")
