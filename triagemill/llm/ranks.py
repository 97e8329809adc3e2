"""Places of rows in their groups without a task for a group: rows are range-sorted, counted by part, and parts are offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagemill.llm.common import materialize, release


def ranked(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """`rows` with `idx`, the place of each from 0 in the order of its group, and `n`, the group's rows.

    A group with most of all rows is spread over parts by ranges of the order; a part of a group is numbered alone, and a
    window over a group has one row for each of its parts. Rows that tie in the order are numbered in any order: give an order that tells
    apart all rows that differ. Rows alike in everything are spread by a number of their own, so that they are no hot range."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), f"{name}-numbered")
    ordered = numbered.repartitionByRange(parts, F.col(group), *order, F.col("_row")).withColumn("_part", F.spark_partition_id())
    placed = materialize(ordered, f"{name}-placed")
    release(numbered)
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    offsets = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).alias("_offset"), F.sum("_n").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order, "_row")) - 1
    numbered = placed.withColumn("_inside", inside).join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    out = materialize(numbered.select(*[c for c in rows.columns], (F.col("_inside") + F.col("_offset")).alias("idx"), "n"), name)
    release(placed)
    return out
