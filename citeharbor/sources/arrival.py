"""Arrival order of rows read from files: by file, place of the block in it, and row of the block.

Spark packs blocks of many files into tasks, largest first, so task and row number say nothing about
the order in the files. Here each row knows its block; the rows of every block are counted, and the
running total over the blocks in file order gives each block its first number. Numbers are dense and
do not depend on the size of the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = ("_file", "_block", "_task", "_at")
HELD_BLOCKS = 1 << 17  # a longer list of blocks is joined by shuffling


def placed(scan: DataFrame) -> DataFrame:
    """The rows of a plain file scan with their file, block, and place in the task."""
    return scan.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at"))


def numbered(rows: DataFrame, name: str = "seq", size: Column | None = None) -> DataFrame:
    """``name``: number of a row of :func:`placed` in arrival order, from 0; ``_place``: that in its file.

    ``size`` is how many numbers a row takes, 1 by default; it then gets the first of them, and a block
    must be a single row. One narrow pass counts the blocks; their list, as long as the one that Spark
    makes to plan the scan, is put in order on the driver.
    """
    spark = rows.sparkSession
    counted = rows.groupBy("_file", "_block", "_task").agg(
        F.sum(F.lit(1) if size is None else size).cast("long").alias("n"), F.min("_at").alias("first")).collect()
    starts, total, file, begin = [], 0, None, 0
    for row in sorted(counted, key=lambda r: (r["_file"], r["_block"])):
        if row["_file"] != file:
            file, begin = row["_file"], total
        starts.append((file, row["_block"], row["_task"], total - (row["first"] if size is None else 0), begin))
        total += row["n"]
    blocks = spark.createDataFrame(starts, "_file string, _block long, _task int, _shift long, _begin long")
    if len(starts) <= HELD_BLOCKS:
        blocks = F.broadcast(blocks)
    number = F.col("_shift") + (F.col("_at") if size is None else F.lit(0))
    return rows.join(blocks, ["_file", "_block", "_task"], "left").withColumn(name, F.coalesce(
        number, F.raise_error(F.lit("the files or the scan settings changed between two passes")).cast("long"))
    ).withColumn("_place", F.col(name) - F.col("_begin")).drop("_shift", "_begin")
