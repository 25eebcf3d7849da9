"""Row numbers over whole tables without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeharbor.sources.stages import cut

BUCKET_BITS = 16
NULL_BUCKET = -(1 << 47) - 1  # before the bucket of the smallest number


def _running_total(counts: DataFrame, bucket: str, levels: int) -> DataFrame:
    """``bucket, offset``: rows in all earlier buckets.

    Buckets are themselves bucketed, level by level, so each window partition
    holds at most ``2**BUCKET_BITS`` buckets.
    """
    earlier = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    if levels == 0:
        return counts.select(bucket, F.coalesce(F.sum("n").over(
            earlier.partitionBy(F.lit(0))), F.lit(0)).alias("offset"))
    group = f"_group{levels}"
    grouped = counts.withColumn(group, F.shiftright(bucket, BUCKET_BITS))
    upper = _running_total(
        grouped.groupBy(group).agg(F.sum("n").alias("n")), group, levels - 1)
    inner = grouped.withColumn("_inner", F.coalesce(
        F.sum("n").over(earlier.partitionBy(group)), F.lit(0)))
    return (inner.join(upper, group)
            .select(bucket, (F.col("_inner") + F.col("offset")).alias("offset")))


def with_row_id(df: DataFrame, order: str = "seq", name: str = "row_id") -> DataFrame:
    """Add the 0-based position of each row in ``order``, a unique integer; NULLs come first.

    ``order`` is cut into ranges of ``2**BUCKET_BITS`` values. A range holds at
    most that many rows, so ranges are numbered independently and shifted by the
    row count of all earlier ranges. Reads ``df`` twice: pass a stored table.
    """
    ranged = df.withColumn("_bucket", F.coalesce(
        F.shiftright(F.col(order).cast("bigint"), BUCKET_BITS), F.lit(NULL_BUCKET)))
    counts = cut(ranged.groupBy("_bucket").agg(F.count("*").alias("n")))
    offsets = _running_total(counts, "_bucket", levels=2)
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(order)) - 1
    return (ranged.withColumn("_local", local).join(offsets, "_bucket")
            .withColumn(name, F.col("_local") + F.col("offset"))
            .select(name, *df.columns))
