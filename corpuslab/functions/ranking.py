"""Global positions without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_position(df: DataFrame, bucket: Column, *order: str, out: str = "position") -> DataFrame:
    """Positions from 0 in the order of (bucket, order).

    Rows are ranked inside each bucket and shifted by the sizes of the buckets before it, so no
    task holds more than a bucket. ``bucket`` must have a few thousand values at most.
    """
    named = df.withColumn("__bucket", bucket)
    sizes = named.groupBy("__bucket").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    ranked = named.withColumn("__in", inside).join(shifts, "__bucket")
    return ranked.withColumn(out, F.col("__before") + F.col("__in")).drop("__bucket", "__in", "__before")
