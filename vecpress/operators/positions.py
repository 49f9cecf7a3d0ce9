"""Dense positions in a total order, and the row before, without one task that holds everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecpress.session import materialize


def with_position(df: DataFrame, keys: list[str], carry: str | None = None) -> DataFrame:
    """Add ``pos`` (from 0, by ``keys``) and, with ``carry``, ``prev``: that column of the row before.

    Rows are range-partitioned and stored; the number of rows and the last row of each range, one
    row a range, give the ranges' offsets. Within a range, windows do the rest.
    """
    cols = df.columns
    ranged = df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    stored = materialize(ranged, "ranges")
    by = F.struct(*keys)
    ends = stored.groupBy("_range").agg(F.count("*").alias("_n"), F.max_by(F.struct(*([carry] if carry else keys[:1])), by).alias("_last"))
    # one row per range: the window over them is as small as the number of ranges
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.lag("_last").over(Window.orderBy("_range")).alias("_before"))
    w = Window.partitionBy("_range").orderBy(*keys)
    out = stored.withColumn("_row", F.row_number().over(w))
    if carry:
        out = out.withColumn("_prev", F.lag(carry).over(w))
    out = out.join(F.broadcast(offsets), "_range")
    picked = [*cols, (F.col("_start") + F.col("_row") - 1).cast("long").alias("pos")]
    if carry:
        picked.append(F.coalesce("_prev", F.col("_before")[carry]).alias("prev"))
    return out.select(*picked)
