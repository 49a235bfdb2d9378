"""Running values over an order that no single task holds: range buckets, one summary a bucket, offsets, then each bucket alone.

A hot group (one chromosome, one kind, one file) is spread over many buckets; only its few bucket rows meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ortholens.sources.shared import rewritten


def bucketed(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with `bucket`, which rises along group and order; equal rows share one. Written, so that buckets stay as they are."""
    return rewritten(df.repartitionByRange(*group, *order).withColumn("bucket", F.spark_partition_id()), "buckets")


def _joined(rows: DataFrame, offsets: DataFrame, group: list[str]) -> DataFrame:
    """Rows with the one offset of their bucket and group; null groups are groups."""
    right = offsets.withColumnsRenamed({c: f"__{c}" for c in ("bucket", *group)})
    same = F.col("bucket") == F.col("__bucket")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(right, same).drop(*(f"__{c}" for c in ("bucket", *group)))


def _earlier(group: list[str]) -> Window:
    return Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)


def summed(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Bucketed rows with `name`: the sum of value over the rows before, in the group."""
    valued = rows.withColumn("__value", value)
    sums = valued.groupBy("bucket", *group).agg(F.sum("__value").alias("__sum"))
    offsets = sums.select("bucket", *group, F.coalesce(F.sum("__sum").over(_earlier(group)), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("bucket", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = valued.withColumn("__inner", F.coalesce(F.sum("__value").over(inner), F.lit(0)))
    return _joined(placed, offsets, group).withColumn(name, F.col("__before") + F.col("__inner")).drop("__value", "__before", "__inner")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`: 1, 2, .. along order in each group."""
    rows = bucketed(df, group, order)
    counts = rows.groupBy("bucket", *group).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("bucket", *group, F.coalesce(F.sum("__n").over(_earlier(group)), F.lit(0)).alias("__before"))
    placed = rows.withColumn("__inner", F.row_number().over(Window.partitionBy("bucket", *group).orderBy(*order)))
    return _joined(placed, offsets, group).withColumn(name, F.col("__before") + F.col("__inner")).drop("bucket", "__before", "__inner")


def carried(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Bucketed rows with `name`: the last value that is not null, up to the row itself, in the group."""
    valued = rows.withColumn("__value", value)
    last = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order)))
    lasts = valued.groupBy("bucket", *group).agg(last.alias("__last"))
    offsets = lasts.select("bucket", *group, F.last("__last", ignorenulls=True).over(_earlier(group)).alias("__before"))
    inner = Window.partitionBy("bucket", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = valued.withColumn("__inner", F.last("__value", ignorenulls=True).over(inner))
    return _joined(placed, offsets, group).withColumn(name, F.coalesce("__inner", "__before")).drop("__value", "__before", "__inner")
