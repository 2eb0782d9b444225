"""Joins on time: the last row before each moment, and rows within a span of each other.

Both deal rows out by key and slice of time, so that a key with many rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, value: list[str], slice_seconds: int = 86_400, prefix: str = "") -> DataFrame:
    """left with the columns `value` of the latest right row of its key at or before its time, null if none.

    Within a slice the latest row is found by a window; rows before it get the last row of an earlier slice,
    found over one row per key and slice. Of right rows with one time that with the greatest values counts.
    """
    width = slice_seconds * 1_000_000
    held = F.struct(_micros(F.col(at)).alias("_at"), *[F.col(v).alias(v) for v in value])
    r = right.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), _micros(F.col(at)).alias("_t"), held.alias("_held"))
    r = r.withColumn("_slice", F.floor(F.col("_t") / width)).groupBy("_key", "_slice", "_t").agg(F.max("_held").alias("_held"))
    rows = left.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), _micros(F.col(at)).alias("_t")).withColumn("_slice", F.floor(F.col("_t") / width))
    both = rows.withColumn("_held", F.lit(None).cast(r.schema["_held"].dataType)).unionByName(r.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    # at one time right rows come first, so that they count for left rows of that time
    order = Window.partitionBy("_key", "_slice").orderBy("_t", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_here", F.last("_held", ignorenulls=True).over(order)).where(F.col("_row").isNotNull())
    # one row per key and slice of either side: what came before the slice
    lasts = both.groupBy("_key", "_slice").agg(F.max("_held").alias("_last"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(F.col("_key").alias("_k"), F.col("_slice").alias("_s"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    out = seen.join(carried, (F.col("_key") == F.col("_k")) & (F.col("_slice") == F.col("_s")), "left").withColumn("_got", F.coalesce("_here", "_carried"))
    return out.select("_row.*", *[F.col(f"_got.{v}").alias(prefix + v) for v in value])


def band_join(left: DataFrame, right: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """(l, r) of rows with one key whose right time is after the left one, by at most so many seconds.

    Slices are as wide as the band: a left row meets the right rows of its own slice and the next one, instead
    of all rows of its key.
    """
    width = seconds * 1_000_000
    cell = F.floor(_micros(F.col(at)) / width)
    a = left.select(F.struct("*").alias("l"), F.col(key).alias("_ka"), _micros(F.col(at)).alias("_ta"), F.explode(F.array(cell, cell + 1)).alias("_ca"))
    b = right.select(F.struct("*").alias("r"), F.col(key).alias("_kb"), _micros(F.col(at)).alias("_tb"), cell.alias("_cb"))
    near = (F.col("_tb") > F.col("_ta")) & (F.col("_tb") <= F.col("_ta") + width)
    return a.join(b, (F.col("_ka") == F.col("_kb")) & (F.col("_ca") == F.col("_cb")) & near).select("l", "r")
