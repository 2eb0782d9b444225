"""Change-data-capture merge: batches of (__action, __row_id, source columns) applied to a table.

For each row id of a batch: with any INSERT the row is replaced by the batch's INSERT rows, else it is
removed. An update is a DELETE and an INSERT with one id. Applying a batch twice changes nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

ACTION, ROW_ID = "__action", "__row_id"


def empty_like(spark: SparkSession, batch: DataFrame) -> DataFrame:
    """A table of a batch's shape, without rows."""
    return spark.createDataFrame([], batch.drop(ACTION).schema)


def merge(base: DataFrame, batch: DataFrame) -> DataFrame:
    """The table after the batch. New columns are added and null in old rows; columns are never dropped."""
    inserts = batch.where(F.col(ACTION) == "INSERT").drop(ACTION)
    gone = batch.select(ROW_ID).distinct()
    return base.join(gone, ROW_ID, "left_anti").unionByName(inserts, allowMissingColumns=True)


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last commit's rows of each key: pairs that a file stream has split or reordered come right."""
    last = F.max(order).over(Window.partitionBy(key))
    return changes.withColumn("_last", last).where(F.col(order) == F.col("_last")).drop("_last")


def counters(batch: DataFrame) -> DataFrame:
    """inserted, deleted and updated; updated only where inserts equal deletes."""
    n = batch.agg(F.count_if(F.col(ACTION) == "INSERT").alias("inserts"), F.count_if(F.col(ACTION) == "DELETE").alias("deletes"))
    same = (F.col("inserts") == F.col("deletes")) & (F.col("deletes") > 0)
    return n.select(F.when(same, 0).otherwise(F.col("inserts")).alias("rows_inserted"), F.when(same, F.col("inserts")).otherwise(0).alias("rows_updated"), F.when(same, 0).otherwise(F.col("deletes")).alias("rows_deleted"))


def infer_action(batch: DataFrame) -> DataFrame:
    """The majority action of a batch; ties go to DELETE, an UPDATE counts with the inserts' side of its own."""
    n = batch.agg(
        F.count_if(F.upper(ACTION) == "INSERT").alias("i"), F.count_if(F.upper(ACTION) == "DELETE").alias("d"), F.count_if(F.upper(ACTION).startswith("UPDATE")).alias("u")
    )
    return n.select(F.when((F.col("d") >= F.col("i")) & (F.col("d") >= F.col("u")), "DELETE").when(F.col("u") >= F.col("i"), "UPDATE").otherwise("INSERT").alias("action"))


def envelope_to_batch(messages: DataFrame, columns: T.StructType, key: str = "id") -> DataFrame:
    """JSON envelopes {action, before, after} with (offset) to a merge batch, the last event of a key winning.

    UPDATE deletes before's key (after's if before is missing) and inserts after. Unknown actions and
    malformed messages are skipped. Values stay text where the column is a string, objects as JSON.
    """
    shape = T.StructType([T.StructField("action", T.StringType()), T.StructField("before", columns), T.StructField("after", columns)])
    m = messages.select("offset", F.from_json("value", shape).alias("m")).select("offset", F.upper("m.action").alias("action"), "m.before", "m.after")
    names = columns.fieldNames()
    old, new = F.col(f"before.{key}"), F.col(f"after.{key}")

    def rows(cond: Column, action: str, side: str, rid: Column) -> DataFrame:
        return m.where(cond & rid.isNotNull()).select("offset", F.lit(action).alias(ACTION), rid.cast("string").alias(ROW_ID), *[F.col(f"{side}.{n}").alias(n) for n in names])

    parts = rows(F.col("action") == "INSERT", "INSERT", "after", new)
    parts = parts.unionByName(rows(F.col("action") == "DELETE", "DELETE", "before", old))
    parts = parts.unionByName(rows(F.col("action") == "UPDATE", "DELETE", "after", F.coalesce(old, new)))
    parts = parts.unionByName(rows(F.col("action") == "UPDATE", "INSERT", "after", new))
    return latest(parts, ROW_ID, "offset").drop("offset")


def bootstrap_check(drained: int, source: int) -> str:
    """ok, stream_empty or partial."""
    return "stream_empty" if drained == 0 and source > 0 else "partial" if drained < source else "ok"


def drifted(bodies: DataFrame, stored: DataFrame) -> DataFrame:
    """Views whose body's checksum differs from the stored one."""
    now = bodies.withColumn("checksum", F.sha2("body", 256))
    return now.join(stored.withColumnRenamed("checksum", "stored"), "name").where(~F.col("checksum").eqNullSafe(F.col("stored"))).select("name")


def retained_markers(markers: DataFrame, fresh: DataFrame) -> DataFrame:
    """Write, then retain: fresh markers replace discovered ones, manual pins survive."""
    manual = markers.where(F.col("source") == "manual")
    return fresh.join(manual, ["name", "policy_name"], "left_anti").unionByName(manual)


def backoff(interval: float, waited: float, current: float | None = None, limit: float = 5.0, most: int = 8) -> float:
    """Next pause of the sync loop: doubled, up to interval x most, while the writer waits too long."""
    now = current or interval
    return min(now * 2, interval * most) if waited > limit else interval


def decimal_text(value: Column, precision: int, scale: int) -> Column:
    return value.cast(T.DecimalType(precision, scale)).cast("string")
