"""Query-history files: CSV with a fixed set of columns in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headers that a history file must have. Fixed values.
COLUMNS = ("QUERY_ID", "QUERY_TEXT", "START_TIME", "EXECUTION_TIME", "WAREHOUSE_SIZE", "BYTES_SCANNED")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A bad number reads as 0 and a blank size as null; a bad start time is an error."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    names = {c.strip().upper(): c for c in raw.columns}
    missing = [c for c in COLUMNS if c not in names]
    if missing:
        raise ValueError(f"history lacks {', '.join(missing)}")
    c = lambda n: F.col(f"`{names[n]}`")
    number = lambda n: F.coalesce(F.trim(c(n)).try_cast("long"), F.lit(0)).alias(n.lower())
    start = F.to_timestamp(F.trim(c("START_TIME")))
    return raw.select(
        c("QUERY_ID").alias("query_id"), c("QUERY_TEXT").alias("query_text"), start.alias("start_time"), number("EXECUTION_TIME"),
        F.when(F.trim(c("WAREHOUSE_SIZE")) != "", F.trim(c("WAREHOUSE_SIZE"))).alias("warehouse_size"), number("BYTES_SCANNED"),
    )


def recent(history: DataFrame, now: str, days: int = 30, limit: int | None = None) -> DataFrame:
    """Successful queries of the last days, newest first."""
    out = history.where(F.col("start_time") >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(days)} DAY"))
    if "error_code" in history.columns:
        out = out.where(F.col("error_code").isNull())
    out = out.orderBy(F.col("start_time").desc(), "query_id")
    return out.limit(limit) if limit else out
