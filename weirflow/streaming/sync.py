"""Structured Streaming loop that merges change files into a lake table.

A micro-batch may hold half of an update pair, so changes carry the commit they belong to, and each
target row the last commit that touched it: an older event that arrives late is ignored. A batch that
runs again after a crash finds its number in the table's pointer and does nothing. Tables are divided by
row id, and a batch rewrites only the parts that it touches.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.cdc import ACTION, ROW_ID, backoff
from ..sources.lake import LakeTable, WriteConflict

COMMIT = "__commit"
GONE = "__gone"
PART = "__part"
#: Parts that a merged table is divided into by row id.
PARTS = 32


def apply_batch(base: DataFrame | None, batch: DataFrame) -> DataFrame:
    """State after a batch: rows with their last commit; a deleted id leaves a tombstone that outdates late events.

    State and events are sorted by id once and judged together, each read once. A null id is an id like any other.
    """
    own = [f"`{c}`" for c in batch.columns if c != ACTION]
    insert = F.coalesce(F.col(ACTION) == "INSERT", F.lit(False))
    rows = batch.select(*own, F.lit(False).alias(GONE), F.lit(True).alias("_new"), insert.alias("_insert"))
    if base is not None:
        rows = base.withColumns({"_new": F.lit(False), "_insert": F.lit(False)}).unionByName(rows, allowMissingColumns=True)
    # an id's events come first, the last commit's before the others
    one = Window.partitionBy(ROW_ID).orderBy(F.desc("_new"), F.col(COMMIT).desc_nulls_last(), F.desc("_insert"))
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_event": F.max(F.when(F.col("_new"), F.struct(F.col(COMMIT).alias("at"), F.col("_insert").alias("insert")))).over(whole),
        "_held": F.max(F.when(~F.col("_new"), F.struct(F.col(COMMIT).alias("at"), (~F.col(GONE)).alias("live")))).over(whole),
        "_place": F.row_number().over(one),
    })
    event, held = F.col("_event.at"), F.col("_held.at")
    # a delete that meets the live rows of its own commit is the other half of a split pair
    half = ~F.col("_event.insert") & (event == held) & F.col("_held.live")
    taken = F.coalesce(event.isNotNull() & (held.isNull() | (event >= held)) & ~F.coalesce(half, F.lit(False)), F.lit(False))
    stays = F.when(~F.col("_new"), ~taken).when(F.col("_event.insert"), taken & F.col("_insert") & (F.col(COMMIT) == event)).otherwise(taken & (F.col("_place") == 1))
    grave = F.col("_new") & ~F.col("_insert")
    kept = rows.where(F.coalesce(stays, F.lit(False)))
    names = [c for c in rows.columns if c not in ("_new", "_insert", "_event", "_held", "_place")]
    shown = lambda c: F.col(c) if c in (ROW_ID, COMMIT) else F.col(c) | grave if c == GONE else F.when(~grave, F.col(f"`{c}`"))
    return kept.select(*[shown(c).alias(c) for c in names])


def bucket(parts: int) -> Column:
    return F.pmod(F.xxhash64(ROW_ID), F.lit(parts)).cast("int")


def current(table: LakeTable) -> DataFrame:
    return table.read().where(~F.col(GONE)).drop(GONE, COMMIT)


def merge_batch(table: LakeTable, batch: DataFrame, number: int, parts: int = PARTS) -> bool:
    """Merge a batch into the parts of the table that its ids fall in; False if it had been merged before.

    Only those parts are read and rewritten. `parts` must stay the same over a table's life.
    """
    if number <= table.last_batch:
        return False
    keyed = batch.withColumn(PART, bucket(parts))
    touched = [r[0] for r in keyed.select(PART).distinct().collect()]  # at most `parts` numbers
    base = table.read(touched) if table.exists() else None
    table.write_parts(apply_batch(base, batch).withColumn(PART, bucket(parts)), PART, touched, number)
    return True


def compact(table: LakeTable, before: int, parts: int = PARTS) -> None:
    """Drop tombstones of commits before the given one, which no event may still come for."""
    state = table.state()
    if state:
        held = [int(p) for p in state["parts"]]
        rows = table.read().where(~F.col(GONE) | (F.col(COMMIT) >= before))
        table.write_parts(rows.withColumn(PART, bucket(parts)), PART, held, state["batch"])


class Pace:
    """Pauses between polls: doubled while the writer waits too long for its turn, back to the interval after."""

    def __init__(self, interval: float, limit: float = 5.0, most: int = 8):
        self.interval, self.limit, self.most, self.now = interval, limit, most, interval

    def after(self, waited: float) -> float:
        self.now = backoff(self.interval, waited, self.now, self.limit, self.most)
        return self.now


def poll(step: Callable[[], bool], pace: Pace, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """Run `step` until it says that nothing is left or so many rounds are over; a conflict counts as waiting
    beyond the limit, and the step runs again. Returns the number of steps that merged something."""
    done = n = 0
    while rounds is None or n < rounds:
        n += 1
        began = clock()
        try:
            if not step():
                return done
            done += 1
            waited = clock() - began
        except WriteConflict:
            waited = pace.limit + 1
        sleep(pace.after(waited))
    return done


def start(spark: SparkSession, source: str, schema: T.StructType, table: LakeTable, checkpoint: str, fmt: str = "parquet", once: bool = True, interval: str = "30 seconds", files_per_batch: int = 100, parts: int = PARTS) -> StreamingQuery:
    """Run what is there and stop, or keep polling."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(source)
    writer = stream.writeStream.foreachBatch(lambda batch, number: merge_batch(table, batch, number, parts) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per type and window, with a watermark for late data; streaming and batch alike."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = at.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = at.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), F.col("session_window.end").cast("timestamp_ntz").alias("session_end"), "n")
