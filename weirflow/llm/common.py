"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: ASCII white space, the only word separator in this subpackage.
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"

#: Largest number of rows of a small lookup table that may be broadcast.
BROADCAST_ROWS = 200_000


#: Rows that Spark sends to a Python worker at a time. Its default of 10,000 is meant for short rows:
#: with texts of several kB, buffers on both sides would take hundreds of MB. A second bound is in bytes, for
#: long texts.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


#: Session settings that the operators count on. Shuffle files go once the statement that wrote them has
#: ended: with many statements to an operator they would else pile up until the driver collects garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare_session(spark: SparkSession) -> None:
    """Lower the batch size for Python workers (a smaller one stays) and free shuffle files early."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not (held and int(held[1]) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))
    if spark.conf.get(_FREE_SHUFFLES, None) != "true":
        spark.conf.set(_FREE_SHUFFLES, "true")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir.

    Where the setting is missing, a local master gets a temporary folder; on a cluster, where such a
    folder would be another one on every machine, that is an error.
    """
    prepare_session(spark)
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="weirflow-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(place)
    return place


def _file_system(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM exits."""
    path = f"{shared_dir(spark)}/weirflow/{label}-{uuid.uuid4().hex}"
    jpath, fs = _file_system(spark, path)
    fs.mkdirs(jpath.getParent())
    fs.deleteOnExit(jpath)
    return path


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what came before.
    """
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete what `staged` wrote for tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "staged_at", None):
            jpath, fs = _file_system(df.sparkSession, path)
            fs.delete(jpath, True)


def words_of(text: Column) -> Column:
    """Array of the maximal runs of other than ASCII white space; text must not be null."""
    body = F.btrim(text, F.lit(BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, GAP))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only while the counted number of rows is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_ordinal(df: DataFrame, label: str, *order: Column) -> DataFrame:
    """Stage df with `ordinal`, its 0-based place in the order, without one task seeing all rows.

    Rows are dealt by range; each part is numbered on its own and shifted by the sizes of the parts
    before it. Only one count per part reaches the driver.
    """
    dealt = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    shift, before = [], 0
    for part in sorted(sizes):
        shift.append((part, before))
        before += sizes[part]
    spark = df.sparkSession
    offsets = F.broadcast(spark.createDataFrame(shift or [(0, 0)], "_part int, _before long"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_rank", rank).join(offsets, "_part").withColumn("ordinal", F.col("_before") + F.col("_rank") - 1).drop("_part", "_before", "_rank")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group, safe for groups of any size.

    Groups above `total` / BROADCAST_ROWS rows number fewer than BROADCAST_ROWS, so they can be broadcast
    whatever the input's size. The others join by a shuffle, which adaptive execution may split further.
    """
    cut = max(total // BROADCAST_ROWS, 1000)
    large = F.broadcast(groups.filter(F.col(size) > cut))
    rest = groups.filter(F.col(size) <= cut)
    hot = rows.join(large, key)
    cold = rows.join(F.broadcast(groups.filter(F.col(size) > cut).select(key)), key, "left_anti").join(rest, key)
    return hot.unionByName(cold)


#: Bits of an id filter: about FILTER_SHARE for each id, and at most so many (128 MB, the size broadcast).
FILTER_BITS = 1 << 30
FILTER_SHARE = 16
#: A filter is merged in so many segments. Tasks mark MARK_IDS ids before they send a row per segment, so
#: that rows grow with the ids only, not with the ids and the segments.
SEGMENTS = 256
MARK_IDS = 1 << 20


def _mark(bits: int):
    size = bits // SEGMENTS
    starts = np.arange(SEGMENTS + 1, dtype=np.int64) * size

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        at = np.unique(np.concatenate(held))
        edges = np.searchsorted(at, starts)
        names, cells, packed = [], [], []
        for k in range(SEGMENTS):
            if edges[k] < edges[k + 1]:
                cell = (at[edges[k] : edges[k + 1]] - starts[k]).astype(np.uint32)
                names.append(k)
                packed.append(32 * len(cell) > size)
                cells.append(_packed(cell, size).tobytes() if packed[-1] else cell.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(packed, pa.bool_()), pa.array(cells, pa.binary())], names=["segment", "packed", "at"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy().view(np.uint64) % np.uint64(bits)).astype(np.uint32))
            n += len(held[-1])
            if n >= MARK_IDS:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    return run


def _packed(cell: np.ndarray, size: int) -> np.ndarray:
    on = np.zeros(size, bool)
    on[cell] = True
    return np.packbits(on)


def _merge(bits: int):
    """Of rows sorted by segment one per segment; a task holds one segment's bits at a time."""
    size = bits // SEGMENTS

    def run(batches):
        at, on = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([on.tobytes()], pa.binary())], names=["segment", "bits"])
        for b in batches:
            for k, packed, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if k != at:
                    if at is not None:
                        yield row()
                    at, on = k, np.zeros(size // 8, np.uint8)
                raw = raw.as_py()
                on |= np.frombuffer(raw, np.uint8) if packed else _packed(np.frombuffer(raw, np.uint32), size)
        if at is not None:
            yield row()

    return run


def id_filter(ids: DataFrame, rows: int | None = None):
    """Broadcast bit filter of a one-column table of evenly spread longs; 16 MB unless their number is given.

    `passes(filter.value, ids)` is true for each of them and for few others: one in FILTER_SHARE, or more as
    the ids outnumber what the largest filter holds. Whoever uses it must drop those by a join.
    """
    bits = 1 << 16
    while bits < ((1 << 27) if rows is None else min(rows * FILTER_SHARE, FILTER_BITS)):
        bits *= 2
    held = np.zeros(bits // 8, np.uint8)
    part = bits // SEGMENTS // 8
    marked = ids.mapInArrow(_mark(bits), "segment int, packed boolean, at binary")
    for r in marked.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge(bits), "segment int, bits binary").collect():  # at most the filter's own size
        held[r["segment"] * part : (r["segment"] + 1) * part] = np.frombuffer(r["bits"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(held)


def filter_room() -> int:
    """Ids that the largest filter holds at FILTER_SHARE bits each."""
    return FILTER_BITS // FILTER_SHARE


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids.view(np.uint64) % np.uint64(8 * len(bits))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def passing(bits):
    """The filter as a function of a column of longs."""

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, h.to_numpy()))

    return test


def drop_marked(docs: DataFrame, doc_id: Column, key: Column, keys: DataFrame, marked: DataFrame) -> DataFrame:
    """docs without the rows that are marked for dropping, all columns.

    Rows are told by (id, key). `keys` (id, key) has a row for each row of docs; `marked` (id, key, stays) has
    those that go, and those of which just one of several equal rows stays. Only decisions move: one filter
    clears rows that are certainly not marked, another tells which of the others may yet stay, and only those
    few meet the join with their texts. A null id is an id like any other.
    """
    marked = staged(marked.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "stays"), "marked")
    go = id_filter(marked.select(F.xxhash64("_id", "_key")), marked.count())
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    near = keys.select("id", "key").filter(passing(go)(F.xxhash64("id", "key")))
    stay = staged(near.join(marked.filter("NOT stays"), same, "left_anti").select(F.xxhash64("id", "key").alias("h")).distinct(), "stay")
    remain = id_filter(stay, stay.count())
    unstage(stay)

    @F.pandas_udf("int")  # one function, for one Python worker to a task
    def passed(h: pd.Series) -> pd.Series:
        maybe, kept = passes(go.value, h.to_numpy()), passes(remain.value, h.to_numpy())
        return pd.Series(np.where(maybe, np.where(kept, 2, 1), 0).astype(np.int32))

    rows = docs.select(F.struct("*").alias("row"), doc_id.alias("id"), key.alias("key")).withColumn("passed", passed(F.xxhash64("id", "key")))
    rest = rows.filter("passed = 2").join(marked, same, "left")
    one = rest.filter("stays").groupBy("id", "key").agg(F.first("row").alias("row"))
    out = rows.filter("passed = 0").select("row.*").unionByName(rest.filter("_key IS NULL").select("row.*")).unionByName(one.select("row.*"))
    return out


def tidy() -> None:
    """Give what a task freed back to the system; Python workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass
