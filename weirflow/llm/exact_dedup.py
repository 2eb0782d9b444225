"""Exact dedup by two-pass Bloom filtering.

Pass 1 reads the text hashes and counts, up to two, how often each position of a Bloom filter is hit.
Pass 2 tests each hash: unless all of its positions were hit twice it is certainly unique and its row
passes straight through. Only possibly repeated rows shuffle, and there they are compared by SHA-256.

The filter has BITS_PER_ROW bits a row, at most MAX_BITS (128 MB, the size broadcast). Beyond 67 million
rows the hashes are tested in slices of their range, a filter of that size each, so that no filter fills
up; each slice reads the column of hashes again. Groups of any size are summed before the shuffle, and
large ones are joined back by broadcast of a bounded number of rows.

Defined cases: null counts as empty text, so null and '' are equal; of equal texts the largest doc_id
stays, a null id loses to any other, and of rows that share that id as well just one stays; an empty
table gives an empty result; other columns are carried by `drop_copies` and never clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_marked, join_groups, staged

BITS_PER_ROW = 16
MAX_BITS = 1 << 30
SEGMENT = 1 << 16


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    h = h.astype(np.uint64)
    other = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)
    return np.stack([h & np.uint64(bits - 1), other & np.uint64(bits - 1)]).astype(np.int64)


def _hits(bits: int):
    def run(batches):
        hits = [np.zeros(0, np.int64)]
        for b in batches:
            first, second = _positions(b.column(0).to_numpy(zero_copy_only=False), bits)
            # a row whose two positions fall together counts as one hit
            hits += [first, second[first != second]]
        pos, n = np.unique(np.concatenate(hits), return_counts=True)
        seg = pos // SEGMENT
        edges = np.flatnonzero(np.diff(seg, prepend=-1, append=-1))
        rows = [(int(seg[a]), (pos[a:z] % SEGMENT).astype(np.uint16).tobytes(), np.minimum(n[a:z], 2).astype(np.uint8).tobytes()) for a, z in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_pylist([{"segment": s, "pos": p, "hits": c} for s, p, c in rows], pa.schema([("segment", pa.int32()), ("pos", pa.binary()), ("hits", pa.binary())]))

    return run


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SEGMENT, np.uint8)
    for pos, hits in zip(part["pos"], part["hits"], strict=True):
        at = np.frombuffer(pos, np.uint16)
        total[at] = np.minimum(total[at] + np.frombuffer(hits, np.uint8), 2)
    return pd.DataFrame({"segment": [int(part["segment"].iloc[0])], "twice": [np.packbits(total == 2).tobytes()]})


def bloom(hashes: DataFrame, rows: int):
    """From a one-column table of longs, a column function that tells which may occur twice, and its filter."""
    bits = SEGMENT
    while bits < min(rows * BITS_PER_ROW, MAX_BITS):
        bits *= 2
    hits = hashes.mapInArrow(_hits(bits), "segment int, pos binary, hits binary")
    twice = np.zeros(bits // 8, np.uint8)
    for r in hits.groupBy("segment").applyInPandas(_merge, "segment int, twice binary").collect():  # at most the filter
        at = r["segment"] * SEGMENT // 8
        twice[at : at + SEGMENT // 8] = np.frombuffer(r["twice"], np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(twice)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        both = np.ones(len(h), bool)
        for p in _positions(h.to_numpy(), bits):
            both &= (shared.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(both)

    return test, shared


def flagged(rows: DataFrame, total: int) -> tuple[DataFrame, list]:
    """rows with `maybe`: whether their hash `h` may occur twice; and the filters that tell it."""
    slices = max(1, -(-total * BITS_PER_ROW // MAX_BITS))
    if slices == 1:
        test, held = bloom(rows.select("h"), total)
        return rows.withColumn("maybe", test("h")), [held]
    # by the highest bits, as filters take the lowest
    slice_of = F.shiftrightunsigned("h", 32) % slices
    parts, filters = [], []
    for k in range(slices):
        part = rows.filter(slice_of == k)
        test, held = bloom(part.select("h"), -(-total // slices))
        parts.append(part.withColumn("maybe", test("h")))
        filters.append(held)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every, filters


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return docs.select(F.col(doc_id).alias("doc_id"), sha.alias("sha")).withColumn("h", _short("sha"))


def _short(sha: str):
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def resolve(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document."""
    rows = staged(_hashed(docs, doc_id, text).withColumn("rid", F.monotonically_increasing_id()), "hashes")
    total = rows.count()
    tested, _ = flagged(rows, total)
    unique = tested.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    repeated = staged(tested.filter("maybe").select("doc_id", "sha", "rid"), "repeated")
    groups = repeated.groupBy("sha").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("keep"))
    joined = join_groups(repeated, staged(groups, "groups"), "sha", "group_size", total)
    joined = joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "sha")
    return unique.unionByName(joined).withColumnRenamed("sha", "text_sha256")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, all columns; texts that go, or are certainly unique, are not shuffled."""
    rows = staged(_hashed(docs, doc_id, text), "hashes")
    tested, _ = flagged(rows, rows.count())
    same = staged(tested.filter("maybe").groupBy("sha", "doc_id").agg(F.count("*").alias("times")), "repeated")
    groups = same.groupBy("sha").agg(F.sum("times").alias("copies"), F.max(F.struct("doc_id")).alias("keep")).filter("copies > 1").drop("copies")
    # a group's ids are as many rows here as they are in it: only ids move, and adaptive execution splits the join
    marked = same.join(groups, "sha").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))).filter("NOT stays OR times > 1")
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    keys = rows.select(F.col("doc_id").alias("id"), F.col("sha").alias("key"))
    return drop_marked(docs, F.col(doc_id), key, keys, marked.select(F.col("doc_id").alias("id"), F.col("sha").alias("key"), "stays"))
