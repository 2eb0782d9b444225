"""Words of chunks against plain splitting, and the fixed-size id filter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import common, wordtable


@pytest.mark.parametrize("marks", [False, True])
def test_words_of_texts(marks, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab ,.\n\té!x9\x1c\x0b", k=rng.randint(0, 60))).encode() for _ in range(300)] + [b"", b" ", b"end"]
    for size in (wordtable.CHUNK_BYTES, 10):  # 10: the way of a single huge text
        monkeypatch.setattr(wordtable, "CHUNK_BYTES", size)
        words, at, ends = wordtable.words_of_texts(texts, marks)
        a = 0
        for t, z in zip(texts, ends, strict=True):
            got = [words[i] for i in at[a:z]]
            a = z
            assert b"".join(got) == b"".join(t.split())
            if not marks:
                assert got == t.split()
        assert a == len(at) and len(set(words)) == len(words)
    assert wordtable.words_of_texts([b"don't a.b, c!? ,d"], True)[0].__len__() == 6


def test_id_filter(spark):
    ids = spark.range(5000).selectExpr("xxhash64(id) AS h")
    bits = common.id_filter(ids).value
    inside = np.array([r.h for r in ids.collect()])
    outside = np.array([r.h for r in spark.range(5000, 10000).selectExpr("xxhash64(id) AS h").collect()])
    assert common.passes(bits, inside).all() and common.passes(bits, outside).sum() < 10


def test_id_filter_rows(spark, monkeypatch):
    """Marks are gathered over batches: a row per segment, not one per id, with the same bits at any size."""
    import pyarrow as pa

    ids = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 300_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 1000])], names=["h"]) for a in range(0, len(ids), 1000)]
    assert sum(b.num_rows for b in common._mark(1 << 23)(iter(batches))) <= common.SEGMENTS
    for mark in (common.MARK_IDS, 700):  # 700: many rows for a segment
        monkeypatch.setattr(common, "MARK_IDS", mark)
        df = spark.range(40_000, numPartitions=3).selectExpr("xxhash64(id) AS h")
        bits = common.id_filter(df, 40_000).value
        inside = df.toPandas()["h"].to_numpy()
        want = np.zeros(8 * len(bits), bool)
        want[inside.view(np.uint64) % np.uint64(len(want))] = True
        assert (np.unpackbits(bits) == want).all()
    assert not common.id_filter(spark.range(0).selectExpr("xxhash64(id) AS h")).value.any()


def test_with_ordinal(spark):
    df = spark.createDataFrame([(c,) for c in "zéaB\U0001f600m"] + [(None,)], "s string").repartition(5)
    got = {r.s: r.ordinal for r in common.with_ordinal(df, "ordinal", F.col("s").asc_nulls_last()).collect()}
    assert got == {s: i for i, s in enumerate(sorted("zéaB\U0001f600m") + [None])}
