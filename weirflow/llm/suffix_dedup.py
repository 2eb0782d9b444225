"""Removal of repeated passages by merging Burrows-Wheeler transforms of shards.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else. Suffixes are
not sorted over the corpus; work goes where repeats can be:

1. Anchors. Each window of LENGTH bytes has an anchor, the leftmost of its GRAM-byte strings with the
   least hash; neighbouring windows share it. Equal windows have equal anchors at equal places, so a
   window can only be repeated where its anchor is. A first scan counts anchors; a second one takes the
   pieces of repeated anchors, a piece being the bytes of all windows that an occurrence serves. Equal
   pieces are counted, and their bytes sent once per task.
2. Merge. The distinct pieces of each repeated anchor meet in one task. Those of each shard (input
   partition) get a Burrows-Wheeler transform, over an alphabet of STEP-byte symbols so that LENGTH
   bytes are DEPTH symbols; the shards' transforms are merged by refining their interleave: the merged
   order by h symbols, read as transform symbols and sorted stably, is the order by h + 1. Where a
   boundary between neighbours first appears tells their common prefix; neighbours without one after
   DEPTH rounds share LENGTH bytes, and runs of them are the repeated intervals.
3. The windows found are mapped back to documents, and joined to texts only for documents that have
   any. All others pass straight through.

An anchor with more than HOT distinct pieces is split: windows are divided by their offset from the
anchor into blocks, and by the bytes that all windows of a block share, which equal windows have in
common. Where even that leaves more than HOT distinct parts (long common passages around a part that
always differs), the parts are split into single windows: those with one occurrence by hash are not
repeated, and each other distinct one is merged by itself. Equal parts are counted before they meet, so
no task holds a group of unbounded size.

Hashes are 64 bits wide. Broadcast filters are of bounded size; where one fills up, more occurrences meet
the join behind it. Defined cases: null text is empty; shorter texts than LENGTH bytes stay whole; matches
never cross documents; repeated rows match each other and lose all long enough to match; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_filter, passes, passing, staged, unstage

LENGTH = 200
GRAM = 64
STEP = 25
DEPTH = LENGTH // STEP
HOT = 512
OFFSETS = 16
CHUNK = 1 << 18
SHARDS = 4
MERGE_BYTES = 60_000
#: A random 64-bit value for each byte, and an odd multiplier for each doubling of the width.
_BYTES = np.random.default_rng(1).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_ODD = np.random.default_rng(2).integers(0, 1 << 63, 32, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each position on, built by doubling: a sum of the bytes' values, each
    times what its place makes of the multipliers, then mixed."""
    h, width, out, done, level = _BYTES[data], 1, None, 0, 0
    while True:
        if size & width:
            if out is None:
                out = h.copy()
            else:
                out = out[: len(h) - done] * _ODD[level + 16]
                out += h[done:]
            done += width
        if width * 2 > size:
            out = out[: max(0, len(data) - size + 1)]
            out ^= out >> np.uint64(32)
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
            return out
        far = h[width:]
        h = h[: len(h) - width] * _ODD[level]
        h += far
        width, level = width * 2, level + 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def occurrences(data: np.ndarray, ends: np.ndarray):
    """Anchor occurrences of texts laid end to end: (text, anchor hash, anchor place, first and last window start)."""
    if len(data) < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    g = gram_hashes(data, GRAM)
    place_bits = np.uint64(24)
    packed = (g >> place_bits << place_bits) | np.arange(len(g), dtype=np.uint64)
    least = (sliding_min(packed, LENGTH - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(least)]
    valid = np.arange(len(least)) + LENGTH <= ends[text]
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    # a run of windows ends before the next run or where its text has no further window
    last = np.minimum(np.append(first[1:], len(least)) - 1, ends[text[first]] - LENGTH)
    return text[first], g[least[first]].view(np.int64), least[first], first, last


def _chunks(batches, id_columns: int):
    """(rows of ids, joined bytes, ends, place of each part in its text): texts longer than a chunk in overlapping parts."""
    ids, parts, shift, size = [], [], [], 0
    for b in batches:
        keys = list(zip(*(b.column(i).to_pylist() for i in range(id_columns)), strict=True))
        for key, t in zip(keys, b.column(id_columns), strict=True):
            raw = t.as_py() or b""
            for a in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):
                part = raw[a : a + CHUNK + LENGTH - 1]
                if len(part) < LENGTH:
                    continue
                ids.append(key)
                parts.append(part)
                shift.append(a)
                size += len(part)
                if size >= CHUNK:
                    yield ids, b"".join(parts), np.cumsum([len(p) for p in parts]), shift
                    ids, parts, shift, size = [], [], [], 0
    if ids:
        yield ids, b"".join(parts), np.cumsum([len(p) for p in parts]), shift


def count_anchors(docs: DataFrame) -> DataFrame:
    """Staged (anchor) of the repeated anchors of (…, binary text)."""

    def run(batches):
        for _, raw, ends, _ in _chunks(batches, 2):
            u, n = np.unique(occurrences(np.frombuffer(raw, np.uint8), ends)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["anchor", "n"])

    seen = docs.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return staged(seen.filter("n > 1").select("anchor"), "anchors")


def repeated_occurrences(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Staged (doc_id, did, anchor, piece, first, place, shard, body): occurrences of anchors that pass the
    filter; body, the piece's bytes, once per task."""
    every = id_filter(anchors, anchors.count())

    def run(batches):
        from pyspark import TaskContext

        shard, sent = TaskContext.get().partitionId(), set()
        for ids, raw, ends, shift in _chunks(batches, 2):
            text, anchor, place, first, last = occurrences(np.frombuffer(raw, np.uint8), ends)
            ok = passes(every.value, anchor)
            text, anchor, place, first, last = (x[ok] for x in (text, anchor, place, first, last))
            begins = np.concatenate([[0], ends[:-1]])[text]
            view, piece, body = memoryview(raw), [], []
            for a, z in zip(first.tolist(), (last + LENGTH).tolist(), strict=True):
                piece.append(xxhash.xxh3_64_intdigest(view[a:z]))
                fresh = piece[-1] not in sent
                body.append(raw[a:z] if fresh else None)
                if fresh and len(sent) < 500_000:
                    sent.add(piece[-1])
            moved = np.array(shift, np.int64)[text] - begins
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[t][0] for t in text.tolist()], pa.int64()), pa.array([ids[t][1] for t in text.tolist()], pa.int64()), pa.array(anchor),
                    pa.array(np.array(piece, np.uint64).view(np.int64)), pa.array(first + moved), pa.array(place - first, pa.int64()),
                    pa.array([shard] * len(text), pa.int32()), pa.array(body, pa.binary()),
                ],
                names=["doc_id", "did", "anchor", "piece", "first", "place", "shard", "body"],
            )

    return staged(docs.mapInArrow(run, "doc_id long, did long, anchor long, piece long, first long, place long, shard int, body binary"), "occurrences", compression="zstd")


def merge_transforms(bodies: list[bytes], shards: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(start of each body in the result, class of the LENGTH bytes from each place on).

    Places are numbered body after body in the order given, which must be by shard, with one place
    beyond each body's last byte. Classes are meaningful where LENGTH bytes are left.
    """
    lens = np.array([len(b) for b in bodies], np.int64)
    starts = np.cumsum(lens + 1) - (lens + 1)
    total = int((lens + 1).sum())
    body = np.repeat(np.arange(len(bodies)), lens + 1)
    within = np.arange(total) - starts[body]
    stop = (starts + lens)[body]
    # symbols: STEP bytes from each place; 0 where fewer are left, the end of a string
    hashes = gram_hashes(np.frombuffer(b"".join(bodies), np.uint8), STEP)
    real = within <= lens[body] - STEP
    symbol = np.zeros(total, np.int64)
    symbol[real] = np.unique(hashes[(np.arange(total) - body)[real]], return_inverse=True)[1] + 1
    kind = np.uint16 if symbol.max(initial=0) < 1 << 16 else np.int64

    owner = np.unique(np.array(shards), return_inverse=True)[1]
    edges = np.append(np.searchsorted(owner[body], np.arange(owner.max(initial=0) + 1)), total)
    order, bwt = [], []
    for a, z in zip(edges[:-1], edges[1:], strict=True):  # each shard's own transform
        rank, at = symbol[a:z], np.arange(a, z)
        for far in (STEP << k for k in range((DEPTH - 1).bit_length())):
            ahead = np.minimum(at + far, total - 1)
            after = np.where(at + far <= stop[a:z], rank[np.minimum(ahead - a, z - a - 1)], 0)
            rank = np.unique(rank * (total + 2) + after, return_inverse=True)[1]
        own = a + np.argsort(rank, kind="stable")
        order.append(own)
        bwt.append(np.where(within[own] >= STEP, symbol[np.maximum(own - STEP, 0)], 0))
    order, bwt = np.concatenate(order), np.concatenate(bwt).astype(kind)

    small = np.uint8 if len(edges) <= 256 else np.uint16 if len(edges) < 1 << 16 else np.int64
    inter = np.repeat(np.arange(len(edges) - 1), np.diff(edges)).astype(small)
    fresh = np.zeros(total, bool)
    fresh[:1] = True
    read = np.empty(total, kind)
    for _ in range(DEPTH):
        read[np.argsort(inter, kind="stable")] = bwt
        move = np.argsort(read, kind="stable")
        group = np.cumsum(fresh)[move]
        inter, seen = inter[move], read[move]
        group[seen == 0] = 0
        fresh = np.ones(total, bool)
        fresh[1:] = (seen[1:] != seen[:-1]) | (group[1:] != group[:-1])
    classes = np.empty(total, np.int64)
    classes[order] = (np.cumsum(fresh) - 1)[np.argsort(inter, kind="stable")]
    return starts, classes


def repeated_windows(bodies: list[bytes], counts: list[int], shards: list[int]) -> list[list[tuple[int, int]]]:
    """Per body the runs (first, last) of window starts whose bytes occur twice or more, counts included."""
    by_shard = sorted(range(len(bodies)), key=lambda i: shards[i])
    starts, classes = merge_transforms([bodies[i] for i in by_shard], [shards[i] for i in by_shard])
    windows = [classes[s : s + len(bodies[i]) - LENGTH + 1] for s, i in zip(starts, by_shard, strict=True)]
    weight = np.bincount(np.concatenate(windows), weights=np.repeat([counts[i] for i in by_shard], [len(w) for w in windows]))
    out: list = [None] * len(bodies)
    for i, w in zip(by_shard, windows, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], weight[w] > 1.5, [False]]).astype(np.int8)))
        out[i] = [(int(a), int(z) - 1) for a, z in zip(edges[::2], edges[1::2], strict=True)]
    return out


_PARTS = "key long, part long, anchor long, piece long, off long, n long, shard int, body binary"
_WINDOWS = "window long, key long, part long, off long, n long, shard int, body binary"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _batch(rows: list, kinds: list, schema: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])


def _split(batches):
    """Pieces of hot anchors to parts, one for each block of offsets."""
    for b in batches:
        rows = []
        for anchor, piece, n, shard, place, body in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            for low in range(0, LENGTH - GRAM + 1, OFFSETS):  # windows that start low to high bytes before the anchor
                high = min(low + OFFSETS - 1, LENGTH - GRAM)
                a, z = max(0, place - high), min(place - low, len(body) - LENGTH)
                if a > z:
                    continue
                # the bytes that all windows of the block have, told by their places around the anchor
                core = body[max(0, place - low) : place - high + LENGTH] if place - low >= 0 else b""
                key = xxhash.xxh3_64_intdigest(core, seed=(anchor + low) & 0xFFFFFFFFFFFFFFFF)
                part = body[a : z + LENGTH]
                rows.append((_signed(key), _signed(xxhash.xxh3_64_intdigest(part)), anchor, piece, a, n, shard, part))
        yield _batch(rows, [pa.int64()] * 6 + [pa.int32(), pa.binary()], _PARTS)


def _single(batches):
    """Parts to their windows."""
    for b in batches:
        for key, part, n, shard, body in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            windows = [body[a : a + LENGTH] for a in range(len(body) - LENGTH + 1)]
            rows = [(_signed(xxhash.xxh3_64_intdigest(w, seed=key & 0xFFFFFFFFFFFFFFFF)), key, part, a, n, shard, w) for a, w in enumerate(windows)]
            yield _batch(rows, [pa.int64()] * 5 + [pa.int32(), pa.binary()], _WINDOWS)


def _merged(batches):
    """Rows sorted by key to runs of repeated windows; keys are merged together until a batch is full."""
    keys, parts, counts, shards, bodies, size = [], [], [], [], [], 0

    def done():
        runs = repeated_windows(bodies, counts, shards)
        flat = [(k, p, a, z) for k, p, r in zip(keys, parts, runs, strict=True) for a, z in r]
        cols = list(zip(*flat, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "part", "a", "z"])

    for b in batches:
        for k, p, n, s, body in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if size > MERGE_BYTES and k != keys[-1]:
                yield done()
                keys, parts, counts, shards, bodies, size = [], [], [], [], [], 0
            keys.append(k)
            parts.append(p)
            counts.append(n)
            shards.append(s % SHARDS)
            bodies.append(body)
            size += len(body) + 1
    if keys:
        yield done()


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, did, start, stop): repeated byte ranges of (doc_id, did, binary text), which may overlap."""
    anchors = count_anchors(docs)
    found = repeated_occurrences(docs, anchors)
    # pieces are counted before they meet at their anchor, so that a frequent anchor's copies are spread
    pieces = found.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min("shard").alias("shard"), F.min("place").alias("place"), F.max("body").alias("body"))
    pieces = staged(pieces.join(anchors, "anchor", "left_semi"), "pieces", compression="zstd")
    unstage(anchors)
    places = staged(found.select("doc_id", "did", "anchor", "piece", "first"), "places")
    unstage(found)
    hot = staged(pieces.groupBy("anchor").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > HOT).select("anchor"), "hot")
    cold = pieces.join(hot, "anchor", "left_anti").select(F.col("anchor").alias("key"), F.col("piece").alias("part"), "n", "shard", "body")
    parts = staged(pieces.join(hot, "anchor", "left_semi").select("anchor", "piece", "n", "shard", "place", "body").mapInArrow(_split, _PARTS), "parts", compression="zstd")
    alike = parts.groupBy("key", "part").agg(F.sum("n").alias("n"), F.min("shard").alias("shard"), F.max("body").alias("body"))
    alike = staged(alike, "alike", compression="zstd")
    large = staged(alike.groupBy("key").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > HOT).select("key"), "large")
    windows = staged(alike.join(large, "key", "left_semi").select("key", "part", "n", "shard", "body").mapInArrow(_single, _WINDOWS), "windows", compression="zstd")
    again = windows.groupBy("window").agg(F.sum("n").alias("n"), F.min("shard").alias("shard"), F.max("body").alias("body")).filter("n > 1")
    groups = cold.unionByName(alike.join(large, "key", "left_anti")).unionByName(again.select(F.col("window").alias("key"), F.col("window").alias("part"), "n", "shard", "body"))
    runs = groups.select("key", "part", "n", "shard", "body").repartition("key").sortWithinPartitions("key").mapInArrow(_merged, "key long, part long, a long, z long")
    runs = staged(runs, "runs")
    # back from windows to parts, from parts to pieces, and from pieces to places
    single = windows.select("window", "key", "part", "off").join(runs.select(F.col("key").alias("window"), F.col("part").alias("same")), "window").filter("same = window")
    of_parts = runs.unionByName(single.select("key", "part", F.col("off").alias("a"), F.col("off").alias("z")))
    of_hot = parts.select("key", "part", "anchor", "piece", "off").join(of_parts, ["key", "part"]).select("anchor", "piece", (F.col("a") + F.col("off")).alias("a"), (F.col("z") + F.col("off")).alias("z"))
    of_cold = runs.join(hot, F.col("key") == F.col("anchor"), "left_anti").select(F.col("key").alias("anchor"), F.col("part").alias("piece"), "a", "z")
    of_pieces = staged(of_cold.unionByName(of_hot).groupBy("anchor", "piece").agg(F.collect_set(F.struct("a", "z")).alias("runs")), "found")
    unstage(pieces, alike, windows, parts, hot, large, runs)
    out = places.join(of_pieces, ["anchor", "piece"]).select("doc_id", "did", "first", F.explode("runs").alias("r"))
    return out.select("doc_id", "did", (F.col("first") + F.col("r.a")).alias("start"), (F.col("first") + F.col("r.z") + LENGTH).alias("stop"))


def _cut(raw: bytes, ranges: list) -> tuple[int, int, bytes]:
    """(bytes removed, removed runs, what is left)."""
    removed = runs = at = 0
    left, stop = [], 0
    for a, z in sorted((r["start"], r["stop"]) for r in ranges or ()):
        if a > stop or not runs:
            left.append(raw[at:a])
            runs, removed = runs + 1, removed + z - a
            at = stop = z
        elif z > stop:
            removed += z - stop
            at = stop = z
    left.append(raw[at:])
    return removed, runs, b"".join(left)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row per document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("did"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    ranges = staged(spans(rows), "spans")
    # equal rows have equal ranges, which count once: a text has fewer of them than bytes
    cuts = staged(ranges.groupBy("did", "doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")), "cuts")
    unstage(ranges)
    may_have = passing(id_filter(cuts.select("did"), cuts.count()))

    out = [F.col("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")]
    rows = rows.withColumn("hit", may_have("did"))
    whole = rows.filter(~F.col("hit")).select(*out, *[F.col("text").alias("kept")] * with_text)

    def run(batches):
        for b in batches:
            got = []
            for i, raw, ranges in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                removed, n, left = _cut(raw, ranges)
                got.append((i, len(raw), removed, n, hashlib.sha256(left).hexdigest(), left)[: 5 + with_text])
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*got, strict=True)) or [()] * len(kinds), kinds, strict=True)], names=names)

    named = cuts.withColumnRenamed("doc_id", "cut_id").withColumnRenamed("did", "cut_did")
    joined = rows.filter("hit").join(named, (F.col("did") == F.col("cut_did")) & F.col("doc_id").eqNullSafe(F.col("cut_id")), "left")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return whole.unionByName(joined.select("doc_id", "text", "ranges").mapInArrow(run, kind))
