"""Brown class-based bigram language model, clustered by distributed exchange.

Training tokens are a text's words (A-Z lower-cased) and one end mark. Every training word gets one of
CLASSES classes (the end mark has class 0 to itself) by its own neighbours:

* exchange rounds: the HEAD most frequent words are units by name, all others units by one of SHAPES groups
  of spelling. Tasks count how often each unit precedes and follows each class; for each block of units the
  gain in log likelihood of moving a unit to each class is evaluated and the best move made. All units may
  move in the first round, alternating halves in later ones, since moves are made at once; a round that
  lowers the likelihood is undone, and the next one moves a smaller share. Rounds end after ROUNDS, or when
  one raises the likelihood by less than GAIN of itself;
* assignment: each other training word, however many there are, is a key of a distributed table with the
  classes before and after each of its tokens, and goes to the class in which these are likeliest. Only words
  that training hasn't seen take the class of their group of spelling.

score = sum of log10 P(class | class before) + log10 P(word | class), both with 0.1 added to counts: a
class spreads its 0.1s over its training words and one unseen word for each group of spelling in it.
perplexity = 10 ** (-score / n_tokens).

Token counts and classes cover all training words. The COUNTED most frequent words are broadcast with count
and class (a fixed bound, about 20 MB a worker); those of all others are found by joins. The driver gets
these bounded tables, class matrices and one class per unit; the corpus is never collected.

Words are told apart by a 58-bit hash beside 6 bits of shape. Defined cases: null text is empty (one
end token); a null id counts as the empty string, which is held out; rows with equal ids are scored one
by one; without training documents every count is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, tidy, unstage
from .wordtable import CHUNK_BYTES, words_of_texts

SHAPES = 64
HEAD = (1 << 16) - 1 - SHAPES
COUNTED = 1 << 20
CLASSES = 64
ROUNDS = 4
GAIN = 0.002
BLOCK = 256
ADD = 0.1
CACHE_WORDS = 200_000
#: Tokens that a worker handles at a time, unless one text has more.
STREAM = 250_000
END = 0
UNKNOWN = 255
_STRIP = b".,;:!?\"'()[]{}|*#$%&"


def shape(word: bytes) -> int:
    """Group of a word by its spelling: kind of characters (4) by last two letters (16)."""
    core = word.strip(_STRIP)
    kind = 3 if any(48 <= c < 58 for c in core) or not core else 2 if core != word else 1 if not core.isascii() else 0
    return kind * 16 + zlib.crc32(core[-2:]) % 16


def word_key(word: bytes) -> int:
    return (xxhash.xxh3_64_intdigest(word) & ~63) | shape(word)


def _texts(batches, text_column: int):
    """(batch, first row, texts) of bounded chunks of rows, A-Z lower-cased."""
    for b in batches:
        first, texts, size = 0, [], 0
        for t in b.column(text_column):
            texts.append((t.as_py() or b"").lower())
            size += len(texts[-1]) + 1
            if size > CHUNK_BYTES:
                yield b, first, texts
                first, texts, size = first + len(texts), [], 0
        if texts:
            yield b, first, texts
    tidy()


def count_words(train: DataFrame) -> DataFrame:
    """(key, n) of the words of a one-column table of binary texts."""

    def run(batches):
        number: dict[bytes, int] = {}
        total = np.zeros(1 << 18, np.int64)

        def flush():
            keys = np.fromiter(map(word_key, number), np.uint64, len(number))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total[: len(number)])], names=["key", "n"])

        for _, _, texts in _texts(batches, 0):
            words, at, _ = words_of_texts(texts)
            names = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            while len(number) > len(total):
                total = np.concatenate([total, np.zeros_like(total)])
            total[names] += np.bincount(at, minlength=len(words))
            if len(number) > CACHE_WORDS:
                yield flush()
                number.clear()
                total[:] = 0
        if number:
            yield flush()

    return train.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, room: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, counts, cut): all words that occur at least `cut` times, at most `room`, by descending count.

    The cut is a power of two or 1; a level that doesn't fit is left out whole, with a cut above all counts
    where already the first doesn't.
    """
    room = COUNTED if room is None else room
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r["level"]: r["words"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()}
    cut = 2 ** (max(sizes, default=0) + 1)
    for at in sorted(sizes, reverse=True):
        room -= sizes[at]
        if room < 0:
            # part of a level: by exact counts, while they fit
            room += sizes[at]
            exact = sorted(((r["n"], r["words"]) for r in counts.where(level == at).groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(10_000).collect()), reverse=True)
            for n, words in exact:
                room -= words
                if room < 0:
                    break
                cut = n
            break
        cut = 2**at
    top = counts.filter(F.col("n") >= cut).toArrow()
    keys, n = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((keys, -n))
    return keys[order], n[order], cut


def _encode(docs: DataFrame, keys: np.ndarray, n: np.ndarray) -> DataFrame:
    """Staged per document: its words as ids, sum of log10(count + 0.1) and number of known ones among the
    counted words, and the keys of all other words. Ids: 1 and up by rank, COUNTED + 1 + shape for others."""
    order = np.argsort(keys)
    table = docs.sparkSession.sparkContext.broadcast((keys[order], np.log10(n[order] + ADD), (1 + order).astype(np.uint32)))

    def run(batches):
        known, logs_of, rank_of = table.value
        for b, first, texts in _texts(batches, 2):
            words, at, ends = words_of_texts(texts)
            new = np.fromiter(map(word_key, words), np.uint64, len(words))
            ids = (COUNTED + 1 + (new & np.uint64(63))).astype(np.uint32)
            logs = np.full(len(new), np.nan)
            if len(known):
                place = np.minimum(np.searchsorted(known, new), len(known) - 1)
                hit = known[place] == new
                ids[hit] = rank_of[place[hit]]
                logs[hit] = logs_of[place[hit]]
            u, x, k = ids[at], logs[at], new[at]
            rows = []
            for a, z in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                seen = ~np.isnan(x[a:z])
                rows.append((u[a:z].tobytes(), int(z - a) + 1, float(x[a:z][seen].sum()), int(seen.sum()), k[a:z][~seen].view(np.int64)))
            cols = list(zip(*rows, strict=True))
            part = b.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(3), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.int64()))],
                names=["rid", "doc_id", "held_out", "units", "n_tokens", "log_sum", "n_seen", "others"],
            )
        tidy()

    out = staged(docs.mapInArrow(run, "rid long, doc_id long, held_out boolean, units binary, n_tokens long, log_sum double, n_seen long, others array<long>"), "units", compression="zstd")
    table.unpersist()
    return out


def _streams(batches, kind: type, *columns: int):
    """(batch, first row, one stream of ids with END before, between and after documents, lengths, other columns)."""
    size = np.dtype(kind).itemsize
    end = bytes(size)
    for b in batches:
        first, held, tokens = 0, [], 0
        for i in range(b.num_rows):
            held.append(b.column(columns[0])[i].as_py())
            tokens += len(held[-1]) // size
            if tokens > STREAM or i == b.num_rows - 1:
                lens = np.array([len(x) // size for x in held], np.int64) + 1
                yield b, first, np.frombuffer(b"".join(end + x for x in held) + end, kind), lens, [b.column(c).slice(first, len(held)) for c in columns[1:]]
                first, held, tokens = i + 1, [], 0
    tidy()


def _profiles(train: DataFrame, classes: np.ndarray, fold: np.ndarray) -> DataFrame:
    """(block, sums): how often each unit of a block is followed and preceded by each class."""
    n_units = HEAD + 1 + SHAPES
    cell = n_units * CLASSES
    shared = train.sparkSession.sparkContext.broadcast((classes.astype(np.int32), fold))

    def run(batches):
        c, fold = shared.value
        total = np.zeros((2, cell), np.uint32)
        for _, _, s, _, _ in _streams(batches, np.uint32, 0):
            # one stream of all documents: END stands between them, as end of one and start of the next
            u = fold[s].astype(np.int32)
            left, right = u[:-1], u[1:]
            for side, cells in enumerate((left * CLASSES + c[right], right * CLASSES + c[left])):
                at, n = np.unique(cells, return_counts=True)
                total[side, at] += n.astype(np.uint32)
        for block in range(0, n_units, BLOCK):
            part = total[:, block * CLASSES : (block + BLOCK) * CLASSES].ravel()
            at = np.flatnonzero(part)
            if len(at):
                blob = zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes() + part[at].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([block // BLOCK], pa.int32()), pa.array([blob], pa.binary())], names=["block", "cells"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 * BLOCK * CLASSES, np.int64)
        block = int(part["block"].iloc[0])
        size = 2 * CLASSES * min(BLOCK, n_units - block * BLOCK)
        for blob in part["cells"]:
            raw = np.frombuffer(zlib.decompress(blob), np.uint32)
            total[np.cumsum(raw[: len(raw) // 2])] += raw[len(raw) // 2 :]
        return pd.DataFrame({"block": [block], "sums": [total[:size].tobytes()]})

    return train.mapInArrow(run, "block int, cells binary").groupBy("block").applyInPandas(add, "block int, sums binary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """Log likelihood of the class bigrams, without the part that no exchange changes."""
    n = matrix.astype(np.float64)
    return float(_xlogx(n).sum() - _xlogx(n.sum(1)).sum() - _xlogx(n.sum(0)).sum())


def best_classes(after: np.ndarray, before: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The class each unit gains most in. after, before: (units, classes) counts; matrix: class bigrams."""
    n = matrix.astype(np.float64)
    left, right = n.sum(1), n.sum(0)
    out = own.copy()
    for u in np.flatnonzero(after.sum(1) + before.sum(1)):
        a, b = after[u].astype(np.float64), before[u].astype(np.float64)
        ja, jb = np.flatnonzero(a), np.flatnonzero(b)
        row = n[:, ja].copy()
        col = n.T[:, jb].copy()
        row[own[u]] -= a[ja]  # the unit leaves its class before it is added to one
        col[own[u]] -= b[jb]
        row, col = np.maximum(row, 0), np.maximum(col, 0)
        la, rb = left.copy(), right.copy()
        la[own[u]] -= a.sum()
        rb[own[u]] -= b.sum()
        gain = (_xlogx(row + a[ja]) - _xlogx(row)).sum(1) + (_xlogx(col + b[jb]) - _xlogx(col)).sum(1)
        gain -= _xlogx(la + a.sum()) - _xlogx(la) + _xlogx(rb + b.sum()) - _xlogx(rb)
        gain[0] = -np.inf  # the end mark's own class
        k = int(np.argmax(gain))
        if gain[k] > gain[own[u]] + 1e-9:
            out[u] = k
    return out


def likeliest(after: np.ndarray, before: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The class in which the neighbours of each word are likeliest, the class bigrams given."""
    n = matrix.astype(np.float64) + ADD
    follow = np.log(n) - np.log(n.sum(1, keepdims=True))  # class after, given this one
    enter = np.log(n) - np.log(n.sum(0, keepdims=True))  # this one after a class, and the word drawn from it
    gain = after @ follow.T + before @ enter
    gain[:, END] = -np.inf
    return gain.argmax(1).astype(np.uint8)


def first_classes() -> np.ndarray:
    """The most frequent units start alone in a class, so that their neighbours can tell others apart."""
    u = np.arange(HEAD + 1 + SHAPES)
    classes = 1 + (u - 1) % (CLASSES - 1)
    classes[END] = 0
    return classes


def _class_sums(classes: np.ndarray):
    """Class bigram counts from the units' sums."""

    def run(batches):
        total = np.zeros((CLASSES, CLASSES), np.int64)
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                after = np.frombuffer(raw.as_py(), np.int64).reshape(2, -1, CLASSES)[0]
                np.add.at(total, classes[block * BLOCK : block * BLOCK + len(after)], after)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "n"])

    return run


def _moves(classes: np.ndarray, matrix: np.ndarray, share: int, t: int):
    """New classes of the units of each block."""

    def run(batches):
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                after, before = np.frombuffer(raw.as_py(), np.int64).reshape(2, -1, CLASSES)
                own = classes[block * BLOCK : block * BLOCK + len(after)]
                new = best_classes(after, before, own, matrix)
                units = block * BLOCK + np.arange(len(own))
                stay = (units == END) | (units % share != t % share)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.where(stay, own, new).astype(np.uint8).tobytes()], pa.binary())], names=["block", "classes"])

    return run


def _collect_matrix(cells: DataFrame) -> np.ndarray:
    out = np.zeros(CLASSES * CLASSES, np.int64)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(CLASSES, CLASSES)


def cluster(train: DataFrame, fold: np.ndarray, rounds: int | None = None, gain: float | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each unit, its class bigrams, likelihoods by round) by exchange over binary id streams.

    fold: the unit of each id. The likelihoods rise: a round that lowers it, as moves made at once can undo
    each other, is undone and the next one moves a smaller share of the units.
    """
    rounds, gain = ROUNDS if rounds is None else rounds, GAIN if gain is None else gain
    classes, best, told, share = first_classes(), None, [], 1
    for t in range(rounds + 1):
        sums = staged(_profiles(train, classes, fold), "profiles")
        matrix = _collect_matrix(sums.mapInArrow(_class_sums(classes), "cell long, n long"))
        now = likelihood(matrix)
        if best is None or now > told[-1]:
            if best is not None:
                unstage(best[2])
                share = max(share, 2)
            small = best is not None and now - told[-1] < gain * abs(told[-1])
            best = classes, matrix, sums
            told.append(now)
            if small:
                break
        else:
            unstage(sums)
            share *= 2
        if t == rounds:
            break
        moved = best[0].copy()
        for r in best[2].repartition("block").mapInArrow(_moves(best[0], best[1], share, t), "block int, classes binary").collect():
            new = np.frombuffer(r["classes"], np.uint8)
            moved[r["block"] * BLOCK : r["block"] * BLOCK + len(new)] = new
        classes = moved
    unstage(best[2])
    return best[0], best[1], told


def assign(train: DataFrame, keys: np.ndarray, by_id: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """(key, n, class) of every training word outside the head, from (units, others).

    A row of the table is a word's tokens in a stretch of text, as the classes before and after each. by_id:
    class of each id, the group's for a word outside the head.
    """
    shared = train.sparkSession.sparkContext.broadcast((keys, by_id))

    def run(batches):
        keys, by_id = shared.value
        for _, _, s, _, (others,) in _streams(batches, np.uint32, 0, 1):
            at = np.flatnonzero(s > HEAD)
            if not len(at):
                continue
            c, ids = by_id[s], s[at]
            k = np.empty(len(at), np.int64)
            named = ids <= COUNTED
            k[named] = keys[ids[named] - 1].view(np.int64)
            k[~named] = np.concatenate([x.values.to_numpy() for x in others if len(x)]) if (~named).any() else k[:0]
            order = np.argsort(k, kind="stable")
            k, at = k[order], at[order]
            cells = np.empty((len(at), 2), np.uint8)
            cells[:, 0], cells[:, 1] = c[at - 1], c[at + 1]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            offsets = np.concatenate([2 * first, [2 * len(k)]]).astype(np.int32)
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(cells.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(k[first]), blobs], names=["key", "cells"])

    def choose(batches):
        held_key, held = None, None  # the last word's sums: the next batch may go on with it
        for b in batches:
            k = b.column(0).to_numpy()
            if not len(k):
                continue
            raw = b.column(1)
            sizes = np.array([len(x.as_py()) for x in raw], np.int64)
            cells = np.frombuffer(b"".join(x.as_py() for x in raw), np.uint8).reshape(-1, 2).astype(np.int64)
            new = np.concatenate([[True], k[1:] != k[:-1]])
            owner = np.repeat(np.cumsum(new) - 1, sizes // 2)
            m = int(new.sum())
            sums = [np.bincount(owner * CLASSES + cells[:, i], minlength=m * CLASSES).reshape(m, CLASSES) for i in (0, 1)]
            words = k[new]
            if held_key is not None:
                if held_key == words[0]:
                    sums = [np.concatenate([(x[:1] + h), x[1:]]) for x, h in zip(sums, held, strict=True)]
                else:
                    words, sums = np.concatenate([[held_key], words]), [np.concatenate([h, x]) for x, h in zip(sums, held, strict=True)]
            held_key, held = words[-1], [x[-1:] for x in sums]
            if len(words) > 1:
                yield _named(words[:-1], sums[0][:-1], sums[1][:-1])
        if held_key is not None:
            yield _named(np.array([held_key]), *held)

    def _named(words, before, after):
        found = likeliest(after.astype(np.float64), before.astype(np.float64), matrix)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(before.sum(1)), pa.array(found.astype(np.int32))], names=["key", "n", "class"])

    rows = train.mapInArrow(run, "key long, cells binary")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(choose, "key long, n long, class int")


def _classed(coded: DataFrame, by_id: np.ndarray, shapes: np.ndarray, rare: DataFrame) -> DataFrame:
    """(rid, held_out, seq, log_rest, n_rest): each document's classes, one byte a word, and the log counts and
    number of known ones among words outside the broadcast, whose counts and classes come by a join."""
    table = coded.sparkSession.sparkContext.broadcast(by_id)

    def known(batches):
        by_id = table.value
        for b in batches:
            seq = [by_id[np.frombuffer(x.as_py(), np.uint32)].tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(seq, pa.binary())], names=["rid", "held_out", "seq"])

    def fill(batches):
        for b in batches:
            out = []
            for raw, found in zip(b.column(2), b.column(3), strict=True):
                seq = np.frombuffer(raw.as_py(), np.uint8).copy()
                if found.is_valid:
                    rows = found.values
                    pos, key = rows.field("pos").to_numpy(), rows.field("key").to_numpy()
                    own = rows.field("class").fill_null(UNKNOWN).to_numpy(zero_copy_only=False)
                    own = np.where(own == UNKNOWN, shapes[key & 63], own)
                    seq[np.flatnonzero(seq == UNKNOWN)[pos]] = own
                out.append(seq.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), b.column(4), b.column(5)], names=["rid", "held_out", "seq", "log_rest", "n_rest"])

    other = coded.filter(F.size("others") > 0).select("rid", F.posexplode("others").alias("pos", "key")).join(rare, "key", "left")
    other = other.groupBy("rid").agg(F.collect_list(F.struct("pos", "key", "class")).alias("found"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("log_rest"), F.count("n").alias("n_rest"))
    both = coded.select("rid", "held_out", "units").mapInArrow(known, "rid long, held_out boolean, seq binary").join(other, "rid", "left").select("rid", "held_out", "seq", "found", "log_rest", "n_rest")
    return both.mapInArrow(fill, "rid long, held_out boolean, seq binary, log_rest double, n_rest long")


def _matrix(train: DataFrame) -> np.ndarray:
    """Class bigram counts of a one-column table of class streams."""

    def run(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for _, _, s, _, _ in _streams(batches, np.uint8, 0):
            c = s.astype(np.int64)
            total += np.bincount(c[:-1] * CLASSES + c[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return _collect_matrix(train.mapInArrow(run, "cell long, n long"))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)."""
    spark = docs.sparkSession
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    held = F.crc32(name.cast("binary")) % 10 == 0
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), held.alias("held_out"))
    counts = staged(count_words(rows.filter(~F.col("held_out")).select("text")), "counts")
    words, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    keys, n, cut = most_frequent(counts)
    unstage(counts)
    coded = _encode(rows, keys, n)
    train = coded.filter(~F.col("held_out"))
    n_docs = train.count()

    # the unit of each id: its own in the head, else its group of spelling
    fold = np.arange(COUNTED + 1 + SHAPES)
    fold[len(keys) + 1 : COUNTED + 1] = END
    fold[HEAD + 1 : len(keys) + 1] = HEAD + 1 + (keys[HEAD:] & np.uint64(63)).astype(np.int64)
    fold[COUNTED + 1 :] = HEAD + 1 + np.arange(SHAPES)
    fold = fold.astype(np.uint16)
    classes, matrix, _ = cluster(train.select("units"), fold, rounds)
    by_id = classes[fold].astype(np.uint8)
    tail = staged(assign(train.select("units", "others"), keys, by_id, matrix), "tail")

    # classes by id with those of the words that are broadcast; rare words come by a join
    shapes = classes[HEAD + 1 :].astype(np.uint8)
    if len(keys) > HEAD:
        own = tail.filter(F.col("n") >= cut).select("key", "class").toArrow()
        order = np.argsort(keys[HEAD:])
        place = order[np.searchsorted(keys[HEAD:][order], own["key"].to_numpy().view(np.uint64))]
        by_id[1 + HEAD + place] = own["class"].to_numpy()
    by_id[COUNTED + 1 :] = UNKNOWN
    classed = staged(_classed(coded, by_id, shapes, tail.filter(F.col("n") < cut)), "classed")
    matrix = _matrix(classed.filter(~F.col("held_out")).select("seq"))

    total, distinct = (words or 0) + n_docs, distinct + (n_docs > 0)
    base_norm = np.log10(total + ADD * (distinct + 1))
    # words per class: training words, and one unseen word for each group of spelling
    members = np.bincount(classes[1 : 1 + min(HEAD, len(keys))], minlength=CLASSES).astype(np.float64)
    for r in tail.groupBy("class").agg(F.count("*").alias("words")).collect():
        members[r["class"]] += r["words"]
    np.add.at(members, classes[HEAD + 1 :], 1)
    members[END] = 1
    unstage(tail)
    tokens = matrix.sum(0).astype(np.float64)
    # documents are joined by END in the counts: each stream's END after its last word is the same one
    word_norm = np.log10(np.maximum(tokens + ADD * members, ADD))
    moves = np.log10(matrix + ADD) - np.log10(matrix.sum(1, keepdims=True) + ADD * CLASSES)
    end_log = float(np.log10(n_docs + ADD))

    def run(batches):
        for b, first, s, lens, (log_rest, n_rest) in _streams(batches, np.uint8, 1, 2, 3):
            step = moves[s[:-1], s[1:]] - word_norm[s[1:]]
            path = np.add.reduceat(step, np.concatenate([[0], np.cumsum(lens)[:-1]]))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(lens)), pa.array(path), log_rest, n_rest], names=["rid", "path", "log_rest", "n_rest"])

    paths = classed.select("rid", "seq", "log_rest", "n_rest").mapInArrow(run, "rid long, path double, log_rest double, n_rest long")
    out = coded.drop("units", "others").join(paths, "rid")
    logs = F.col("log_sum") + F.coalesce("log_rest", F.lit(0.0)) + end_log
    out = out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_seen") + F.coalesce("n_rest", F.lit(0)) + int(n_docs > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(base_norm)).alias("base_score"),
        (logs + F.col("path")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
