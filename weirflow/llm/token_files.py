"""Token-ID output as Arrow IPC files of fixed-size lists.

All ids of a part, in order of doc_id, form one stream that is cut into sequences of equal length;
each record batch holds the sequences and their masks (false marks the padding after the last id).
Equal lengths make sequence i of a file a slice at a known place: a memory-mapped reader gets it
without a copy. A second small file lists each document's id, start and length within the part.

Documents are dealt by range of doc_id, so that part after part is in ascending order; only one count
per part reaches the driver. Files are written under a temporary name and moved when complete, so a
task that runs again replaces its own file. The folder must lie on a file system that pyarrow can
open by URI (file, hdfs, s3, gs) and that all executors share.

Ids take 2 bytes where the vocabulary allows, else 4. Words are encoded by the tokenizers library once
and kept in a bounded cache: the tokenizer in use never joins text across white space.

Defined cases: null text is empty and gives the end id alone; null ids come first; rows with equal ids
are ordered by text; an empty table gives no document; other columns are not read.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare_session
from .wordtable import CHUNK_BYTES, words_of_texts

SEQ_LEN = 2048
SEQS_PER_BATCH = 256
END_ID = 2
CACHE_WORDS = 400_000
ENCODE_AT_ONCE = 4096
#: Words of letters that are joined to one text for the tokenizers library, which takes long over each text.
JOINED_WORDS = 64


class Encoder:
    """Ids of texts, an end id after each. Words are cached in lower case and without the marks at their
    end, which is safe for a tokenizer that lower-cases, drops white space and splits letters from marks;
    `whole` turns the cache off for others."""

    def __init__(self, path: str, end_id: int = END_ID, whole: bool = False):
        from tokenizers import Tokenizer

        self.tok, self.end, self.whole = Tokenizer.from_file(path), end_id, whole
        self.closes = self._closing()
        self.reset()

    def _closing(self) -> np.ndarray | None:
        """Which ids end a word, for a model that marks each word's last piece; None for others."""
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        if not suffix or not all(c + suffix in vocab for c in vocab if len(c) == 1):
            return None
        closes = np.zeros(self.tok.get_vocab_size(), bool)
        closes[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
        return closes

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per word)."""
        got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(lens.sum())), lens

    def _ids_of_letters(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(words in another order, all ids, ids per word) of words of letters, many to a call. Each has one
        last piece at least; where there are no more of these than words, they tell the words apart, and the
        words of other calls are encoded one by one."""
        if not words:
            return [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
        groups = [words[a : a + JOINED_WORDS] for a in range(0, len(words), JOINED_WORDS)]
        ids, lens = self._ids_of([" ".join(g) for g in groups])
        closes = self.closes[ids]
        owner = np.repeat(np.arange(len(groups)), lens)
        clear = np.bincount(owner[closes], minlength=len(groups)) == [len(g) for g in groups]
        kept = clear[owner]
        ids, closes = ids[kept], closes[kept]
        odd = [w for g, ok in zip(groups, clear, strict=True) if not ok for w in g]
        more, more_lens = self._ids_of(odd)
        return [w for g, ok in zip(groups, clear, strict=True) if ok for w in g] + odd, np.concatenate([ids, more]), np.concatenate([np.diff(np.flatnonzero(closes), prepend=-1), more_lens])

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.start, self.len = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.used = 0

    def _learn(self, words: list[bytes]) -> None:
        for a in range(0, len(words), ENCODE_AT_ONCE):
            texts = [w.decode() for w in words[a : a + ENCODE_AT_ONCE]]
            letters = [t for t in texts if t.isalpha()] if self.closes is not None else []
            rest = [t for t in texts if not t.isalpha()] if self.closes is not None else texts
            (letters, ids, lens), (more, more_lens) = self._ids_of_letters(letters), self._ids_of(rest)
            ids, lens = np.concatenate([ids, more]), np.concatenate([lens, more_lens])
            some = [t.encode() for t in letters + rest]
            n, m = len(self.number), int(lens.sum())
            while self.used + m > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(some) > len(self.start):
                self.start, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.len))
            self.start[n : n + len(some)] = self.used + np.cumsum(lens) - lens
            self.len[n : n + len(some)] = lens
            self.flat[self.used : self.used + m] = ids
            self.used += m
            self.number.update(zip(some, range(n, n + len(some)), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text)."""
        if self.whole:
            got = [e.ids + [self.end] for e in self.tok.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(got), np.uint32), np.array([len(x) for x in got], np.int64)
        if len(self.number) > CACHE_WORDS:
            self.reset()
        words, at, ends = words_of_texts([t.lower() for t in texts], marks=True)
        self._learn([w for w in words if w not in self.number])
        name = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[at]
        lens = self.len[name]
        upto = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.repeat(self.start[name] - upto[:-1], lens) + np.arange(int(upto[-1]))]
        per_text = np.diff(upto[ends], prepend=0)
        # the end ids go in after each text's own
        out = np.full(len(ids) + len(texts), self.end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), per_text)] = ids
        return out, per_text + 1


_encoders: dict[tuple, Encoder] = {}


def shared_encoder(path: str, end_id: int, whole: bool) -> Encoder:
    """One encoder per Python worker: its cache serves all tasks that run there."""
    key = (path, end_id, whole)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of a few MB at a time, whatever the batch's size."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py() or b""
            ids.append(i)
            texts.append(t)
            size += len(t) + 1
            if size > CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


class _Sink:
    """One part's two files."""

    def __init__(self, folder: str, part: int, seq_len: int, kind: np.dtype):
        self.fs, self.dir = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.dir, recursive=True)
        self.names = [f"part-{part:06d}.arrow", f"part-{part:06d}.docs.arrow"]
        self.tmp = [f"{self.dir}/.{n}.{uuid.uuid4().hex}" for n in self.names]
        self.files = [self.fs.open_output_stream(t) for t in self.tmp]
        self.seq_len, self.kind = seq_len, kind
        item = pa.from_numpy_dtype(kind)
        self.schemas = [
            pa.schema([("ids", pa.list_(item, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))]),
            pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]),
        ]
        self.out = [pa.ipc.new_file(f, s) for f, s in zip(self.files, self.schemas, strict=True)]
        self.open: list[np.ndarray] = []
        self.waiting = self.total = self.docs = 0

    def add(self, doc_ids: list, ids: np.ndarray, lens: np.ndarray) -> None:
        starts = self.total + np.cumsum(lens) - lens
        self.out[1].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lens)], schema=self.schemas[1]))
        self.total += len(ids)
        self.docs += len(doc_ids)
        self.open.append(ids.astype(self.kind))
        self.waiting += len(ids)
        span = self.seq_len * SEQS_PER_BATCH
        if self.waiting >= span:
            all_ids = np.concatenate(self.open)
            full = len(all_ids) // span * span
            for a in range(0, full, span):
                self._batch(all_ids[a : a + span], span)
            self.open, self.waiting = [all_ids[full:]], len(all_ids) - full

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
        self.out[0].write_batch(pa.record_batch(lists, schema=self.schemas[0]))

    def close(self) -> None:
        if self.waiting:
            rest = np.concatenate(self.open)
            self._batch(np.pad(rest, (0, -len(rest) % self.seq_len)), len(rest))
        for w, f, tmp, name in zip(self.out, self.files, self.tmp, self.names, strict=True):
            w.close()
            f.close()
            self.fs.move(tmp, f"{self.dir}/{name}")


def write_files(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, seq_len: int = SEQ_LEN, whole: bool = False) -> list[tuple[int, int, int]]:
    """Write the files; returns (part, start of the part in the whole stream, ids in the part)."""
    prepare_session(docs.sparkSession)
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        from pyspark import TaskContext

        sink = None
        for ids, texts in _chunks(batches):
            if sink is None:
                enc = shared_encoder(tokenizer, end_id, whole)
                kind = np.dtype(np.uint16 if enc.tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.uint32)
                part = TaskContext.get().partitionId()
                sink = _Sink(folder, part, seq_len, kind)
            sink.add(ids, *enc.encode(texts))
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "n": [sink.total]}, pa.schema([("part", pa.int32()), ("n", pa.int64())]))

    parts, start = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in ordered.mapInArrow(run, "part int, n long").collect()):
        parts.append((part, start, n))
        start += n
    return parts


class TokenFile:
    """Random access to one file: `sequence(i)` is a view, not a copy, where the file is mapped."""

    def __init__(self, folder: str, name: str):
        fs, path = pafs.FileSystem.from_uri(folder)
        self.source = pa.memory_map(f"{path}/{name}") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(f"{path}/{name}")
        self.reader = pa.ipc.open_file(self.source)
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _values(self, batch: int, column: int) -> pa.Array:
        if self.at != batch:
            self.at, self.batch = batch, self.reader.get_batch(batch)
        return self.batch.column(column).flatten()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b, k = divmod(i, SEQS_PER_BATCH)
        a = k * self.seq_len
        ids = self._values(b, 0).slice(a, self.seq_len).to_numpy()
        return ids, self._values(b, 1).slice(a, self.seq_len).to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids from start on, across batches."""
        span = self.seq_len * SEQS_PER_BATCH
        while n > 0:
            b, a = divmod(start, span)
            got = self._values(b, 0).slice(a, n).to_numpy()
            yield got
            start, n = start + len(got), n - len(got)


def read_documents(spark: SparkSession, folder: str, parts: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def run(batches):
        for b in batches:
            for part, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = TokenFile(folder, f"part-{part:06d}.arrow")
                fs, path = pafs.FileSystem.from_uri(folder)
                with fs.open_input_file(f"{path}/part-{part:06d}.docs.arrow") as f:
                    index = pa.ipc.open_file(f)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        crc = []
                        for a, n in zip(docs["start"].to_pylist(), docs["n_tokens"].to_pylist(), strict=True):
                            c = 0
                            for view in tokens.ids(a, n):
                                c = zlib.crc32(view.astype("<u4"), c)
                            crc.append(c)
                        starts = pa.array(docs["start"].to_numpy() + first)
                        yield pa.record_batch([docs["doc_id"], starts, docs["n_tokens"], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    if not parts:
        return spark.createDataFrame([], schema)
    listing = spark.createDataFrame([(p, s) for p, s, _ in parts], "part long, first long")
    return listing.repartitionByRange(len(parts), "part").mapInArrow(run, schema)
