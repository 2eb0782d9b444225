"""SentencePiece encoding and decoding with the N best segmentations.

A text's lattice has a node before and after each character and an edge for each vocabulary piece that
matches; a path's score is the sum of its pieces' scores. A forward Viterbi pass gives each node the
exact score of the best path to it from the start. The backward A* search starts at the end and
extends partial paths to the left; score so far plus the node's forward score is what the best
completion will reach, so paths come off the heap in order of their full score.

No piece has white space after another character, so the lattice falls apart before each run of white
space, and around characters that no piece holds. Segments are independent: the best path of a text
joins the best paths of its segments, and each next-best one trades some segments' paths for later
ones. Forward passes run over all unseen segments of a batch at once, by length; A* runs only for the
segments whose second path costs least, which the forward and backward scores tell without a search.

Text rules of the model: blanks become U+2581, one is put before the text, and a character without a
piece is spelled as UTF-8 byte pieces, scored as one edge below the worst piece.

Defined cases: null and empty texts have no piece, one segmentation with score 0 and decode to an
empty text; a text that holds U+2581 itself decodes to a blank there (round_trip is false); ties go to
the path with the longer last piece, among segments to the earlier; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare_session, tidy

N_BEST = 3
SPACE = "▁"
#: How far below the worst piece a character without a piece is scored.
UNKNOWN_PENALTY = 10.0
CACHE_SEGMENTS = 300_000
CHUNK_CHARS = 1_500_000
LONG = 64
#: Edges that are scored at a time.
CELLS = 1 << 19
_MUL = np.uint64(0x100000001B3)
_HIGH = np.uint64(64 - 22)
_NO_STEP = np.iinfo(np.int64).min


class Model:
    """Vocabulary, lattice and search of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score, self.id, self.byte_id = {}, {}, {}
        self.surface: list[bytes] = [b""] * sp.vocab_size()
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[piece], self.id[piece] = sp.get_score(i), i
                self.surface[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        chars = {c for p in self.score for c in p}
        assert not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score), "pieces with inner white space aren't supported"
        held = "".join(map(re.escape, sorted(chars - {SPACE})))
        self.cut = re.compile(f"{SPACE}+[{held}]*|[{held}]+|.", re.DOTALL)
        # pieces by 64-bit hash of their characters; equal hashes of two pieces would be an error
        keys = np.array([self._hash(p) for p in self.score], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_id = keys[order], np.array([self.id[p] for p in self.score], np.int64)[order]
        self.key_score = np.array(list(self.score.values()))[order]
        assert len(np.unique(keys)) == len(keys)
        # most windows of a text are no piece: their hashes' upper bits tell so without a search
        self.seen_bits = np.zeros(1 << 22, bool)
        self.seen_bits[(keys >> _HIGH).astype(np.int64)] = True

    @staticmethod
    def _hash(s: str) -> np.uint64:
        h = np.uint64(14695981039346656037)
        with np.errstate(over="ignore"):
            for c in s:
                h = (h ^ np.uint64(ord(c))) * _MUL
        return h

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _unknown_ids(self, c: str) -> list[int]:
        return [self.byte_id[b] for b in c.encode()]

    def edges(self, s: str, end: int):
        """(start, score, ids) of the edges into a node, longest first."""
        for a in range(max(0, end - self.longest), end):
            piece = s[a:end]
            if piece in self.score:
                yield a, self.score[piece], [self.id[piece]]
            elif a == end - 1:
                yield a, self.unknown, self._unknown_ids(piece)

    def forward(self, s: str) -> list[float]:
        best = [0.0]
        for end in range(1, len(s) + 1):
            best.append(max(best[a] + x for a, x, _ in self.edges(s, end)))
        return best

    def n_best(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths of a segment, by backward A*."""
        ahead = self.forward(s)
        heap = [(-ahead[-1], 0, len(s), 0.0, None)]
        made, found = 1, []
        while heap and len(found) < n:
            _, _, node, behind, path = heapq.heappop(heap)
            if node == 0:
                ids = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                found.append((behind, ids))
                continue
            for a, x, ids in self.edges(s, node):
                heapq.heappush(heap, (-(behind + x + ahead[a]), made, a, behind + x, (ids, path)))
                made += 1
        return found

    def best_arrays(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best scores, what the second-best paths lose, starts and lengths of the best paths' ids, all ids),
        segments of a length at once."""
        score, loss = np.zeros(len(words)), np.zeros(len(words))
        start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flat: list[np.ndarray] = []
        used = 0

        def put(which, scores, losses, lengths, ids):
            nonlocal used
            score[which], loss[which], length[which] = scores, losses, lengths
            start[which] = used + np.cumsum(lengths) - lengths
            flat.append(ids)
            used += len(ids)

        by_len: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_len.setdefault(len(w), []).append(k)
        for size, which in by_len.items():
            if size > LONG:
                for k in which:
                    two = self.n_best(words[k], 2)
                    put([k], [two[0][0]], [two[0][0] - two[1][0] if len(two) > 1 else np.inf], np.array([len(two[0][1])]), np.array(two[0][1], np.uint32))
                continue
            step = max(1, CELLS // (size * min(size, self.longest)))
            for a in range(0, len(which), step):
                some = which[a : a + step]
                put(some, *self._same_length([words[k] for k in some], size))
        return score, loss, start, length, np.concatenate([*flat, np.zeros(0, np.uint32)])

    def best_batch(self, words: list[str]) -> list[tuple[float, list[int], float]]:
        """(best score, its ids, what the second-best path loses) per segment."""
        score, loss, start, length, flat = self.best_arrays(words)
        return [(float(x), flat[a : a + m].tolist(), float(y)) for x, y, a, m in zip(score, loss, start.tolist(), length.tolist(), strict=True)]

    def _same_length(self, words: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scores, losses, lengths, ids) of segments of one length. A row of each array is a place in the
        segments, a column a segment, so that every step runs over adjacent cells."""
        chars = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size).T).astype(np.uint64)
        n, longest = len(words), min(size, self.longest)
        score: list = [None]
        key: list = [None]  # number of the piece among keys, -1 for none
        h = np.full((size, n), np.uint64(14695981039346656037))
        for length in range(1, longest + 1):  # score[length][a]: of the edges from a to a + length
            h = (h[: size - length + 1] ^ chars[length - 1 :]) * _MUL
            flat = h.ravel()
            may = np.flatnonzero(self.seen_bits[(flat >> _HIGH).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, flat[may]), len(self.keys) - 1)
            right = self.keys[at] == flat[may]
            may, at = may[right], at[right]
            x, k = np.full(h.shape, self.unknown if length == 1 else -np.inf), np.full(h.shape, -1, np.int32)
            x.ravel()[may], k.ravel()[may] = self.key_score[at], at
            score.append(x)
            key.append(k)
        ahead = np.full((size + 1, n), -np.inf)
        ahead[0] = 0
        back = np.zeros((size + 1, n), np.int64)
        for end in range(1, size + 1):
            for length in range(min(end, longest), 0, -1):  # the longest piece wins ties
                x = ahead[end - length] + score[length][end - length]
                better = x > ahead[end]
                np.copyto(ahead[end], x, where=better)
                back[end][better] = length
        rest = np.full((size + 1, n), -np.inf)
        rest[size] = 0
        for a in range(size - 1, -1, -1):
            for length in range(1, min(size - a, longest) + 1):
                np.maximum(rest[a], score[length][a] + rest[a + length], out=rest[a])
        # walk the best paths back; what is left of the edges belongs to other paths
        node, rows, steps = np.full(n, size), np.arange(n), []
        while (live := node > 0).any():
            length = np.where(live, back[node, rows], 0)
            start = node - length
            got = np.full(n, _NO_STEP, np.int64)
            for v in range(1, longest + 1):
                if len(m := np.flatnonzero(length == v)):
                    k = key[v][start[m], m]
                    got[m] = np.where(k >= 0, self.key_id[k], -1 - start[m])  # a character without a piece, by its place
                    score[v][start[m], m] = -np.inf
            steps.append(got)
            node = start
        second = np.full(n, -np.inf)
        for v in range(1, longest + 1):
            np.maximum(second, (ahead[: size - v + 1] + score[v] + rest[v:]).max(axis=0), out=second)
        best = ahead[size]
        loss = np.where(np.isfinite(second), np.maximum(0.0, best - second), np.inf)
        path = np.stack(steps[::-1], 1)
        real = path != _NO_STEP
        lengths, ids = real.sum(axis=1), path[real]
        if len(odd := np.flatnonzero(ids < 0)):  # spelled as bytes
            spell = np.ones(len(ids), np.int64)
            owner = np.repeat(rows, lengths)
            more = [self._unknown_ids(words[owner[i]][-1 - ids[i]]) for i in odd.tolist()]
            spell[odd] = [len(x) for x in more]
            lengths = np.bincount(owner, spell, minlength=n).astype(np.int64)
            first = np.cumsum(spell) - spell
            ids = np.repeat(ids, spell)
            for i, x in zip(odd.tolist(), more, strict=True):
                ids[first[i] : first[i] + len(x)] = x
        return best, loss, lengths, ids.astype(np.uint32)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        return raw.decode(errors="replace")[1:] if raw[:1] == b" " else raw.decode(errors="replace")


class _Seen(dict):
    def __init__(self):
        self.todo: list[str] = []

    def __missing__(self, s: str) -> int:
        n = self[s] = len(self)
        self.todo.append(s)
        return n


class Encoder:
    """N-best encoding of texts with a bounded cache of segments."""

    def __init__(self, path: str, n_best: int = N_BEST):
        self.model, self.n = Model(path), n_best
        self.reset()

    def reset(self) -> None:
        self.seen, self.paths = _Seen(), {}
        self.names: list[str] = []
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.flat, self.start, self.len = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        if not self.seen.todo:
            return
        score, loss, start, lens, flat = self.model.best_arrays(self.seen.todo)
        self.names += self.seen.todo
        self.seen.todo = []
        self.start, self.len = np.concatenate([self.start, len(self.flat) + start]), np.concatenate([self.len, lens])
        self.flat = np.concatenate([self.flat, flat])
        self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])

    def _options(self, seg: int) -> list[tuple[float, list[int]]]:
        """(loss against the best, ids) of a segment's next-best paths."""
        if seg not in self.paths:
            found = self.model.n_best(self.names[seg], self.n)
            self.paths[seg] = [(found[0][0] - x, ids) for x, ids in found[1:]]
        return self.paths[seg]

    def encode(self, texts: list[str]):
        """Per text: (ids of the best segmentation, its score, losses and swaps of the n best, swaps by place in the ids)."""
        if len(self.seen) > CACHE_SEGMENTS:
            self.reset()
        segs = [self.model.segments(t) for t in texts]
        ats = [np.fromiter(map(self.seen.__getitem__, s), np.int64, len(s)) for s in segs]
        self._learn()
        for at in ats:
            lens = self.len[at]
            upto = np.cumsum(lens)
            ids = self.flat[np.repeat(self.start[at] - (upto - lens), lens) + np.arange(int(upto[-1]) if len(upto) else 0)]
            nexts = self._next(at)
            placed = [[(int(upto[p] - lens[p]), int(upto[p]), self._options(int(at[p]))[o][1]) for p, o in sorted(swaps)] for _, swaps in nexts]
            yield ids, float(self.score[at].sum()), nexts, placed

    def _next(self, at: np.ndarray) -> list[tuple[float, tuple]]:
        """The n best of a text as (loss, ((place, option), ...)), the best first.

        Only the n - 1 places whose second path loses least can take part: any other swap is beaten
        by each of theirs.
        """
        found: list[tuple[float, tuple]] = []
        if self.n <= 1 or not len(at):
            return [(0.0, ())]
        loss = self.loss[at]
        k = min(self.n - 1, len(at))
        limit = np.partition(loss, k - 1)[k - 1]
        places = np.flatnonzero(loss <= limit)
        places = places[np.argsort(loss[places], kind="stable")][:k]
        options = [self._options(int(at[p])) if np.isfinite(loss[p]) else [] for p in places]
        heap: list[tuple[float, tuple, int]] = [(0.0, (), 0)]  # swaps are added from left to right in `places`
        while heap and len(found) < self.n:
            total, swaps, first = heapq.heappop(heap)
            found.append((total, swaps))
            for j in range(first, len(places)):
                for o, (x, _) in enumerate(options[j]):
                    heapq.heappush(heap, (total + x, (*swaps, (j, o)), j + 1))
        return [(x, tuple((int(places[j]), o) for j, o in swaps)) for x, swaps in found]

    def swapped(self, text: str, swaps: tuple) -> list[int]:
        """Ids of one of the n best of a text that `encode` has seen."""
        at = [self.seen[s] for s in self.model.segments(text)]
        chosen = dict(swaps)
        out: list[int] = []
        for place, seg in enumerate(at):
            out += self._options(seg)[chosen[place]][1] if place in chosen else self.flat[self.start[seg] : self.start[seg] + self.len[seg]].tolist()
        return out


_SWAP = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_NEXT = pa.struct([("loss", pa.float64()), ("swaps", pa.list_(_SWAP))])
_COLUMNS = "doc_id long, n_pieces long, ids_crc32 long, best_score double, n_found int, losses array<double>, round_trip boolean, next_crc32 array<long>"
_MODEL = ", model_pieces long, model_crc32 long"
_IDS = ", ids array<int>, next_best array<struct<loss: double, swaps: array<struct<start: int, stop: int, ids: array<int>>>>>"


def spelled(ids: np.ndarray, swaps: list[tuple[int, int, list[int]]]) -> np.ndarray:
    """The ids of one of the n best: spans of the best ids, in order, give way to others."""
    parts, at = [], 0
    for start, stop, other in swaps:
        parts += [ids[at:start], np.asarray(other, ids.dtype)]
        at = stop
    return np.concatenate([*parts, ids[at:]])


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", n_best: int = N_BEST, with_ids: bool = False, with_model: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, best_score, n_found, losses, round_trip, next_crc32[, model_pieces,
    model_crc32][, ids, next_best]), one row per document.

    The n best segmentations are those of the piece lattice under the model's piece scores. `losses`: what
    each scores below the best, in order; `next_crc32`: the digests of the ids of all but the best;
    `next_best`: how they differ from `ids`, to be spelled out by `segmentations`; `round_trip`: whether
    decoding the best ids gives the text back. A BPE model's own encoding follows its merges instead and is
    another path of the same lattice: with_model adds its length and digest, as the library gives it.
    """
    prepare_session(docs.sparkSession)
    fields = [
        ("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("best_score", pa.float64()), ("n_found", pa.int32()), ("losses", pa.list_(pa.float64())), ("round_trip", pa.bool_()),
        ("next_crc32", pa.list_(pa.int64())),
    ]
    schema = pa.schema(fields + [("model_pieces", pa.int64()), ("model_crc32", pa.int64())] * with_model + [("ids", pa.list_(pa.int32())), ("next_best", pa.list_(_NEXT))] * with_ids)

    def run(batches):
        enc, library = Encoder(model, n_best), None
        if with_model:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=model)
        crc = lambda ids: zlib.crc32(ids.astype("<u4"))

        def done(keys: list, texts: list[str]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in schema]
            for i, t, (best, score, nexts, swaps) in zip(keys, texts, enc.encode(texts), strict=True):
                row = [i, len(best), crc(best), score, len(nexts), [x for x, _ in nexts], enc.model.decode(best.tolist()) == t, [crc(spelled(best, s)) for s in swaps[1:]]]
                if with_model:
                    own = np.array(library.encode(t), np.uint32)
                    row += [len(own), crc(own)]
                if with_ids:
                    row += [best.astype(np.int32), [{"loss": x, "swaps": [dict(zip(("start", "stop", "ids"), y, strict=True)) for y in s]} for (x, _), s in zip(nexts[1:], swaps[1:], strict=True)]]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        keys, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > CHUNK_CHARS:
                    yield done(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield done(keys, texts)
        enc.reset()
        tidy()

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _COLUMNS + _MODEL * with_model + _IDS * with_ids)


def segmentations(encoded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rank, loss, ids): the n best segmentations of what `encode` gave with ids, the best first."""

    def run(batches):
        for b in batches:
            rows = []
            for i, ids, nexts in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                best = ids.values.to_numpy()
                rows.append((i, 0, 0.0, best))
                rows += [(i, k, x["loss"], spelled(best, [(y["start"], y["stop"], y["ids"]) for y in x["swaps"]])) for k, x in enumerate(nexts, 1)]
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)], names=["doc_id", "rank", "loss", "ids"])

    return encoded.select(F.col(doc_id).cast("long"), "ids", "next_best").mapInArrow(run, "doc_id long, rank int, loss double, ids array<int>")


def decode(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; null ids give null."""

    def run(batches):
        m = Model(model)
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long"), F.col(ids)).mapInArrow(run, "doc_id long, text string")
