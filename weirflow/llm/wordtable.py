"""Words of many texts at once: found and grouped with array operations, so that Python sees each
distinct word of a chunk once."""

from __future__ import annotations

import numpy as np

from .common import BLANKS

#: Texts are worked on in chunks of about so many bytes.
CHUNK_BYTES = 1 << 20
_MUL = 0x9E3779B97F4A7C15
_INVERSE = pow(_MUL, -1, 1 << 64)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_BLANK = _table(BLANKS.encode())
_MARK = _table(b".,;:!?")
_ALNUM = _table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse mod 2**64."""
    if len(_powers[0]) < size:
        for k, base in enumerate((_MUL, _INVERSE)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def split(raw: bytes, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of other than white space. With `marks`, a run of sentence marks at the
    end of a word, after an ASCII letter or digit, is a word of its own."""
    b = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(b) + 2, bool)
    blank[1:-1] = _BLANK[b]
    starts = np.flatnonzero(blank[:-2] & ~blank[1:-1])
    ends = np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
    if marks and len(b):
        mark = np.zeros(len(b) + 2, bool)
        mark[1:-1] = _MARK[b]
        first = np.flatnonzero(~mark[:-2] & mark[1:-1])
        last = np.flatnonzero(mark[1:-1] & ~mark[2:])
        cut = first[(first > 0) & _ALNUM[b[np.maximum(first - 1, 0)]] & blank[last + 2]]
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def distinct(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, the number of each word's distinct one). Equal words are found by 64-bit hash and length."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    longest = int((ends - starts).max())
    size = len(raw) + 1
    if size > 16 * CHUNK_BYTES or longest > CHUNK_BYTES:  # one huge text: tables of its size would cost more than they save
        seen: dict[bytes, int] = {}
        at = np.fromiter((seen.setdefault(raw[a:z], len(seen)) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        return list(seen), at
    powers, inverse = _power_tables(size)
    upto = np.zeros(size, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * powers[: size - 1], out=upto[1:])
    h = (upto[ends] - upto[starts]) * inverse[starts]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64)
    _, first, at = np.unique(h, return_index=True, return_inverse=True)
    return [raw[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], at


def words_of_texts(texts: list[bytes], marks: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, number of each word in order, words up to the end of each text)."""
    raw = b"\n".join(texts)
    starts, ends = split(raw, marks)
    words, at = distinct(raw, starts, ends)
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return words, at, np.searchsorted(starts, stops)
