"""Vectorised word splitting and hashing over Arrow batches, for the operators that run in Python.

Words are the maximal runs of characters other than space and \\t \\n \\v \\f \\r. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once inside a task; whole documents only, so a longer one is a piece of its own.
PIECE_BYTES = 2 << 20
U64 = np.uint64


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows with about ``limit`` bytes of text each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """Words of n texts: codes[offsets[i]:offsets[i+1]] index into vocab (distinct words of the piece)."""

    __slots__ = ("codes", "offsets", "vocab")

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
        real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0 if len(flat) else np.zeros(0, bool)
        if not real.all():
            seen = np.concatenate(([0], np.cumsum(real)))
            offsets = seen[offsets].astype(np.int64)
            flat = flat.filter(pa.array(real))
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocab = coded.dictionary
        self.offsets = offsets

    def hashes(self) -> np.ndarray:
        """64-bit hash of each distinct word."""
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self.vocab.to_pylist()), dtype=U64, count=len(self.vocab))

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on 64-bit unsigned integers."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_ODD = [U64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on; positions with fewer than k left are cut off."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for j in range(k):
            out = (out + h[j : j + n]) * _ODD[j % 5]
            out ^= out >> U64(29)
        return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


#: Words up to this many bytes are hashed side by side in steps of eight bytes; longer ones one by one.
LONG_WORD = 64
_KEYS = mix(np.arange(1, LONG_WORD // 8 + 2, dtype=U64) * U64(0x9E3779B97F4A7C15))
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word buf[start:end]: the length and every eight bytes go through a mixer of their own."""
    size = ends - starts
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    at_byte = np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    h = mix(size.astype(U64) ^ _KEYS[0])
    own, left, at = np.flatnonzero(size <= LONG_WORD), size, starts
    left, at = left[own], at[own]
    step = 0
    with np.errstate(over="ignore"):
        while len(own):
            step += 1
            bytes8 = at_byte[at] & _MASKS[np.minimum(left, 8)]
            h[own] = mix((h[own] + bytes8 * _ODD[0]) ^ _KEYS[step])
            more = left > 8
            own, left, at = own[more], left[more] - 8, at[more] + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return h


class Hashed:
    """Hashes of all words of n texts, computed on the bytes at once: h[offsets[i]:offsets[i+1]] are those of text i.

    See ``word_hashes``; no polynomial, under which whole families of different words would share a hash.
    """

    __slots__ = ("bounds", "buf", "ends", "h", "offsets", "starts")

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        n = len(texts)
        where = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
        size = int(where[-1] - where[0])
        buf = np.frombuffer(texts.buffers()[2], np.uint8, size, int(where[0])) if size else np.zeros(0, np.uint8)
        bounds = where - where[0]
        inside = ~((buf == 32) | ((buf - np.uint8(9)) < 5))
        cut = np.zeros(size + 1, bool)
        cut[bounds] = True
        first, last = inside.copy(), inside.copy()
        if size:
            first[1:] &= ~inside[:-1] | cut[1:-1]
            last[:-1] &= ~inside[1:] | cut[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.h = word_hashes(buf, starts, ends)
        self.offsets = np.searchsorted(starts, bounds)
        self.starts, self.ends, self.buf, self.bounds = starts, ends, buf, bounds

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line of each word, and owner and number of each line; lines are cut at line feeds and number from 0 in each text."""
        feeds = np.flatnonzero(self.buf == 10)
        n = len(self.bounds) - 1
        per_text = np.diff(np.searchsorted(feeds, self.bounds)) + 1
        owner = np.repeat(np.arange(n), per_text)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        return np.searchsorted(feeds, self.starts) + self.owner(), owner, number
