"""Words and shingles of an Arrow batch of texts as 64-bit hashes, computed with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20  # texts handled at once; a longer text is handled alone
_HASH_BYTES = 1 << 20  # bytes of words hashed at once, so one long text needs little more than itself

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_all = np.ones(256, bool)
NOT_SPACE = _all.copy()
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = _all.copy()  # after lower-casing: digits, a-z and every byte of a non-ASCII character
ALPHANUMERIC[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)


_BYTE = _odd(256, 1 << 40)
_place = _odd(1 << 12, 1 << 41)
_SHINGLE = _odd(64, 1 << 42)


def _places(n: int) -> np.ndarray:
    global _place
    if n > len(_place):
        _place = _odd(2 * n, 1 << 41)
    return _place


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts come to ``limit`` bytes at most, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(length)
        row = 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(row, end - row)
            row = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (with the end of the last); null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a run of texts: ``start`` and ``end`` of each in ``data``, and ``first`` word of each text."""

    def __init__(self, texts: pa.Array, kind: np.ndarray, lower: bool = True):
        raw, self.at = utf8(texts)
        self.data = LOWER[raw] if lower else raw
        inside = kind[self.data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        edges = self.at[:-1][self.at[:-1] < len(raw)]
        before[edges] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        last = self.at[1:][self.at[1:] > 0] - 1
        after[last] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)

    def text_of(self, i: int, j: int) -> bytes:
        """Words i to j-1 with single spaces between."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))

    def row(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A hash of each word: a random multiple of each byte by its place, summed, then mixed with the length."""
        length = self.end - self.start
        out = np.zeros(len(length), np.uint64)
        if not len(length):
            return out
        place = _places(int(length.max()))
        ends = np.cumsum(length)
        i = 0
        while i < len(length):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + _HASH_BYTES, "right")))
            size = length[i:j]
            begin = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(begin, size)
            byte = self.data[within + np.repeat(self.start[i:j], size)]
            out[i:j] = np.add.reduceat(_BYTE[byte] * place[within], begin)
            i = j
        return mix64(out ^ (length.astype(np.uint64) << np.uint64(48)))


def window_hash(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each start."""
    total = np.full(len(starts), k, np.uint64)
    for j in range(k):
        total += words[starts + j] * _SHINGLE[j % 64] + np.uint64(j // 64)
    return mix64(total)


def windows_at(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of exactly ``k`` words start, and how many each text has."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    begin = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(begin - first[:-1], count), count


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word windows, and the text of each; a shorter text that is not empty has one of all its words."""
    starts, count = windows_at(first, k)
    hashes, rows = [window_hash(words, starts, k)], [np.repeat(np.arange(len(count)), count)]
    size = np.diff(first)
    for n in range(1, k):
        short = np.flatnonzero(size == n)
        if len(short):
            hashes.append(window_hash(words, first[:-1][short], n))
            rows.append(short)
    return np.concatenate(hashes), np.concatenate(rows)
