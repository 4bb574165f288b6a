"""Vectorised work on the bytes of many texts at once: words, 64-bit hashes, ragged arrays.

Texts come as Arrow string arrays. A slice is a run of rows with their UTF-8 bytes in one uint8 array; null texts
count as empty. Hashes are fixed functions of the bytes alone, so that they agree between processes and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 2**64))
_GRAM = _rng.integers(0, 2**64, 64, dtype=U64) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+ : anything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**i for i < n, modulo 2**64."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        steps = np.full(size, _BASE_INV if inverse else _BASE, U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 23:  # longer ones aren't kept
            _powers[inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Slice:
    first: int  # row in the batch
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, rows + 1

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(texts: pa.Array, limit: int = 1 << 17) -> Iterator[Slice]:
    """Cut an Arrow string or binary array into runs of rows of about limit bytes; a longer text is a run of its own.

    The default keeps arrays of 8 bytes a byte of text in a core's cache.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield Slice(at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s], times base**-s, a hash of data[s:e]."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length."""
    h = (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]
    return mix(h + (end - start).astype(U64) * _GRAM[0])


@dataclass
class Words:
    start: np.ndarray  # int64, byte positions in the slice
    end: np.ndarray
    row: np.ndarray  # int64, row in the slice
    first: np.ndarray  # int64, rows + 1: a row's words are first[r]:first[r + 1]
    hash: np.ndarray | None = None


def words(s: Slice, table: np.ndarray, lower: bool = True, hashes: bool = True) -> Words:
    """Maximal runs of bytes for which table holds, within a row."""
    data = LOWER[s.data] if lower else s.data
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    edge = np.zeros(len(data) + 1, bool)  # a row begins here
    edge[s.offsets] = True
    begins, ends = inside[1:] & (~inside[:-1] | edge), inside[:-1] & (~inside[1:] | edge)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    first = np.searchsorted(start, s.offsets).astype(np.int64)
    first[-1] = len(start)
    row = np.repeat(np.arange(s.rows), np.diff(first))
    return Words(start, end, row, first, span_hashes(prefix_hashes(data), start, end) if hashes else None)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of h's runs of k neighbours, len(h) - k + 1 of them; runs across rows are the caller's to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, _GRAM[63], U64) * U64(k)
    for j in range(k):
        out += h[j : j + n] * _GRAM[1 + j % 62] if j < 62 else mix(h[j : j + n] + U64(j))
    return mix(out)


def in_one_row(w: Words, k: int) -> np.ndarray:
    """For each run of k words whether it stays within a row."""
    n = len(w.start) - k + 1
    return w.row[:n] == w.row[k - 1 :] if n > 0 else np.zeros(0, bool)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then start[1], ..."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array out of flat values and each row's count."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
