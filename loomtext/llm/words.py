"""Vectorised words, shingles and 64-bit names over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D; since those are ASCII, runs of
UTF-8 bytes and runs of code points are the same words.  All hashes are sums of odd-base powers
modulo 2**64, so that prefix sums give the hash of any range, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
PIECE = 1 << 20  # bytes hashed at a time; a longer text is hashed in pieces
SLICE = 1 << 21  # bytes of text worked on at a time, or one longer text

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
BASE = int(_rng.integers(2**62, 2**63, dtype=np.uint64)) | 1


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), U)
    out[1:] = U(base)
    return np.multiply.accumulate(out)[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        have = powers(base, size), powers(inverse(base), size)
        if size <= 2 * PIECE:
            _tables[base] = have
    return have


@dataclass
class Words:
    """Words of consecutive texts: byte ranges, 64-bit names, and the first word of each text."""

    data: np.ndarray
    doc_bytes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    h: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.doc_bytes) - 1


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def split_words(texts: pa.Array, fold: bool = False, hashes: bool = True) -> Words:
    """``fold``: A-Z count as a-z."""
    data, at = text_bytes(texts)
    n = len(data)
    word = np.empty(n + 1, bool)
    word[:n] = ~SPACE[data]
    word[n] = False
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.zeros(n + 1, bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge))
    ends = np.flatnonzero(before & (~word | edge))
    first = np.searchsorted(starts, at)
    return Words(data, at, starts, ends, name_words(data, starts, ends, fold) if hashes else np.zeros(0, U), first)


def name_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    table = _FOLDED if fold else _BYTE
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE)))
        lo, hi = starts[i], ends[j - 1]
        up, down = _powers(BASE, hi - lo)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    return mix(out)


def window_names(h: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """The name of the n symbols from each position on, text ends disregarded; len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    if n <= 8:
        out = h[:m].copy()
        for k in range(1, n):
            out *= U(base)
            out += h[k : k + m]
        return mix(out)
    out = np.empty(m, U)
    for lo in range(0, m, PIECE):
        hi = min(m, lo + PIECE)
        up, down = _powers(base, hi - lo + n)
        sums = np.zeros(hi - lo + n, U)
        np.cumsum(h[lo : hi + n - 1] * up[: hi - lo + n - 1], out=sums[1:])
        out[lo:hi] = (sums[n : n + hi - lo] - sums[: hi - lo]) * down[: hi - lo]
    return mix(out)


def sequence_name(h: np.ndarray) -> int:
    """The name of a whole sequence, its length included."""
    out = len(h) + 1
    for x in h.tolist():
        out = (out * BASE + x) & (2**64 - 1)
    return int(mix(np.array([out], U))[0])


def shingles(w: Words, doc: int, names: np.ndarray, n: int = 5) -> np.ndarray:
    """The distinct n-word shingles of a text, sorted; ``names``: window_names of all words. A text of fewer words has one of them all."""
    a, b = w.first[doc], w.first[doc + 1]
    if b - a >= n:
        return np.unique(names[a : b - n + 1])
    return np.array([sequence_name(w.h[a:b])], U) if b > a else np.zeros(0, U)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with SLICE bytes of text at most, or one row."""
    col = batch.column(column)
    at = np.concatenate([[0], np.cumsum(pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False))])
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
