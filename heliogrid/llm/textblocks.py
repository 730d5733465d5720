"""Vectorised byte-level text primitives shared by the corpus operators.

Everything works on the raw UTF-8 buffer of an Arrow string column, so no Python
object is made per word.  A *block* is a run of whole documents of about
``CHUNK_BYTES`` (one longer document forms a block of its own), which bounds the
memory of every temporary array by a constant times the longest document.  A text of
any length is worked on whole.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``; as these are
ASCII, a word of bytes is a word of code points.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

# Arrays of 2 MB and more go back to the system as soon as they are freed, where the C library
# allows to say so; else a worker would keep the most that it ever held.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD

U64 = np.uint64
_STEP = U64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Masks of the last lane of a span, by its bytes modulo 8.
_TAIL = np.array([0xFFFFFFFFFFFFFFFF, *[(1 << 8 * k) - 1 for k in range(1, 8)]], U64)
_LANE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Block:
    """Documents lo..hi of a batch: their bytes and where each starts and ends in them."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def blocks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Block]:
    """Cut an Arrow string column into blocks; null texts are empty documents."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        base = offsets[lo]
        yield Block(lo, hi, data[base : offsets[hi]], offsets[lo:hi] - base, offsets[lo + 1 : hi + 1] - base)
        lo = hi


@dataclass
class Words:
    """Words of a block in text order: byte spans and the document of each."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # per document, its first word
    count: np.ndarray  # per document, its words


def words(b: Block) -> Words:
    n_docs = len(b.starts)
    if len(b.data) == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64))
    space = SPACE[b.data]
    some = b.ends > b.starts
    before = np.empty(len(space), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[b.starts[some]] = True
    after = np.empty(len(space), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[b.ends[some] - 1] = True
    solid = ~space
    start = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    first = np.searchsorted(start, b.starts)
    count = np.searchsorted(start, b.ends) - first
    return Words(start, end, np.repeat(np.arange(n_docs), count), first, count)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand.

    A span is read in lanes of 8 bytes.  Every lane is mixed with its place, which is not
    linear, so that no rule of the text makes differences cancel; the sum is mixed with the
    length.
    """
    n = len(start)
    if n == 0:
        return np.zeros(0, U64)
    length = (end - start).astype(np.int64)
    lanes = (length + 7) >> 3
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    wide = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    out = np.zeros(n, U64)
    if int(lanes.max(initial=0)) <= 4:  # words: lane by lane, over the spans that have it
        at, k = np.flatnonzero(lanes), 0
        while len(at):
            x = wide[start[at] + 8 * k]
            left = length[at] - 8 * k
            x = np.where(left < 8, x & _TAIL[left & 7], x)
            out[at] += mix(x ^ mix(_LANE * np.array([k + 1], U64)))
            k += 1
            at = at[left > 8]
    else:
        some = np.flatnonzero(lanes)
        first = np.cumsum(lanes[some]) - lanes[some]
        k = np.arange(int(lanes.sum())) - np.repeat(first, lanes[some])
        x = wide[np.repeat(start[some], lanes[some]) + 8 * k]
        last = first + lanes[some] - 1
        x[last] &= _TAIL[length[some] & 7]
        out[some] = np.add.reduceat(mix(x ^ mix(_LANE * (k + 1).astype(U64))), first)
    return mix(out + length.astype(U64) * _STEP + U64(seed))


def window_hashes(h: np.ndarray, w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words of one document, and the index of each one's first word."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    at = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
    out = h[:m].copy()
    for k in range(1, n):
        out *= _STEP
        out += h[k : k + m]
    return mix(out[at]), at


def short_hashes(h: np.ndarray, w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents of 1 to n-1 words: the hash of the whole word sequence, and the document."""
    docs = np.flatnonzero((w.count > 0) & (w.count < n))
    out = np.zeros(len(docs), U64)
    for k in range(n - 1):
        more = w.count[docs] > k
        out[more] = out[more] * _STEP + h[w.first[docs][more] + k]
    return mix(out + w.count[docs].astype(U64)), docs
