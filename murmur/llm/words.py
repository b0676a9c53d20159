"""Vectorised word splitting and hashing over Arrow string columns.

One Arrow batch is handled as one flat byte array, so that the cost per document is a few
numpy operations and not a Python loop.  Batches are cut into chunks of ``CHUNK_BYTES`` (a
document is never cut), which bounds the size of the temporary arrays.

Hashes of words have a key, drawn anew for each run of an operator on the driver (``fresh_key``), and are sums of products of the
key's numbers with a word's parts, of which the upper halves count: two different words collide with a chance of 2**-64 over the
keys, whatever the words are.  Nobody can build texts against a key that does not exist yet.  Where equal words decide a result for good, they are compared by
their bytes (``same_bytes``) or by a cryptographic digest of them (``digests``).

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; all bytes of a multi-byte UTF-8 character
are outside that class, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Words of more bytes are hashed one by one.
LONG = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The low n bytes of eight.
_LOW = np.asarray([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the murmur3 constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(a * _ODD + b)


Batches = Iterator[pa.RecordBatch]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, and at its end the memory that it has freed goes back to the system: an idle worker would keep it beside the next tasks of its executor."""

    def through(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return through


def chunks(ids: pa.Array, text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc positions in the batch as ids, bytes, offsets) of pieces of a batch; null texts are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if len(text) == 0:
        return
    bufs = text.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    ids = np.asarray(ids.to_pylist(), dtype=object) if ids.null_count else np.asarray(ids)
    lo = 0
    while lo < len(text):
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1
        hi = max(hi, lo + 1)
        yield ids[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each document the index of its first word (one more at the end)."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    gap = _SPACE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = gap[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    edge[inner] = True
    start = edge[:-1] & ~gap
    edge[1:-1] = gap[1:]
    edge[inner] = True
    end = edge[1:] & ~gap
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def fresh_key() -> bytes:
    """A key for ``word_hashes``; all tasks of a run must have the same."""
    return os.urandom(32)


def _numbers(key: bytes) -> np.ndarray:
    """The key's numbers: two rows, each with one for the size and one for every four bytes of a word."""
    raw = hashlib.shake_256(key).digest(2 * (LONG // 4 + 2) * 8)
    return np.frombuffer(raw, dtype="<u8").reshape(2, -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    """A 64-bit hash of each word under a key: two multilinear sums over its four-byte parts and its size, the upper half of each.

    Longer words than ``LONG`` bytes go through keyed BLAKE2 one by one.
    """
    size = ends - starts
    if not len(size):
        return size.astype(np.uint64)
    k = _numbers(key)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    n = size.astype(np.uint64)
    sums = [k[r, 0] + k[r, 1] * n for r in (0, 1)]
    live, step, low = None, 0, np.uint64(0xFFFFFFFF)
    while live is None or len(live):
        at, left = (starts, size) if live is None else (starts[live] + step, size[live] - step)
        c = eight[at] & _LOW[np.minimum(left, 8)]
        i = 2 + step // 4
        for r in (0, 1):
            part = k[r, i] * (c & low) + k[r, i + 1] * (c >> np.uint64(32))
            if live is None:
                sums[r] += part
            else:
                sums[r][live] += part
        step += 8
        live = np.flatnonzero((size > step) & (size <= LONG)) if live is None else live[left > 8]
    h = mix(sums[0] & ~low | sums[1] >> np.uint64(32))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return h


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Are the bytes a..a_end those of b..b_end? For each pair of places."""
    size = a_end - a
    same = size == b_end - b
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    live, step = np.flatnonzero(same & (a != b)), 0
    while len(live):
        left = size[live] - step
        if step > LONG:  # few are so long
            for i in live.tolist():
                same[i] = bool((data[a[i] : a_end[i]] == data[b[i] : b_end[i]]).all())
            break
        differ = ((eight[a[live] + step] ^ eight[b[live] + step]) & _LOW[np.clip(left, 0, 8)]) != 0
        same[live[differ]] = False
        live, step = live[~differ & (left > 8)], step + 8
    return same


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words with one space after each, and where each begins (one more place at the end)."""
    size = ends - starts
    begin = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size + 1, out=begin[1:])
    out = np.full(int(begin[-1]), 0x20, dtype=np.uint8)
    letters = data[~_SPACE[data]]
    out[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    return out.tobytes(), begin


def digests(text: bytes, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """A 128-bit cryptographic digest of each stretch of joined words: equal only if the words are."""
    view, h = memoryview(text), hashlib.blake2b
    return [h(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())]


def window_hashes(h: np.ndarray, k: int, salt: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes (crossing documents too: mask those).

    Runs of 1, 2, 4, ... are chained from two halves; a run of k is the chain of its binary parts.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    level, width, done, out = mix(h + np.uint64(salt)), 1, 0, None
    while True:
        if k & width:
            part = level[done : done + n]
            out = part if out is None else chain(out, part)
            done += width
        if done == k:
            return out
        level = chain(level[:-width], level[width:])
        width *= 2


def within(word_off: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """For each run of k words: does it stay in one document?"""
    ok = np.ones(max(0, n_words - k + 1), dtype=bool)
    for back in range(1, k):
        at = word_off[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok
