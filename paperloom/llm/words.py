"""Words and shingles of Arrow text columns as flat numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z count as
a-z.  All delimiters are ASCII, so UTF-8 text is cut byte-wise.  Words and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000  # texts are handled in blocks of about this size; a longer text is a block of its own

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        step = np.full(size, _BASE, np.uint64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
        step[1:] = pow(_BASE, -1, 1 << 64)
        _inverses = np.multiply.accumulate(step)


class Words(NamedTuple):
    row: int  # of the first text, in the batch
    first: np.ndarray  # index of each text's first word; one more at the end
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray  # bytes of the texts of this block
    text: np.ndarray  # start of each text in data; one more at the end


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the start of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array) -> Iterator[Words]:
    """All texts, cut into blocks of whole texts."""
    data, offsets = text_buffers(texts)
    row = 0
    while row < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(offsets) - 1)
        yield _words(row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        row = stop


def _words(row: int, data: np.ndarray, text: np.ndarray) -> Words:
    n = len(data)
    _grow(n + 1)
    inside = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        at = text[text < n]
        before[at] = False
        after[text[(text > 0)] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * _powers[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * _inverses[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(row, np.searchsorted(start, text), start, end, h, data, text)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text (a shorter text: all its words as one), one text after the other,
    and the start of each text among them."""
    h, first = words.hash, words.first
    counts = np.diff(first)
    rolled = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for i in range(k):
        rolled = mix(rolled * np.uint64(0x9FB21C651E98DF25) + h[i:i + len(rolled)])
    out = []
    for a, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
        if n >= k:
            s = np.sort(rolled[a:a + n - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            s = np.full(1, n, np.uint64)
            for i in range(n):
                s = mix(s * np.uint64(0xA0761D6478BD642F) + h[a + i:a + i + 1])
            out.append(s)
        else:
            out.append(h[:0])
    starts = np.cumsum([0, *map(len, out)])
    return (np.concatenate(out) if out else h[:0]), starts


def planes(values: np.ndarray) -> bytes:
    """Fixed-width values with equal-ranking bytes side by side: sorted or small values then compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes() if len(values) else b""


def unplanes(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype) if data else np.zeros(0, dtype)
