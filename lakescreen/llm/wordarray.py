"""Words of many UTF-8 texts at once, as numpy arrays over one buffer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_U64 = np.uint64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    data: np.ndarray  # the texts' bytes, A-Z lowered, and 8 zero bytes
    start: np.ndarray  # of each word
    size: np.ndarray
    first: np.ndarray  # each text's first word, and the number of words at the end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each text's offset; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_slices(column: pa.Array, most: int = 1 << 21) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes, so that memory is bounded by that and the longest text."""
    _, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield column.slice(at, end - at)
        at = end


def split(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of bytes that ``is_word`` (256 flags) holds of, none across texts."""
    low = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    flags = is_word[low[:-8]]
    edge = np.zeros(len(flags) + 1, bool)
    edge[offsets] = True
    begins, ends = flags.copy(), flags.copy()
    begins[1:] &= ~flags[:-1] | edge[1:-1]
    ends[:-1] &= ~flags[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    return Words(low, start, size, np.searchsorted(start, offsets))


def hashes(words: Words, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time; words in which bytes are left go on to the next eight."""
    view = np.ndarray((len(words.data) - 7,), "<u8", words.data, strides=(1,))
    h = words.size.astype(np.uint64) * _U64(0x9E3779B97F4A7C15) + _U64(seed * 2 + 1)
    todo, done = slice(None), 0
    while (left := words.size[todo] - done).size:
        x = h[todo] ^ (view[words.start[todo] + done] & _MASK[np.minimum(left, 8)])
        x = (x ^ x >> _U64(32)) * _U64(0xD6E8FEB86659FD93)
        x = (x ^ x >> _U64(29)) * _U64(0x9FB21C651E98DF25)
        h[todo] = x ^ x >> _U64(32)
        more = left > 8
        todo = np.flatnonzero(more) if done == 0 else todo[more]
        done += 8
    return h
