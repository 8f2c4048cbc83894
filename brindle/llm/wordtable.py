"""The words `[^\\x20\\x09-\\x0D]+` of many texts at once: where they are, what they hash to, how often windows recur."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .neardup import mix

_U = np.uint64
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Longer words are hashed one by one.
LONG = 256
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=object).astype(_U)


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one array without nulls, whatever its size."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return column


class Words:
    """first, last: byte range of each word; doc: for each text, the number of words before it, and at last that of all."""

    def __init__(self, texts: pa.Array):
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        inside = ~_SPACE[self.data]
        edge = np.ones(len(self.data) + 1, bool)  # a blank, or another text, before this byte
        np.logical_not(inside, out=edge[1:])
        edge[ends] = True
        self.first = np.flatnonzero(inside & edge[:-1])
        edge[:-1] = ~inside
        edge[-1] = True
        edge[ends] = True
        self.last = np.flatnonzero(inside & edge[1:]) + 1
        self.doc = np.searchsorted(self.first, ends)

    def __len__(self) -> int:
        return len(self.first)

    def hashes(self, seed: int) -> np.ndarray:
        """64 bits for each word, of eight bytes at a time."""
        size = self.last - self.first
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        h = mix(size.astype(_U) ^ mix(np.full(1, seed, _U)))
        left = np.flatnonzero(size <= LONG)
        at = self.first[left]
        while len(left):
            rest = self.last[left] - at
            h[left] = mix(h[left] ^ (eight[at] & _MASK[np.minimum(rest, 8)]))
            left, at = left[rest > 8], at[rest > 8] + 8
        for i in np.flatnonzero(size > LONG):
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.first[i] : self.last[i]].tobytes(), seed)
        return h


def window_hashes(words: np.ndarray, size: int, factor: int) -> np.ndarray:
    """The hash of the `size` words from each word on, over all texts in a row; the last size - 1 have none."""
    n = len(words)
    if n < size:
        return np.zeros(0, _U)
    up, down = np.full(n, factor, _U), np.full(n, pow(factor, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    total = np.zeros(n + 1, _U)
    np.cumsum(words * np.cumprod(up), out=total[1:])
    return mix((total[size:] - total[:-size]) * np.cumprod(down)[: n - size + 1])
