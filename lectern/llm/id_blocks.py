"""Patched frame-of-reference blocks for token ids, and the files that hold them.

A file holds consecutive documents in ascending order::

    magic "PFORIDS1" | header: block length, blocks, documents, ids (4 x uint64)
    document ids (int64) | their numbers of ids (uint64)
    start of each block in the body (uint64, one more than blocks)
    body: blocks of: minimum (uint32), width (uint32), exceptions (uint32),
          packed words (uint64, width x length / 64), exception places (uint32), exceptions' high bits (uint32)

A block subtracts its minimum and keeps ``width`` low bits of every difference, where the width
is the smallest that holds a given percentile of them; what stands above those bits is in the
exception list.  The index of block starts gives any document without unpacking the others.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"PFORIDS1"
LENGTH = 1024


def _widths(ids: np.ndarray, percentile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = ids.min(axis=1)
    rest = ids - low[:, None]
    at = min(ids.shape[1] - 1, int(np.ceil(ids.shape[1] * percentile)) - 1)
    pivot = np.partition(rest, at, axis=1)[:, at].astype(np.float64)
    return low, rest, np.frexp(pivot)[1].astype(np.int64)


def _pack(rest: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values into rows of ``width`` words."""
    lanes = rest.reshape(-1, 64).astype(np.uint64) & np.uint64((1 << width) - 1)
    words = np.zeros((len(lanes), width), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        words[:, word] |= lanes[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return words


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.zeros((len(words), 64), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        lanes[:, i] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            lanes[:, i] |= words[:, word + 1] << np.uint64(64 - shift)
    return lanes & np.uint64((1 << width) - 1)


def write_blocks(documents: np.ndarray, lengths: np.ndarray, ids: np.ndarray, percentile: float = 0.9, length: int = LENGTH) -> bytes:
    """The bytes of a file.  ``length`` is a multiple of 64; the last block is filled with its last id."""
    blocks = -(-len(ids) // length)
    filled = np.concatenate([ids, np.full(blocks * length - len(ids), ids[-1] if len(ids) else 0)]).astype(np.uint32).reshape(blocks, length)
    parts: list[bytes] = [b""] * blocks
    if blocks:
        low, rest, widths = _widths(filled, percentile)
        above = rest.astype(np.uint64) >> widths.astype(np.uint64)[:, None]
        rows, places = np.nonzero(above)
        bounds = np.searchsorted(rows, np.arange(blocks + 1))
        high, places = above[rows, places].astype(np.uint32), places.astype(np.uint32)
        head = np.stack([low.astype(np.uint32), widths.astype(np.uint32), np.diff(bounds).astype(np.uint32)], axis=1)
        for width in np.unique(widths):
            mine = np.flatnonzero(widths == width)
            packed = _pack(rest[mine], int(width)).reshape(len(mine), -1)
            for k, b in enumerate(mine):
                a, z = bounds[b], bounds[b + 1]
                parts[b] = head[b].tobytes() + packed[k].tobytes() + places[a:z].tobytes() + high[a:z].tobytes()
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, blocks))]).astype(np.uint64)
    header = np.array([length, blocks, len(documents), len(ids)], np.uint64)
    return b"".join([
        MAGIC, header.tobytes(), documents.astype(np.int64).tobytes(), lengths.astype(np.uint64).tobytes(), starts.tobytes(), *parts
    ])


class IdFile:
    """Reads such a file; ``ids`` unpacks only the blocks that the asked range touches."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of id blocks")
        self.length, self.blocks, n, self.n_ids = (int(x) for x in np.frombuffer(data, np.uint64, 4, 8))
        at = 40
        self.documents = np.frombuffer(data, np.int64, n, at)
        self.lengths = np.frombuffer(data, np.uint64, n, at + 8 * n).astype(np.int64)
        self.starts = np.frombuffer(data, np.uint64, self.blocks + 1, at + 16 * n).astype(np.int64)
        self.body, self.data = at + 16 * n + 8 * (self.blocks + 1), data

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.length, -(-stop // self.length)
        begins = self.body + self.starts[first:last]
        heads = np.stack([np.frombuffer(self.data, np.uint32, 3, b) for b in begins]).astype(np.int64)
        out = np.empty((last - first, self.length), np.uint32)
        for width in np.unique(heads[:, 1]):
            mine = np.flatnonzero(heads[:, 1] == width)
            n = int(width) * self.length // 64
            words = np.stack([np.frombuffer(self.data, np.uint64, n, begins[k] + 12) for k in mine])
            values = _unpack(words.reshape(-1, int(width)) if width else np.zeros((len(mine) * self.length // 64, 0), np.uint64), int(width))
            values = values.reshape(len(mine), self.length)
            for row, k in enumerate(mine):
                if m := int(heads[k, 2]):
                    places = np.frombuffer(self.data, np.uint32, m, begins[k] + 12 + 8 * n)
                    high = np.frombuffer(self.data, np.uint32, m, begins[k] + 12 + 8 * n + 4 * m)
                    values[row, places] |= high.astype(np.uint64) << np.uint64(width)
            out[mine] = values + heads[mine, 0].astype(np.uint64)[:, None]
        return out.reshape(-1)[start - first * self.length : stop - first * self.length]
