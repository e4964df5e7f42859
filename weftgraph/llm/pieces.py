"""Remembers the ids of pieces of text between which an encoder never merges, so that each distinct one is encoded once."""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa

#: Distinct pieces that a worker remembers; beyond, it keeps the half that it met first. A bound on memory that results don't depend on.
MOST_REMEMBERED = 400_000


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, nulls as empty ones, and where each text starts, with the end of the last."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    return (np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)), offsets - first


def cut(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The pieces of some bytes that begin at the given places, without a copy."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class Remembered:
    """Subclasses give encode_pieces: the ids of some distinct pieces in one array, and how many each has."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.used = 0

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def forget_some(self) -> None:
        keep = MOST_REMEMBERED // 2
        self.index = dict(islice(self.index.items(), keep))
        self.used = int(self.begin[keep])

    def learn(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n, k = len(self.index), len(ids), len(pieces)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + k > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + n] = ids
        self.begin[first : first + k] = self.used + np.cumsum(lengths) - lengths
        self.size[first : first + k] = lengths
        self.used += n
        self.index.update(zip(pieces, range(first, first + k), strict=True))

    def look_up(self, pieces: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and how many each text has, of which text i has counts[i] pieces."""
        if len(self.index) > MOST_REMEMBERED:
            self.forget_some()
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        where = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(where < 0)
        if len(new):
            unknown, first = [distinct[i] for i in new.tolist()], len(self.index)
            self.learn(unknown, *self.encode_pieces(unknown))
            where[new] = np.arange(first, first + len(new))
        where = where[coded.indices.to_numpy()]
        size = self.size[where]
        total = np.cumsum(size)
        flat = self.flat[np.repeat(self.begin[where] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]
        ends = np.concatenate([[0], total])[np.cumsum(counts)]
        return flat, np.diff(ends, prepend=0)
