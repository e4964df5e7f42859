"""Words, word hashes and window hashes of a batch of texts, with numpy.

A batch is an Arrow string column. All work happens on its UTF-8 bytes, so a
word is a maximal run of bytes that are not separators; bytes of multi-byte
characters (0x80 and up) are never separators. Hashes depend on nothing but
the word's bytes, so they agree between executors.

Null texts count as empty ones. Memory is a small multiple of the batch's
bytes: callers go through ``chunks`` to bound a batch (one text stays whole).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of the pattern [^\x20\x09-\x0D]+.
WHITE_SPACE = (0x20, *range(0x09, 0x0E))
#: Separators of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower-cased text.
NOT_ALPHANUMERIC = (*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))

_GOLDEN = 0x9E3779B97F4A7C15
_BASE = np.uint64(0xD1342543DE82EF95)
_WINDOW_BASE = np.uint64(0xAF251AF3B0F025B5)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public-domain splitmix64 generator, on every element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(separators: tuple[int, ...], fold: bool, seed: int) -> np.ndarray:
    """A random 64-bit value for each byte; 0 for separators; A-Z as a-z if fold."""
    with np.errstate(over="ignore"):
        table = mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(_GOLDEN)) | np.uint64(1)
    if fold:
        table[65:91] = table[97:123]
    table[[s for s in separators if not (fold and 65 <= s <= 90)]] = 0
    return table


_powers = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have)
        _powers[int(base)] = have
    return have


class Words:
    """Words of a batch: byte spans, the first word of each row, and hashes."""

    def __init__(self, column: pa.Array, separators=WHITE_SPACE, fold: bool = False, lanes: int = 1):
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        if column.null_count:
            column = column.fill_null(b"")
        self.rows = len(column)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + self.rows + 1] if self.rows else np.zeros(1, np.int64)
        first = int(offsets[0])
        self.offsets = offsets - first
        n = int(self.offsets[-1])
        self.data = np.frombuffer(data, np.uint8)[first : first + n] if n else np.zeros(0, np.uint8)
        kept = _table(separators, fold, 1)[self.data] != 0
        begins = kept.copy()
        begins[1:] &= ~kept[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < n]
        begins[heads] = kept[heads]
        stops = kept.copy()
        stops[:-1] &= ~kept[1:]
        tails = self.offsets[1:][self.offsets[1:] > 0] - 1
        stops[tails] = kept[tails]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        #: bounds[i]:bounds[i + 1] are the words of row i
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)
        self.hashes = [self._hash(separators, fold, seed + 1) for seed in range(lanes)]

    def _hash(self, separators, fold: bool, seed: int) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.arange(len(self.data), dtype=np.int64)[self.starts[0] :]
        at -= np.repeat(self.starts, np.diff(self.starts, append=len(self.data)))
        at = np.minimum(at, int(lengths.max()))  # only separators lie beyond
        base = np.uint64((int(_BASE) * (2 * seed - 1)) & (2**64 - 1))
        with np.errstate(over="ignore"):
            terms = _table(separators, fold, seed)[self.data[self.starts[0] :]]
            terms *= _power_table(base, int(lengths.max()) + 1)[at]
            sums = np.add.reduceat(terms, self.starts - self.starts[0])
            return mix(sums + lengths.astype(np.uint64) * np.uint64(_GOLDEN))

    def windows(self, length: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Of every position where a window of so many words of one row starts: the word's index, and the window's hash."""
        h = self.hashes[lane]
        n = len(h) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        row_end = np.repeat(self.bounds[1:], self.counts)[:n]
        fits = np.arange(length, length + n) <= row_end
        with np.errstate(over="ignore"):
            total = np.zeros(n, np.uint64)
            for j in range(length):
                total *= _WINDOW_BASE
                total += h[j : j + n]
            total = mix(total)
        at = np.flatnonzero(fits)
        return at, total[at]

    def row_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, words, side="right") - 1

    def joined(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """A row's words (those kept), joined by one space."""
        a, b = self.bounds[row], self.bounds[row + 1]
        data = self.data
        spans = zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)
        if keep is not None:
            spans = [s for s, k in zip(spans, keep.tolist(), strict=True) if k]
        raw = data.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        return b" ".join([raw[s:e] for s, e in spans])


def chunks(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many bytes of text, one row at least."""
    texts = batch.column(batch.schema.get_field_index(column))
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
