"""Packing of documents into sequences of a fixed size by minimum bin slack.

A document is its token ids and an end id; only one that is longer than a sequence is
cut, so that its first piece takes what is over and all others are full. What has to be
packed is then a count for each length from 1 to the size of a sequence, however many
documents there are: tasks count, the counts are added up, and at most one row a length
reaches the driver.

A bin starts from the longest piece that is left. A bitset of reachable sums over the
lengths that are left, short ones first, each as often as it is there, finds the fullest
combination that fits beside it; reading it back from the longest length on prefers long
pieces, so short ones remain for later bins. The combination is then removed as often as
the counts allow, not once: all bins alike are one ``pattern``. Bitsets of lengths below
the shortest one whose usable count changed stay as they are. A pattern ends when a length
has become rarer than it asks for, so patterns are bounded by lengths, not by documents.

Pieces find their bin by their rank among those of their length: a task numbers its own
pieces as it writes them, and a running sum of the tasks' counts, one row a task and
length, gives where its ranks start. A pattern owns a range of ranks of each of its
lengths; the ranges, as few as the patterns, are broadcast and searched.

Defined cases: null and empty texts are the end id alone; every row is a document of its
own, also rows of one id, equal rows, and rows without an id (their doc_id is null); other
columns are ignored; a text of any length is encoded whole; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches
from .token_ids import ENCODED_AT_ONCE, encoder
from .wordhash import chunks

SIZE = 2048
END = 0
PIECES = "task int, doc_id long, piece int, start long, length int, ids_crc32 long, rank long"


class Patterns:
    """Bins as patterns: (times, {length: how often}) in the order in which they are filled."""

    def __init__(self, counts: np.ndarray, size: int):
        """counts[l]: pieces of length l, from 0 to size."""
        self.size = size
        self.left = counts.astype(np.int64).tolist()
        self.lengths = [x for x in range(1, size + 1) if self.left[x]]  # those that were there at first, ascending
        self.sums: list[int] = []  # sums[i]: bitset of the sums of the lengths before the i-th
        self.usable = [0] * len(self.lengths)
        self.full = (1 << (size + 1)) - 1

    def _refresh(self) -> None:
        """Bitsets from the first length on whose usable count isn't what it was."""
        size, left = self.size, self.left
        first = len(self.sums)
        now = [min(left[x], size // x) for x in self.lengths]
        if self.sums:
            first = next((i for i, (a, b) in enumerate(zip(now, self.usable, strict=True)) if a != b), len(self.lengths))
        self.usable = now
        del self.sums[first + 1 :]
        bits = self.sums[-1] if self.sums else 1
        if not self.sums:
            self.sums.append(bits)
        for i in range(len(self.sums) - 1, len(self.lengths)):
            length, many, step = self.lengths[i], now[i], 1
            while many > 0 and bits != self.full:  # 1, 2, 4, ... of a length, then the rest
                step = min(step, many)
                bits |= (bits << (length * step)) & self.full
                many -= step
                step *= 2
            self.sums.append(bits)

    def fullest(self) -> dict[int, int]:
        """The longest length left, and what fills its bin best."""
        while self.lengths and not self.left[self.lengths[-1]]:
            self.lengths.pop()
            self.usable.pop()
            if len(self.sums) > len(self.lengths) + 1:
                self.sums.pop()
        longest = self.lengths[-1]
        self.left[longest] -= 1
        self._refresh()
        room = self.size - longest
        reach = self.sums[-1] & ((1 << (room + 1)) - 1)
        target, found = reach.bit_length() - 1, {longest: 1}
        for i in range(len(self.lengths) - 1, -1, -1):
            if not target:
                break
            length, often = self.lengths[i], 0
            if length > target:
                continue
            while often < self.usable[i] and target >= length and self._reaches(i, target, often, length):
                target, often = target - length, often + 1
            if often:
                found[length] = found.get(length, 0) + often
        self.left[longest] += 1
        return found

    def _reaches(self, i: int, target: int, often: int, length: int) -> bool:
        """Whether one more of the length leaves a sum that shorter ones, and more of this, can make up."""
        rest, below = target - length, self.sums[i]
        for _ in range(self.usable[i] - often):
            if (below >> rest) & 1:
                return True
            rest -= length
            if rest < 0:
                return False
        return False

    def __iter__(self) -> Iterator[tuple[int, dict[int, int]]]:
        remaining = sum(self.left)
        while remaining:
            found = self.fullest()
            times = min(self.left[x] // n for x, n in found.items())
            for x, n in found.items():
                self.left[x] -= n * times
                remaining -= n * times
            yield times, found


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[np.ndarray, ...]]:
    """By length: ascending first ranks of the ranges that patterns own, and of each the pattern's first sequence, how many pieces of the length a sequence takes, and the first one's place there."""
    ranges: list[list[tuple[int, int, int, int]]] = [[] for _ in range(size + 1)]
    used, sequence = [0] * (size + 1), 0
    for times, found in Patterns(counts, size):
        place = 0
        for length in sorted(found, reverse=True):
            ranges[length].append((used[length], sequence, found[length], place))
            used[length] += found[length] * times
            place += found[length] * length
        sequence += times
    return [tuple(np.array(r, np.int64).reshape(-1, 4).T.copy()) for r in ranges]


def write_pieces(docs: DataFrame, path: str, tokenizer_file: str, size: int, end_id: int, id_col: str, text_col: str) -> None:
    """Encodes all documents where they lie and writes their pieces, numbered by task and length."""
    spark = docs.sparkSession
    bound_batches(spark)
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer_file).read_text())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, encode = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), encoder(vocabulary.value)
        for batch in batches:
            for part in chunks(batch, "text", ENCODED_AT_ONCE):
                flat, n = encode(part.column(1))
                flat, n = np.insert(flat, np.cumsum(n), end_id), n + 1
                many = -(-n // size)
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                first = (n - size * (many - 1))[row]
                start = np.where(piece > 0, first + (piece - 1) * size, 0)
                length = np.where(piece > 0, size, first)
                at = (np.cumsum(n) - n)[row] + start
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(length, minlength=size + 1)
                columns = [pa.array(np.full(len(row), task, np.int32)), part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, names=["task", "doc_id", "piece", "start", "length", "ids_crc32", "rank"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows.mapInArrow(encode, PIECES).write.mode("overwrite").option("compression", "zstd").parquet(path)


def pack(docs: DataFrame, tokenizer_file: str, size: int = SIZE, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "bin-packing")
    write_pieces(docs, scratch.path("pieces"), tokenizer_file, size, end_id, id_col, text_col)
    pieces = spark.read.schema(PIECES).parquet(scratch.path("pieces"))
    # a row a task and length; numbers of a length's tasks are added up in the order of the tasks
    counts = scratch.keep(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    total = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length, so at most `size`
        total[r.length] = r.n
    owned = spark.sparkContext.broadcast(plan(total, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = owned.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            distinct, first = np.unique(length[order], return_index=True)
            for x, some in zip(distinct.tolist(), np.split(order, first[1:]), strict=True):
                begin, sequences, often, places = ranges[x]
                k = np.searchsorted(begin, rank[some], side="right") - 1
                inside = rank[some] - begin[k]
                sequence[some] = sequences[k] + inside // often[k]
                offset[some] = places[k] + inside % often[k] * x
            columns = [batch.column(k) for k in ("doc_id", "piece", "start")] + [pa.array(length.astype(np.int64)), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "task")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def run(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """The contract's columns."""
    return pack(docs, tokenizer_file)
