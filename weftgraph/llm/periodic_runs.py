"""Runs of words that repeat with a period, by a Kruskal walk over suffixes in descending order of their common prefixes.

Suffixes of one text are classes of their own at first. Pairs of neighbours in suffix
order are edges, as long as their common prefix (LCP); edges are taken from the longest
on, and the two classes of an edge are united: union-find over ordered sets of positions,
the smaller one going into the larger one. A position that goes in becomes the neighbour of
two others. If the distance to one of them is at most the current LCP, the stretch from the
earlier of the two to the end of the common prefix repeats with that distance: it seeds a
run. Within a run, positions a smallest period apart become neighbours just when their
classes meet, at their own LCP, as anything between them would make a smaller period; so
every run is seeded by its first position, and seeds that a word before them would extend
aren't first.

What can't seed a run of the asked size is left out without loss. A run of period q and
length of at least e q has common prefixes of (e - 1) q words or more, so suffixes take part
only where a stretch of a few words recurs in the text at all, and texts without enough such
positions in a row are told to have no run before any is sorted. Suffixes of all other texts
of a batch are sorted together, by prefix doubling over the positions that aren't alone yet.

Each text is read once, where it lies; nothing is shuffled. Memory is a small multiple of a
batch, or of one text. A set of positions is held in blocks, so that a text that is one long
run costs no more a word than others.

Defined cases: null and empty texts, and texts without words, have no run and no words; every
row has its own result, also rows of one id and rows without an id, which count as not
divisible; other columns are ignored; an empty table gives an empty result. Words are compared
by 64-bit hashes within one text; suffix order and every LCP are exact on these.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .wordhash import Words, chunks, mix

#: A run is at least so long, and so many of its periods.
LEAST_LENGTH, LEAST_POWER = 6, 4
#: Positions in a block of an ordered set.
BLOCK = 512

Run = tuple[int, int, int]


class Positions:
    """An ordered set of integers in blocks."""

    __slots__ = ("blocks", "size")

    def __init__(self, first: int):
        self.blocks, self.size = [[first]], 1

    def add(self, x: int) -> tuple[int, int]:
        """Puts x in; gives what stands before and after it, -1 for nothing."""
        blocks = self.blocks
        low, high = 0, len(blocks) - 1
        while low < high:  # the last block whose first is not above x
            middle = (low + high + 1) // 2
            if blocks[middle][0] <= x:
                low = middle
            else:
                high = middle - 1
        block = blocks[low]
        k = bisect_left(block, x)
        before = block[k - 1] if k else (blocks[low - 1][-1] if low else -1)
        after = block[k] if k < len(block) else (blocks[low + 1][0] if low + 1 < len(blocks) else -1)
        block.insert(k, x)
        self.size += 1
        if len(block) > BLOCK:
            blocks.insert(low + 1, block[BLOCK // 2 :])
            del block[BLOCK // 2 :]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def seeds(edges: list[tuple[int, int, int]], least: Callable[[int], int]) -> Iterator[Run]:
    """(position, distance, LCP) of neighbours at a distance whose least LCP the current one reaches. edges: (LCP, one, other), descending."""
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    for lcp, a, b in edges:
        roots = []
        for x in (a, b):
            if x not in parent:
                parent[x] = x
                sets[x] = Positions(x)
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            roots.append(x)
        big, small = roots
        if sets[big].size < sets[small].size:
            big, small = small, big
        into = sets[big]
        parent[small] = big
        going, last = list(sets.pop(small)), -1
        for x, then in zip(going, [*going[1:], -1], strict=True):
            before, after = into.add(x)
            # neighbours of one old set were so before, or have another of it between them
            if before != last and lcp >= least(x - before):
                yield before, x - before, lcp
            if after >= 0 and (then < 0 or after < then) and lcp >= least(after - x):
                yield x, after - x, lcp
            last = x


def suffix_order(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of several texts, each text's in its own stretch, and the rank of each, by prefix doubling. Only ties are sorted again."""
    n = len(words)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][text]
    distinct, word = np.unique(words, return_inverse=True)
    key = text * np.int64(len(distinct)) + word
    live, length = np.arange(n), 1
    order, rank = np.arange(n), np.zeros(n, np.int64)
    while True:
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        base = rank[live]  # where the tie begins; ties are in ascending order
        place = base + np.arange(len(live)) - np.searchsorted(base, base)
        order[place] = live
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[live] = np.maximum.accumulate(np.where(new, place, 0))
        many = np.diff(np.append(np.flatnonzero(new), len(live)))
        live = live[np.repeat(many > 1, many)]
        if not len(live):
            return order, rank
        after = live + length
        second = np.where(after < end[live], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[live] * np.int64(n + 1) + second
        length *= 2


def edges_of(words: list[int], order: list[int], rank: list[int], recurs: list[bool], floor: int) -> list[tuple[int, int, int]]:
    """(LCP, one, other) of neighbours in one text's suffix order that share ``floor`` words or more, descending."""
    n, h, out = len(words), 0, []
    for i in range(n):
        r = rank[i]
        if not r or not recurs[i]:
            h = 0
            continue
        j = order[r - 1]
        while i + h < n and j + h < n and words[i + h] == words[j + h]:
            h += 1
        if h >= floor:
            out.append((h, j, i))
        h = h - 1 if h else 0
    out.sort(key=lambda e: -e[0])
    return out


def runs_of(words: np.ndarray, bounds: np.ndarray, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> list[list[Run]]:
    """(start, length, period) of the runs of each text, ascending by start, then period. Text i has words bounds[i]:bounds[i + 1]."""
    counts = np.diff(bounds)
    found: list[list[Run]] = [[] for _ in counts]
    least = lambda q: max(least_length - q, (least_power - 1) * q)
    floor = min(least(q) for q in range(1, least_length + 1))
    n = len(words)
    if n <= floor:
        return found
    text = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        h = np.zeros(n - floor + 1, np.uint64)
        for j in range(floor):
            h = h * np.uint64(0xAF251AF3B0F025B5) + words[j : j + len(h)]
        key = mix(h) + text[: len(h)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    inside = np.flatnonzero(text[: len(h)] == text[floor - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    gap = np.full(n, n, np.int64)  # to the next place with the same words
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    recurs = np.zeros(n, bool)
    recurs[order[1:][same]] = recurs[order[:-1][same]] = True
    # from a run's first position on, at least (e - 1) q - floor + 1 positions have a next place, the first one at a distance of q or less
    stops = np.append(np.flatnonzero(gap == n), n)
    row = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    enough = (row > 0) & (row > (least_power - 1) * gap - floor)
    wanted = np.unique(text[enough])
    if not len(wanted):
        return found
    chosen = np.concatenate([np.arange(bounds[t], bounds[t + 1]) for t in wanted.tolist()])
    cuts = np.concatenate([[0], np.cumsum(counts[wanted])])
    some = words[chosen]
    order, rank = suffix_order(some, cuts)
    for t, (i, j) in zip(wanted.tolist(), pairwise(cuts.tolist()), strict=True):
        own = some[i:j].tolist()
        edges = edges_of(own, (order[i:j] - i).tolist(), (rank[i:j] - i).tolist(), recurs[chosen[i:j]].tolist(), floor)
        first = {(x, d + c, d) for x, d, c in seeds(edges, least) if x == 0 or own[x - 1] != own[x - 1 + d]}
        found[t] = sorted(first, key=lambda r: (r[0], r[2]))
    return found


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each of n words stays: all but those behind the first period of a run."""
    cover = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return np.cumsum(cover)[:n] == 0


def best(runs: list[Run]) -> Run | None:
    """The run of the greatest length a period; of equals, the one of the least start, then period."""
    top = None
    for start, length, period in runs:
        if top is None or length * top[2] > top[1] * period:
            top = start, length, period
    return top


def planted(key: int | None, n: int) -> np.ndarray:
    """Which original word each word becomes: for keys whose checksum is divisible by ten, a repetition from some word on."""
    at = np.arange(n)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int | None, int], np.ndarray] | None = None, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> DataFrame:
    """For every row: doc_id, runs (start, length, period), and the words that are left, joined by one space (collapsed).

    change(id, n) says which original word each of n words becomes first; None leaves texts as they are.
    """
    bound_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in chunks(batch, "text"):
                words, ids = Words(part.column(1)), part.column(0).to_pylist()
                bounds, moved = words.bounds, np.arange(len(words.starts))
                if change:
                    for i, key in enumerate(ids):
                        a, b = int(bounds[i]), int(bounds[i + 1])
                        moved[a:b] = a + change(key, b - a)
                found = runs_of(words.hashes[0][moved], bounds, least_length, least_power)
                raw = words.data.tobytes()
                starts, ends, kept = words.starts[moved].tolist(), words.ends[moved].tolist(), []
                for i, runs in enumerate(found):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    stay = range(a, b) if not runs else (a + np.flatnonzero(collapsed(b - a, runs))).tolist()
                    kept.append(b" ".join([raw[starts[k] : ends[k]] for k in stay]))
                columns = [part.column(0), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found], run_type), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(find, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    told = detect(docs, change=planted)
    # a struct's fields are compared in order: greatest length a period as a fraction, then least start, then least period
    better = lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], a).otherwise(b)
    top = F.when(F.size("runs") > 0, F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.col("runs")[0], lambda t, r: better(r, t)))
    line = lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    told = told.withColumn("top", top)
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
