"""Removal of passages that documents with smaller ids hold already, by level-wise doubling.

A window is a run of words of one document. A window of twice a length can only
recur if both of its halves do, so each level asks about windows that lie over
recurring windows of the level before, and about no others. The first level is
thinned without loss: of the short windows within each window of the wanted length
only the one with the least hash is asked about; wherever the long window recurs, so
does that choice, as it depends on the words alone.

Asking is one shuffle a level. A task first settles what it can see itself: of the
documents of one block that share a window, only the one with the smallest id asks
the others; so a window that a third of all documents share crosses the shuffle once
a block and not once a document. Hashes have 64 bits on the pruning levels, where a
clash costs work alone, and 96 on the last.

Defined cases: null and empty texts have no words; rows with a null id take no part;
rows that share an id are one document to the rule (they don't remove each other's
words) and each gets its own row; other columns are ignored; a text is one row of any
length. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches
from .wordhash import Words, chunks

WINDOW_WORDS = 13
#: Questions that a task collects before it settles what they share.
BLOCK_QUESTIONS = 1 << 20

QUESTIONS = "h long, g int, doc_id long, several boolean, known array<long>"


def levels(words: int) -> list[int]:
    """Lengths from half the wanted one, rounded up, to it; the last step is less than a doubling if that is odd."""
    return [(words + 1) // 2, words] if words > 1 else [1]


def thinned(words: Words, short: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the short windows that are the least of a window of the length; the first of equals."""
    at, _ = words.windows(length)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    where, h = words.windows(short)
    full = np.full(len(words.starts), 2**64 - 1, np.uint64)
    full[where] = h
    inside = length - short + 1
    least = np.empty(len(at), np.int64)
    for i in range(0, len(at), 1 << 16):
        places = at[i : i + (1 << 16)]
        view = sliding_window_view(full[places[0] : places[-1] + inside], inside)
        least[i : i + (1 << 16)] = view.argmin(axis=1)[places - places[0]] + places
    least = np.unique(least)
    return least, full[least]


def candidates(words: Words, recurring: np.ndarray, row: np.ndarray, short: int, length: int, doubled: bool = False) -> np.ndarray:
    """Places where a window of the length may recur, given the recurring short windows' hashes of each row (values and their rows).

    By the least short window inside it, or, if doubled, by the two short windows at its start and at its end.
    """
    at, _ = words.windows(length)
    if not len(at) or not len(recurring):
        return at[:0]
    where, h = words.windows(short)
    good = np.zeros(len(words.starts), bool)
    if len(where):
        good[where] = _in_row(h, words.row_of(where), recurring, row)
    if doubled:
        return at[good[at] & good[at + length - short]]
    places, _ = thinned(words, short, length)
    good &= np.isin(np.arange(len(good)), places)
    covered = np.concatenate([[0], np.cumsum(good)])
    return at[covered[at + length - short + 1] > covered[at]]


def _in_row(h: np.ndarray, row: np.ndarray, recurring: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether the hash is among those of its row. The row is mixed into both sides' keys."""
    with np.errstate(over="ignore"):
        salt = np.uint64(0x9E3779B97F4A7C15)
        return np.isin(h + row.astype(np.uint64) * salt, recurring + of.astype(np.uint64) * salt)


class Asked:
    """Questions of a block: (h, g, document). settle() gives rows of QUESTIONS."""

    def __init__(self, all_recur: bool):
        self.all_recur = all_recur  # whether the first document's window counts as recurring as well
        self.h, self.g, self.doc, self.n = [], [], [], 0

    def add(self, h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> None:
        self.h.append(h.view(np.int64))
        self.g.append(g)
        self.doc.append(doc)
        self.n += len(h)

    def settle(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, g, doc = np.concatenate(self.h), np.concatenate(self.g), np.concatenate(self.doc)
        self.h, self.g, self.doc, self.n = [], [], [], 0
        order = np.lexsort((doc, g, h))
        h, g, doc = h[order], g[order], doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        distinct = new | np.concatenate([[True], doc[1:] != doc[:-1]])
        h, g, doc, new = h[distinct], g[distinct], doc[distinct], new[distinct]
        several = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
        empty = pa.nulls(int(new.sum()), pa.list_(pa.int64()))
        yield _questions(h[new], g[new], doc[new], several, empty)
        later = ~new
        if self.all_recur:
            later |= new & np.repeat(several, np.diff(np.append(np.flatnonzero(new), len(h))))
        if later.any():
            h, g, doc = h[later], g[later], doc[later]
            key = _last_key(h, g) if not self.all_recur else h
            order = np.argsort(doc, kind="stable")
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            known = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(key))
            some = doc[first]
            # spread by document, as nobody else needs them
            yield _questions(some * np.int64(0x9E3779B97F4A7C1), np.zeros(len(some), np.int32), some, np.zeros(len(some), bool), known)


def _questions(h, g, doc, several, known) -> pa.RecordBatch:
    columns = [pa.array(h, pa.int64()), pa.array(g, pa.int32()), pa.array(doc, pa.int64()), pa.array(several), known]
    return pa.RecordBatch.from_arrays(columns, names=["h", "g", "doc_id", "several", "known"])


def _last_key(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """What names a window within one document: the 64 bits alone would do, as only windows of the document itself are compared."""
    return h ^ (g.astype(np.int64) << 32)


def _answers(questions: DataFrame, all_recur: bool) -> DataFrame:
    """doc_id and the hashes of its windows that recur (all_recur) or that a smaller id's document has."""
    w = Window.partitionBy("h", "g")
    asked = F.col("known").isNull()
    least, most, several = F.min("doc_id").over(w), F.max("doc_id").over(w), F.max("several").over(w)
    yes = (least < most) | several if all_recur else F.col("doc_id") > least
    key = F.col("h") if all_recur else F.col("h").bitwiseXOR(F.shiftleft(F.col("g").cast("long"), 32))
    told = questions.select("doc_id", "known", F.when(asked & yes, key).alias("key"))
    told = told.where("known IS NOT NULL OR key IS NOT NULL")
    return told.groupBy("doc_id").agg(F.collect_list("key").alias("keys"), F.collect_list("known").alias("known")).select("doc_id", F.concat("keys", F.flatten("known")).alias("keys"))


def first_questions(docs: DataFrame, short: int, length: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(True)
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column(1))
                at, h = thinned(words, short, length)
                doc = part.column(0).to_numpy(zero_copy_only=False)[words.row_of(at)]
                asked.add(h, np.zeros(len(h), np.int32), doc)
                if asked.n >= BLOCK_QUESTIONS:
                    yield from asked.settle()
        yield from asked.settle()

    return docs.mapInArrow(ask, QUESTIONS)


def _row_keys(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    column = part.column(part.schema.get_field_index(name))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(part.num_rows), lengths)


def next_questions(docs: DataFrame, short: int, length: int, last: bool, doubled: bool = False) -> DataFrame:
    """Of docs (doc_id, text, keys): the questions about windows over recurring short ones."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(not last)
        for batch in batches:
            for part in chunks(batch, "text"):
                keys, row = _row_keys(part, "keys")
                words = Words(part.column(1), lanes=2 if last else 1)
                at = candidates(words, keys.view(np.uint64), row, short, length, doubled)
                places, h = words.windows(length)
                pick = np.searchsorted(places, at)
                g = (words.windows(length, 1)[1][pick] >> np.uint64(33)).astype(np.int32) if last else np.zeros(len(at), np.int32)
                asked.add(h[pick], g, part.column(0).to_numpy(zero_copy_only=False)[words.row_of(at)])
                if asked.n >= BLOCK_QUESTIONS:
                    yield from asked.settle()
        yield from asked.settle()

    return docs.mapInArrow(ask, QUESTIONS)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL")


def removed_windows(rows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """doc_id and the keys of its windows that a document with a smaller id has."""
    *shorter, _ = levels(length)
    if not shorter:
        shorter = [1]
    keys = scratch.keep(_answers(first_questions(rows, shorter[0], length), True), "level-0")
    over = rows.join(keys, "doc_id")
    return _answers(next_questions(over, shorter[0], length, True), False)


def dedup(docs: DataFrame, length: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space)."""
    rows = _prepared(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    gone = removed_windows(rows, length, scratch)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                keys, row = _row_keys(part, "keys")
                words = Words(part.column(1), lanes=2 if len(keys) else 1)
                cover = np.zeros(len(words.starts) + 1, np.int64)
                if len(keys):
                    at, h = words.windows(length)
                    g = (words.windows(length, 1)[1] >> np.uint64(33)).astype(np.int64)
                    hit = at[_in_row((h.view(np.int64) ^ (g << 32)).view(np.uint64), words.row_of(at), keys.view(np.uint64), row)]
                    cover[hit] += 1
                    cover -= np.bincount(hit + length, minlength=len(cover))[: len(cover)]
                keep = np.cumsum(cover)[:-1] == 0
                kept = [words.joined(i, keep[words.bounds[i] : words.bounds[i + 1]]) for i in range(words.rows)]
                left = np.concatenate([[0], np.cumsum(keep)])
                n_removed = words.counts - (left[words.bounds[1:]] - left[words.bounds[:-1]])
                columns = [part.column(0), pa.array(words.counts.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.join(gone, "doc_id", "left").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def recurring_levels(docs: DataFrame, start: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> dict[int, DataFrame]:
    """By length, doubling from ``start`` until no candidates survive: doc_id and the hashes of its windows that two documents or more have."""
    rows = _prepared(docs, id_col, text_col)
    scratch, length, found = Scratch(docs.sparkSession, "recurring"), start, {}
    keys = scratch.keep(_answers(first_questions(rows, start, start), True), f"length-{start}")
    while not keys.isEmpty():
        found[length] = keys
        questions = next_questions(rows.join(keys, "doc_id"), length, 2 * length, False, doubled=True)
        length *= 2
        keys = scratch.keep(_answers(questions, True), f"length-{length}")
    return found


def run(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
