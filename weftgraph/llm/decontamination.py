"""Benchmark decontamination over a distributed positional inverted index.

The index of a corpus is a folder of two tables. A segment holds the documents that
one task read until a bound; nothing is shuffled to build it. ``postings`` has a row
for each term of a segment: the places where it stands, in ascending order, in the
segment's count of words; ``segment_docs`` has each document's first place and number
of words. Between two documents GAP places stay empty, so no phrase and no proximity
match reaches over a document's end.

A search takes a set of test phrases, in blocks whose size is bounded. For each block
the postings of its terms are gathered by segment, and each phrase starts from its
rarest term in that segment: that list, less the term's offset, is intersected with
the others' in the order of their lengths, until nothing is left. A proximity search
starts from the rarest term's places, widens the equality of places by a slop within
that place's document, and takes the shortest span there that holds all terms.

Defined cases: A-Z count as a-z and words are runs of ASCII letters, digits and all
characters beyond ASCII; null texts have no words; documents and items with a null id
take no part; rows that share a document's id are one document with separate texts,
whose counts are added; rows that share an item's id are phrases of one item; items
without words match nothing. An empty corpus or benchmark gives no match. Terms are
named by 64-bit hashes; a clash would need 64 equal bits in every word of a phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches
from .wordhash import NOT_ALPHANUMERIC, Words, chunks

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW_WORDS = 10
#: Words after which a segment is closed, at a document's end.
SEGMENT_WORDS = 1 << 20
#: Places between documents; proximity spans must be shorter.
GAP = 1 << 6
#: Test phrases that are searched for at once; the bound of what is broadcast (each has up to WINDOW_WORDS terms).
BLOCK_PHRASES = 200_000

POSTINGS = "segment long, term long, places array<int>"
SEGMENT_DOCS = "segment long, row int, doc_id long, first int, n_words int"


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    bound_batches(docs.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        held, terms, ids, counts = 0, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            n = np.concatenate(counts)
            first = np.cumsum(n + GAP) - (n + GAP)
            term = np.concatenate(terms).view(np.int64)
            place = np.arange(len(term)) + GAP * np.repeat(np.arange(len(n)), n)
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order].astype(np.int32)
            cut = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(term)).astype(np.int32)), pa.array(place))
            step = 1 << 15
            for i in range(0, len(cut), step):
                k = len(cut[i : i + step])
                yield _row(segment, k, term[cut[i : i + step]], lists.slice(i, k), None)
            step = 1 << 14
            for i in range(0, len(n), step):
                k = len(n[i : i + step])
                yield _row(segment, k, None, None, (np.arange(i, i + k), np.concatenate(ids)[i : i + k], first[i : i + k], n[i : i + k]))

        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column(1), NOT_ALPHANUMERIC, fold=True)
                terms.append(words.hashes[0])
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                counts.append(words.counts)
                held += len(words.starts) + GAP * words.rows
                if held >= SEGMENT_WORDS:
                    yield from close()
                    segment, held, terms, ids, counts = segment + 1, 0, [], [], []
        if counts:
            yield from close()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL")
    both = rows.mapInArrow(index, "segment long, term long, places array<int>, row int, doc_id long, first int, n_words int, kind string")
    both.write.mode("overwrite").partitionBy("kind").option("compression", "zstd").parquet(path)


def _row(segment: int, k: int, term, places, doc) -> pa.RecordBatch:
    row, doc_id, first, n = doc or (None, None, None, None)
    make = lambda x, kind: pa.nulls(k, kind) if x is None else pa.array(x).cast(kind)
    columns = [pa.array(np.full(k, segment, np.int64)), make(term, pa.int64()), pa.nulls(k, pa.list_(pa.int32())) if places is None else places, make(row, pa.int32()), make(doc_id, pa.int64()), make(first, pa.int32()), make(n, pa.int32()), pa.array(["docs" if doc else "postings"] * k)]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "term", "places", "row", "doc_id", "first", "n_words", "kind"])


def postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{POSTINGS}, kind string").parquet(path).where("kind = 'postings'").select("segment", "term", "places")


def segment_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SEGMENT_DOCS}, kind string").parquet(path).where("kind = 'docs'").select("segment", "row", "doc_id", "first", "n_words")


def phrases(items: DataFrame, words: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id and ``terms`` of every window of an item; a shorter item that has words is one window. Equal phrases of an item once."""
    bound_batches(items.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column(1), NOT_ALPHANUMERIC, fold=True)
                h, ids = w.hashes[0].view(np.int64), part.column(0)
                at, _ = w.windows(words)
                long = pa.RecordBatch.from_arrays([ids.take(pa.array(w.row_of(at))), pa.FixedSizeListArray.from_arrays(pa.array(h[(at[:, None] + np.arange(words)).ravel()]), words).cast(pa.list_(pa.int64()))], names=["item_id", "terms"])
                few = np.flatnonzero((w.counts > 0) & (w.counts < words))
                short = pa.RecordBatch.from_arrays([ids.take(pa.array(few)), pa.array([h[w.bounds[i] : w.bounds[i + 1]] for i in few], pa.list_(pa.int64()))], names=["item_id", "terms"])
                yield from (x for x in (long, short) if x.num_rows)

    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")).where("item_id IS NOT NULL")
    kind = dict(rows.dtypes)["item_id"]
    return rows.mapInArrow(cut, f"item_id {kind}, terms array<long>").distinct()


def _starts(lists: list[np.ndarray], offsets: list[int]) -> np.ndarray:
    """Starts (places less offsets) at which all terms stand."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    rarest = order[0]
    starts = lists[rarest] - offsets[rarest]
    for i in order[1:]:
        if not len(starts):
            break
        want, have = starts + offsets[i], lists[i]
        j = np.searchsorted(have, want)
        starts = starts[(j < len(have)) & (have[np.minimum(j, len(have) - 1)] == want)]
    return starts


def _near(phrase: list[int], where: dict[int, np.ndarray], slop: int, first: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of the rarest term with all others near: its document, and the shortest span (first place, last place) that holds all of them.

    A span has at most len(phrase) + slop words. Copies of a term stand in order, at places of their own.
    """
    rarest = min(range(len(phrase)), key=lambda i: len(where[phrase[i]]))
    at = where[phrase[rarest]].astype(np.int64)
    doc = np.searchsorted(first, at, side="right") - 1
    low, high = first[doc].astype(np.int64), first[doc].astype(np.int64) + n_words[doc] - 1
    length = len(phrase) + slop
    start, end = at - length, at + length  # longer than any span
    for back in range(length):
        begin = at - back
        ok, last, taken = begin >= low, begin, {}
        for i, term in enumerate(phrase):
            have = where[term]
            least, most = (at, at) if i == rarest else (at + i - rarest - slop, at + i - rarest + slop)
            least, most = np.maximum(least, begin), np.minimum(np.minimum(most, high), begin + length - 1)
            if term in taken:
                least = np.maximum(least, taken[term] + 1)
            j = np.searchsorted(have, least)
            place = have[np.minimum(j, len(have) - 1)].astype(np.int64)
            ok = ok & (j < len(have)) & (place <= most)
            taken[term], last = place, np.maximum(last, place)
        better = ok & (last - begin < end - start)
        start, end = np.where(better, begin, start), np.where(better, last, end)
    found = end - start < length
    return doc[found], start[found], end[found]


def search(spark: SparkSession, path: str, tests: DataFrame, slop: int = 0, block: int = BLOCK_PHRASES) -> DataFrame:
    """doc_id, row, segment, item_id and the spans ([start, end) in the document's words) that the item's phrases cover there, merged.

    With a slop, each term may stand so many places from where the phrase has it, counted from its rarest term, and all stand
    within as many words as the phrase has and the slop; the span then goes from the first to the last of them.
    Blocks of phrases are searched for one after another, and what each finds is written before the next.
    """
    if slop >= GAP // 2:
        raise ValueError(f"the slop must be below {GAP // 2}")
    bound_batches(spark)
    scratch = Scratch(spark, "decontamination")
    kind = dict(tests.dtypes)["item_id"]
    # numbered by hash, in blocks of a bounded size
    blocks = max(1, -(-tests.count() // block))
    tests = scratch.keep(tests.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(blocks)).cast("int")), "phrases")
    names = []
    for b in range(blocks):
        some = tests.where(F.col("block") == b)
        terms = some.select(F.explode("terms").alias("term")).distinct()
        lists = postings(spark, path).join(F.broadcast(terms), "term", "left_semi")  # of a block's terms
        often = {r.term: r["n"] for r in lists.groupBy("term").agg(F.count("*").alias("n")).toLocalIterator()}
        by_rarest: dict[int, list[tuple]] = {}
        for r in some.select("item_id", "terms").toLocalIterator():
            if all(t in often for t in r.terms):  # others occur nowhere
                by_rarest.setdefault(min(r.terms, key=often.__getitem__), []).append((r.item_id, r.terms))
        told = spark.sparkContext.broadcast(by_rarest)
        one = lists.groupBy("segment").cogroup(segment_docs(spark, path).groupBy("segment")).applyInArrow(_searcher(told, slop, kind), f"doc_id long, row int, segment long, item_id {kind}, spans array<struct<a:int,b:int>>")
        names.append(f"found-{b}")
        found = scratch.keep(one, names[-1])
        told.destroy()
    return spark.read.schema(found.schema).parquet(*[scratch.path(name) for name in names])


def _searcher(told, slop: int, kind: str):
    item_type = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()

    def find(lists: pa.Table, docs: pa.Table) -> pa.Table:
        empty = {"doc_id": pa.array([], pa.int64()), "row": pa.array([], pa.int32()), "segment": pa.array([], pa.int64()), "item_id": pa.array([], item_type), "spans": pa.array([], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))}
        if not lists.num_rows or not docs.num_rows:
            return pa.table(empty)
        column = lists.column("places").combine_chunks()
        values, ends = column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())
        terms = lists.column("term").to_pylist()
        where = {t: values[a:b] for t, a, b in zip(terms, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}
        docs = docs.sort_by("first")
        first, n_words = docs.column("first").to_numpy(), docs.column("n_words").to_numpy()
        spans: dict[tuple[int, object], list[tuple[int, int]]] = {}
        # only phrases whose rarest term the segment has
        for item, phrase in (p for term in told.value.keys() & where.keys() for p in told.value[term]):
            if any(t not in where for t in phrase):
                continue
            if slop:
                for d, start, end in zip(*(x.tolist() for x in _near(phrase, where, slop, first, n_words)), strict=True):
                    spans.setdefault((d, item), []).append((start - int(first[d]), end + 1 - int(first[d])))
                continue
            starts = _starts([where[t] for t in phrase], list(range(len(phrase))))
            for at, d in zip(starts.tolist(), (np.searchsorted(first, starts, side="right") - 1).tolist(), strict=True):
                a = max(0, at - int(first[d]))
                spans.setdefault((d, item), []).append((a, min(int(n_words[d]), at - int(first[d]) + len(phrase))))
        keys = list(spans)
        merged = [[{"a": a, "b": b} for a, b in merge(spans[k])] for k in keys]
        at = pa.array([d for d, _ in keys], pa.int64())
        out = docs.take(at)
        return pa.table({"doc_id": out.column("doc_id"), "row": out.column("row"), "segment": out.column("segment"), "item_id": pa.array([i for _, i in keys], item_type), "spans": pa.array(merged, empty["spans"].type)})

    return find


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals as disjoint ones in ascending order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def union_length(spans):
    """Words within any of the intervals, as a column: each adds what lies beyond the furthest end before it."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step, lambda s: s["n"])


def report(docs: DataFrame, benchmark: DataFrame, words: int = WINDOW_WORDS) -> DataFrame:
    """For every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "inverted-index")
    path = scratch.path("index")
    build_index(docs, path)
    found = search(spark, path, phrases(benchmark, words))
    texts = found.groupBy("segment", "row", "doc_id").agg(union_length(F.flatten(F.collect_list("spans"))).alias("n_hit"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    hits = texts.groupBy("doc_id").agg(F.sum("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    sizes = segment_docs(spark, path).groupBy("doc_id").agg(F.sum("n_words").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return sizes.join(hits, "doc_id", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
